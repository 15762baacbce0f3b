"""Problem 7: missing or wrong document language labels.

A byte convolutional network (filters of several widths, max pooling, softmax),
trained in numpy on a bounded sample of the records' own labelled sentences, judges
batched fixed-length windows; a sentence takes the mean of its windows, neighbouring
sentences of one language form a segment with a confidence. Training drops sentences
that the first round finds mislabelled, and starts from the text alone at every size.

Defined results: null, empty and short texts have no segments; null, blank and
unknown labels denote no language; repeated rows are judged alike; without any
labelled text nothing is judged.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.residue import failed, filler_only
from spanforge.llm.unify import CYRILLIC_ALIKE, CYRILLIC_LATIN, GREEK_ALIKE, GREEK_LATIN

# Languages with the codes and names that denote them.
LANGUAGES = {
    "en": "en eng english", "de": "de ger deu german deutsch", "fr": "fr fra fre french français", "es": "es spa spanish español", "pt": "pt por portuguese português",
    "nl": "nl dut nld dutch nederlands", "it": "it ita italian italiano", "ru": "ru rus russian русский",
}
NAMES = tuple(LANGUAGES)
RECORDS = 400  # labelled records of each language that train, those of the smallest hashes; all records are judged
TRAIN_WINDOWS = 4_000  # windows of each language that train, drawn from those records
MIN_WORDS = 8
MIN_RECORD_WORDS = 20
CONFIDENT = 0.7
WINDOW = 48
FILTERS = {2: 16, 4: 32}  # width: number
ROUNDS, EPOCHS, RATE = 2, 8, 0.05

SENTENCE = re.compile(r"(?<=[.!?…])(?<!\s[A-ZÀ-ÞČ]\.)\s+|\n+")
LETTERS = re.compile(r"[^\W\d_]+")
NAME = re.compile(r"(?<=\s)[^\w\s]{0,2}[A-ZÀ-ÖØ-ÞĀ-ŽА-ЯЁ][\w'’.&-]*|\S*[\d@]\S*")
CONTACT = re.compile(r"[|·☎]")  # separators of a contact line, which is no sentence even if an abbreviation ends it
SPELLED = re.compile(r"\S*(?:\s?[\[(](?:at|dot)[\])]\s?\S*)+")
ENDS = (".", "!", "?", "…", "。")
_ALIKE = str.maketrans(CYRILLIC_ALIKE + GREEK_ALIKE, CYRILLIC_LATIN + GREEK_LATIN)
_CLASS = np.full(256, 1, dtype=np.int64)  # signs
_CLASS[[0, 9, 10, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[97:123] = np.arange(3, 29)
_CLASS[65:91] = np.arange(3, 29)
_CLASS[128:256] = np.arange(29, 157)
CLASSES = 157


def denoted(label: Column) -> Column:
    """The language that a label denotes in any code, case or regional form; null for none."""
    code = F.regexp_extract(F.lower(F.trim(label)), r"^([^\W\d_]+)", 1)
    out = F.lit(None).cast("string")
    for name, forms in LANGUAGES.items():
        out = F.when(code.isin(forms.split()), name).otherwise(out)
    return out


def plain(text: str) -> str:
    """Lower case of ordinary letters, so that odd characters do not look like another language."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = re.sub(r"[­᠎​-‏⁠﻿]", "", text)
        if re.search(r"[Ͱ-ӿ]", text):
            text = re.sub(r"\S+", lambda m: m[0].translate(_ALIKE) if re.search(r"[a-zA-Zà-ÿ]", m[0]) and re.search(r"[Ͱ-ӿ]", m[0]) else m[0], text)
    return text.lower()


def sentences(text: str, all_lines: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, plain text without names and numbers) of the sentences of MIN_WORDS or more words.

    A line that does not end like a sentence needs two words more and no sign of a
    contact line; spelled mail addresses in one that does are cut out. all_lines: anything with a
    word counts.
    """
    out, at = [], 0
    for m in [*SENTENCE.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        if len(part) >= 2 * MIN_WORDS - 1 or (all_lines and part):
            ended = part.rstrip()[-1:] in ENDS
            contact = not all_lines and CONTACT.search(part)
            if not all_lines and ("[" in part or "(" in part):
                contact = contact or not ended and SPELLED.search(part)
                part = SPELLED.sub("", part) if ended else part
            words = len(LETTERS.findall(part))
            if words >= (1 if all_lines else MIN_WORDS - 1 if ended else MIN_WORDS + 2) and (all_lines or not contact and (ended or "@" not in part)) and (all_lines or len(part.split()) >= MIN_WORDS):
                p = plain(part if part.isupper() else NAME.sub("", part))
                if all_lines or len(LETTERS.findall(p)) >= MIN_WORDS // 2:
                    out.append((at, end, p))
        at = m.end() if m else end
    return out


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(classes of each window, index of its text): windows side by side, the last one ending with the text."""
    rows, owner = [], []
    for i, t in enumerate(texts):
        b = b" " + t.encode("utf-8", "ignore") + b" "
        if len(b) <= WINDOW:
            rows.append(b.ljust(WINDOW, b"\0"))
            owner.append(i)
            continue
        for at in range(0, len(b) - WINDOW + 1, WINDOW):
            rows.append(b[at : at + WINDOW])
            owner.append(i)
        if len(b) % WINDOW:
            rows.append(b[-WINDOW:])
            owner.append(i)
    if not rows:
        return np.zeros((0, WINDOW), dtype=np.int64), np.zeros(0, dtype=np.int64)
    return _CLASS[np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, WINDOW)], np.array(owner)


class Network:
    """Filters of each width over byte classes, max pooling over the window, softmax."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.filters = {w: rng.normal(0, 0.3, (w, CLASSES, n)).astype(np.float32) for w, n in FILTERS.items()}
        total = sum(FILTERS.values())
        self.out = rng.normal(0, 0.1, (total + 1, len(NAMES))).astype(np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(largest activation of each filter, where)."""
        best, where = [], []
        for w, f in self.filters.items():
            a = sum(f[k][x[:, k : x.shape[1] - w + 1 + k]] for k in range(w))
            i = a.argmax(axis=1)
            best.append(np.take_along_axis(a, i[:, None, :], 1)[:, 0])
            where.append(i)
        return np.concatenate(best, axis=1), np.concatenate(where, axis=1)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> None:
        """Adam over shuffled batches."""
        rng = np.random.default_rng(1)
        slots = [*self.filters.values(), self.out]
        m, v, step = [np.zeros_like(s) for s in slots], [np.zeros_like(s) for s in slots], 0
        for epoch in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                h, where = self.pooled(x[at])
                live = h > 0
                z = np.maximum(h, 0) @ self.out[:-1] + self.out[-1]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(at)), y[at]] -= 1
                p /= len(at)
                back = (p @ self.out[:-1].T) * live
                grads, start = [], 0
                for w, f in self.filters.items():
                    n = f.shape[2]
                    g = np.zeros_like(f)
                    for k in range(w):
                        cls = np.take_along_axis(x[at], where[:, start : start + n] + k, 1)
                        np.add.at(g[k], (cls, np.arange(n)[None, :]), back[:, start : start + n])
                    grads.append(g)
                    start += n
                grads.append(np.vstack([np.maximum(h, 0).T @ p, p.sum(axis=0)]))
                step += 1
                lr = rate * 0.3 * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for s, g, a, b in zip(slots, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    s -= lr * a / (np.sqrt(b) + 1e-8)

    def compiled(self) -> tuple:
        """Tables of byte pairs in 16-bit steps, for quick judging."""
        scale = 6000 / max(1e-6, max(float(np.abs(f).sum(axis=0).max()) for f in self.filters.values()))
        pairs = [[np.round((f[k][:, None, :] + f[k + 1][None, :, :]).reshape(-1, f.shape[2]) * scale).astype(np.int16) for k in range(0, w, 2)] for w, f in self.filters.items()]
        return pairs, self.out[:-1] / scale, self.out[-1]


def log_probabilities(tables: tuple, x: np.ndarray) -> np.ndarray:
    """Log probability of each language for windows of classes."""
    pairs, out, bias = tables
    result = []
    for at in range(0, len(x), 256):
        c = x[at : at + 256]
        both = c[:, :-1] * CLASSES + c[:, 1:]
        pooled = []
        for steps in pairs:
            n = both.shape[1] - 2 * (len(steps) - 1)
            a = steps[0][both[:, :n]]
            for k in range(1, len(steps)):
                a += steps[k][both[:, 2 * k : 2 * k + n]]
            pooled.append(a.max(axis=1))
        z = np.maximum(np.concatenate(pooled, axis=1), 0).astype(np.float32) @ out + bias
        z -= z.max(axis=1, keepdims=True)
        result.append(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))
    return np.concatenate(result) if result else np.zeros((0, len(NAMES)), dtype=np.float32)


def judge(tables: tuple, texts: list[str]) -> np.ndarray:
    """Probability of each language for each text."""
    x, owner = windows(texts)
    sums = np.zeros((len(texts), len(NAMES)))
    np.add.at(sums, owner, log_probabilities(tables, x))
    mean = sums / np.maximum(1, np.bincount(owner, minlength=len(texts)))[:, None]
    p = np.exp(mean)
    return p / p.sum(axis=1, keepdims=True)


def fit(records: DataFrame, key: str, text: str, label: str) -> tuple | None:
    """Tables of a network trained on the sentences of a bounded sample of labelled records; None without labels."""
    rows = records.select(denoted(F.col(label)).alias("lang"), F.xxhash64(key, text).alias("h"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # the hashes first, so that only numbers are ranked and only the sample's texts move
    ranked = rows.select("lang", "h").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= RECORDS)
    last = {r.lang: r.h for r in ranked.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    limits = F.create_map(*[F.lit(x) for pair in last.items() for x in pair]) if last else F.create_map().cast("map<string,bigint>")
    first = rows.where(F.col("h") <= F.try_element_at(limits, F.col("lang"))).distinct().orderBy("lang", "h").collect()
    texts, kinds = [], []
    for r in first:
        for *_, t in sentences(r.text):
            texts.append(t)
            kinds.append(NAMES.index(r.lang))
    if not texts:
        return None
    x, owner = windows(texts)
    y = np.array(kinds)
    kept = np.ones(len(texts), dtype=bool)
    for turn in range(ROUNDS):
        net = Network()
        use = kept[owner]
        share = np.bincount(y[owner][use], minlength=len(NAMES))
        rng = np.random.default_rng(3)
        use &= rng.random(len(owner)) < np.minimum(1, TRAIN_WINDOWS / np.maximum(1, share))[y[owner]]
        net.train(x[use], y[owner][use], EPOCHS if turn else EPOCHS // 2)
        tables = net.compiled()
        if turn + 1 < ROUNDS:
            p = judge(tables, texts)
            kept = p[np.arange(len(y)), y] > 0.5
    return tables


def segments(df: DataFrame, key: str, text: str, tables: tuple | None, main_only: bool = False) -> DataFrame:
    """(id, span_start, span_end, lang, confidence, words): runs of neighbouring sentences of one language.

    main_only: one row for a record, the language of most of its words; texts without
    any whole sentence are judged by their lines.
    """
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["id", "span_start", "span_end", "lang", "confidence", "words"]
        for rows in batches:
            parts, owner = [], []
            for i, t in enumerate(rows.text):
                found = sentences(t) or (sentences(t, True) if main_only else [])
                parts += found
                owner += [i] * len(found)
            p = judge(shared.value, [t for *_, t in parts]) if parts and shared.value else np.zeros((0, len(NAMES)))
            best = p.argmax(axis=1) if len(p) else []
            out: list[list] = []
            last = -1
            for k, i in enumerate(owner if len(p) else []):
                (a, b, t), lang, n = parts[k], NAMES[best[k]], len(parts[k][2].split())
                if i == last and out[-1][3] == lang:
                    out[-1][2], out[-1][4], out[-1][5] = b, max(out[-1][4], float(p[k, best[k]])), out[-1][5] + n
                else:
                    out.append([rows.id.iloc[i], a, b, lang, float(p[k, best[k]]), n])
                last = i
            yield pd.DataFrame(out, columns=columns)

    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    found = rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, span_start int, span_end int, lang string, confidence double, words int")
    if not main_only:
        return found
    by_lang = found.groupBy("id", "lang").agg(F.sum("words").alias("words"), F.max("confidence").alias("confidence"), F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"))
    return by_lang.groupBy("id").agg(F.max_by(F.struct("span_start", "span_end", "lang", "confidence", "words"), F.struct("words", "lang")).alias("m")).select("id", "m.*")


def no_posting(text: Column) -> Column:
    """Whether a whole text is an error page, a script notice or filler, by the shares of such units in it."""
    return F.coalesce(failed(text) | filler_only(text), F.lit(True))


def undenoted(candidates: DataFrame, jobs: DataFrame, key: str = "id", text: str = "raw_text", label: str = "language") -> DataFrame:
    """(record_table, id, lang, confidence) of the languages that a record is written in and its label does not denote."""
    tables = fit(candidates, key, text, label)

    several = segments(candidates, key, text, tables).where(F.col("confidence") >= CONFIDENT).groupBy("id", "lang").agg(F.max("confidence").alias("confidence"))
    single = segments(jobs.where(~no_posting(F.col(text))), key, text, tables, main_only=True).select("id", "lang", "confidence")
    rows = several.withColumn("record_table", F.lit("candidates")).unionByName(single.withColumn("record_table", F.lit("jobs")))
    labels = candidates.select(F.lit("candidates").alias("record_table"), F.col(key).alias("id"), denoted(F.col(label)).alias("denoted")).unionByName(jobs.select(F.lit("jobs").alias("record_table"), F.col(key).alias("id"), denoted(F.col(label)).alias("denoted")))
    known = labels.where("denoted is not null").distinct()
    return rows.join(known.withColumnRenamed("denoted", "lang"), ["record_table", "id", "lang"], "left_anti").select("record_table", "id", "lang", "confidence")
