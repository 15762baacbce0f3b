"""Problem 3: template residue, filler, error pages and script notices.

A softmax classifier (L2-regularised, trained in numpy on the driver) over hashed
word and character n-grams, length and title features tells units (sentences of a
text, or a whole title) of four kinds: content, residue, filler, error. It learns
from weak labels: placeholder syntax, filler phrases, response statuses and phrases;
units that only mention such things are labelled content. Hosts of a held-out fold
never train and give the validation.

Digits are masked, so units that differ in digits only are one: each distinct unit is
labelled and judged once, and only units that are not content are joined back. A
field is a case if it has a residue or filler unit, or if error units make up most
of it. Defined results: null, empty and blank fields are no cases; repeated rows
are judged alike; without any weakly labelled unit nothing is a case.
"""

from __future__ import annotations

import re
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import written

KINDS = ("content", "residue", "filler", "error")
BITS = 18
SAMPLE = 5_000  # distinct units of each weak kind and field that train (three times as many of content), those of the smallest hashes, the most frequent content, and as many again of the other kinds, taken by signs; all units are judged
PER_SIGN = 50  # of the latter, units that show the same weak sign, the most frequent first, so that many units of one sign crowd out no other
FOLDS = 5  # one host in so many is held out
ERROR_SHARE = 0.5  # of a field's characters that error units make up
FAILED_SHARE = 0.2  # of a text's characters in units of error phrases, for the rest of the text to be weakly labelled so, too; and of a unit's rows in such texts, as menus also stand on a few error pages
FILLER_WORDS = 0.05  # share of common words below which a text is no language
BROADCAST_UNITS = 100_000  # distinct units that are not content up to which they are broadcast; more are joined by shuffle
CONFIDENT = 0.6  # probability below which a unit counts as content
L2, EPOCHS, RATE = 1e-5, 10, 0.3

# Weak labels, as patterns of Java and Python alike.
RESIDUE = (
    r"\{\{[^{}\n]*\}\}|\{%[^%\n]*%\}|<%[^%\n]*%>|<<[^<>\n]*>>|\[\[[^\[\]\n]*\]\]|[$#]\{[^{}\n]*\}|\{\d+\}|@@\w+@@|%%\w+%%|%[A-Z][A-Z_]+%|__[A-Z][A-Z_]+__|«\w+_\w+»|(?<![\w{$#])\{[A-Za-z]\w*\}|\b[Xx]{2,}[-_./,](?:TB[ACD]\b|(?:\w+[-_./,])?[Xx]{2,}\b)|"
    r"\[object \w+\]|\bundefined\b|\bnull\b|\[(?i:insert|title|name|your|add|enter|company|location|date)\b[^\[\]\n]*\]|\[[^\[\]\n]*(?i:einfügen|insérer|insertar|hier)\]|<(?i:your|enter|insert|add)\b[^<>\n]*>|"
    r"(?i:\bgoes here\b|\buntitled\b|do not publish)"
)
FILLER = r"(?i)\b(?:lorem|ipsum|ipsam|blah|foo bar|qwertz|qwerty|asdf|x{4,}|tbd tbd|dummy|(?:bullet|item|line|paragraph)(?: point)? (?:one|two|three)|(?:your )?text here|text text|test (?:test|posting))\b|\(placeholder\)|(?-i:\bTODO:)"
MENTION = r"(?i)\b(?:such as|marked|called|named|like|so-called|wie|comme|como)\b\s*\S{0,3}[\[{<“\"«]|\b(?:our|the|an?|unsere[nr]?|notre|nos|nuestr[ao]s?) [“„\"]"
ERROR = (
    r"(?i)(?:^|\b)(?:error|fehler|erreur)(?: code)?:? ?\d+|\b[45]\d\d\b ?[–:-](?=\s|$)|\bhttp(?:/\d(?:\.\d)?)? ?[45]\d\d\b|not (?:be )?found\b|nicht gefunden|no disponible|introuvable|erreur interne|internal server error|access denied|permission to open|session has expired|"
    r"service temporarily|too many requests|request blocked|server did not answer|connection lost|undefined index|connection is not secure|blocked this region|link may be broken|could not understand|something went wrong|"
    r"can't seem to find|gone \(\d+\)|security service|verify you are human|checking your browser|java ?scripts?\b|(?:turn on|enable|activer les|need) scripts|scripts and cookies|just a moment|\bforbidden\b|bad gateway|traceback \(|\bkeyerror\b|\bupstream\b"
)
WHOLE = r"(?i)^(?:sorry!?|whoops!?|oops!?|timeout|error|fehler|erreur|loading…|unexpected response)$"
COMMON = r"(?i)\b(?:the|and|of|to|a|an|is|are|you|your|we|our|for|with|at|in|on|by|or|das|der|die|den|und|zu|im|ein|eine|mit|für|ist|le|la|les|et|des|du|de|un|une|pour|avec|el|los|las|y|en|con|para|por|que|no|if)\b"

SPLIT = r"\n+|(?<=[.!?…])\s+"


def _split(text: Column) -> Column:
    return F.split(text, SPLIT, -1)


def _share(text: Column, hit) -> Column:
    """Share of a text's characters that stand in units for which hit holds."""
    size = lambda us: F.aggregate(us, F.lit(0), lambda n, u: n + F.length(u))
    us = _split(text)
    return F.try_divide(size(F.filter(us, hit)), size(us))


def failed(text: Column) -> Column:
    """Whether a text is headed as an error (by a whole line other than a script notice, which real postings show, too), or units of error phrases make up so much of it that the rest belongs to them; taken apart only where there is any."""
    whole = lambda u: (u.rlike(ERROR) | F.trim(u).rlike(WHOLE)) & ~u.rlike(MENTION)
    headed = text.rlike(WHOLE.replace("^", r"^\s*").replace("$", r"\s*(?:\n|$|:|[-–]\s)")) | text.rlike(rf"^\s*(?![^\n]*(?i:script))(?:\S+[^\S\n]+)?(?:{ERROR})[\W\d]*?(?:\n|$)")
    return F.coalesce(headed, F.lit(False)) | F.coalesce(F.when(text.rlike(ERROR), _share(text, whole) >= FAILED_SHARE), F.lit(False))


def again(text: Column) -> Column:
    """Whether a text is of three units or more and at most half of them are different."""
    said = F.filter(_split(text), lambda u: F.trim(u) != "")
    return F.coalesce((F.size(said) >= 3) & (F.size(F.array_distinct(said)) * 2 <= F.size(said)), F.lit(False))


def filler_only(text: Column) -> Column:
    """Whether a text is no language: hardly a common word, or filler phrases in most of it."""
    words = F.regexp_count(text, F.lit(COMMON)) < FILLER_WORDS * F.size(F.split(text, r"\s+"))
    phrases = F.when(text.rlike(FILLER), _share(text, lambda u: u.rlike(FILLER)) >= ERROR_SHARE)
    return F.coalesce(words | F.coalesce(phrases, F.lit(False)), F.lit(True))


def _masked(unit: Column) -> Column:
    return F.regexp_replace(unit, r"\p{N}+", "0")


def units(jobs: DataFrame, key: str, text: str, title: str, url: str) -> DataFrame:
    """(key, is_title, unit, failed, again, host): every non-blank unit; failed, again: whether the text that it stands in reads as an error page or says the same over and over."""
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"//([^/:?#]+)", 1), F.lit(""))
    # what holds for a whole text is judged before it is taken apart, once a text and not once a unit
    base = jobs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(title).alias("title"), host.alias("host"), failed(F.col(text)).alias("failed"), again(F.col(text)).alias("again"))
    both = F.concat(
        F.transform(_split(F.coalesce("text", F.lit(""))), lambda u: F.struct(F.lit(False).alias("is_title"), F.trim(u).alias("unit"))),
        F.array(F.struct(F.lit(True).alias("is_title"), F.trim(F.coalesce("title", F.lit(""))).alias("unit"))),
    )
    return base.select("key", F.inline(both), "failed", "again", "host").where("unit <> ''").withColumns({c: F.col(c) & ~F.col("is_title") for c in ("failed", "again")})


def _weak() -> Column:
    """The weak label of a unit, null where there is none."""
    unit = F.col("unit")
    words = F.size(F.split(unit, r"\s+"))
    latin = (words >= 5) & ~unit.rlike(COMMON) & ~unit.rlike(r"\s\p{Lu}|\p{N}|[|/·›>•@()]|^[*-]|\s[–-]\s")
    different = F.size(F.array_distinct(F.split(F.lower(unit), r"[\s.,]+")))
    few = (words >= 3) & (different <= F.when(unit.rlike(r"\s\p{Lu}\p{Ll}"), words / 3).otherwise(words / 2))  # names may recur in a list
    return (
        F.when(unit.rlike(MENTION), 0)
        .when(unit.rlike(RESIDUE) & ~unit.rlike("undefined index"), 1)
        .when(unit.rlike(FILLER) | latin | few | F.col("again"), 2)
        .when(F.col("failed") | unit.rlike(ERROR) | unit.rlike(WHOLE), 3)
        .when(F.length(unit) > 0, 0)
    )


def _sign() -> Column:
    """What of a unit its weak label goes by, digits masked: the placeholder or phrase; empty where its words or its text tell the kind."""
    found = lambda pattern: F.regexp_extract("unit", pattern, 0)
    by_error = F.coalesce(F.nullif(found(ERROR), F.lit("")), found(WHOLE))
    return _masked(F.lower(F.when(F.col("weak") == 1, found(RESIDUE)).when(F.col("weak") == 2, found(FILLER)).when(F.col("weak") == 3, by_error).otherwise("")))


def distinct_units(parts: DataFrame) -> DataFrame:
    """(masked, is_title, unit, n, seen, weak, sign): each distinct unit once, with its rows, those of them on hosts that may train, its weak label, and the sign of that. Written, as it is read many times."""
    trains = (F.col("host") == "") | (_fold(F.col("host")) != 0)
    one = parts.groupBy(_masked(F.col("unit")).alias("masked"), "is_title").agg(F.min("unit").alias("unit"), F.count("*").alias("n"), F.count_if(trains).alias("seen"), *((F.count_if(c) >= FAILED_SHARE * F.count("*")).alias(c) for c in ("failed", "again")))
    return written(one.withColumn("weak", _weak()).drop("failed", "again").withColumn("sign", _sign()))


_words: dict[str, int] = {}
_SIGNS = re.compile(r"[^\w\s.,]+\w?|\w[^\w\s.,]+|__+|[A-Z]{2,}")
_TOKENS = re.compile(r"\w+|[^\w\s]+")
_COMMON = re.compile(COMMON)


def _hash(x: str) -> int:
    h = _words.get(x)
    if h is None:
        if len(_words) > 400_000:
            _words.clear()
        h = _words[x] = xxhash.xxh32_intdigest(x)
    return h


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """Feature numbers of 64-bit values, another row of hashes for each salt."""
    x = (h.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def features(us: list[str], titles: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, number of features of each unit): distinct hashed features of a batch of units, digits masked."""
    numbers, owners = [], []

    def add(values: np.ndarray, owner: np.ndarray) -> None:
        numbers.append(values)
        owners.append(owner)

    lows, tokens, sizes, signs, sign_sizes, shape, flags = [], [], [], [], [], [], []
    for u, is_title in zip(us, titles):
        t = re.sub(r"\d+", "0", u)
        low = t.lower()
        words = _TOKENS.findall(low)
        lows.append(low)
        tokens += [1, *map(_hash, words), 2]
        sizes.append(len(words) + 2)
        found = _SIGNS.findall(t)
        signs += map(_hash, found)
        sign_sizes.append(len(found))
        n = len(words)
        shape.append((min(9, n // 3), 16 + len(set(words)) * 4 // max(1, n), 32 + 8 * bool(_COMMON.search(low)) + min(3, n // 4), 64 + n if is_title else 48))
        flags.append(is_title)
    every = np.arange(len(us))
    w, owner = np.array(tokens, dtype=np.uint64), np.repeat(every, sizes)
    word = w > 2
    add(_mixed(w[word], 1), owner[word])
    beside = owner[:-1] == owner[1:]
    add(_mixed((w[:-1] * np.uint64(0x100000001B3) + w[1:])[beside], 2), owner[:-1][beside])
    of_title = word & np.array(flags)[owner] if len(us) else word
    add(_mixed(w[of_title], 3), owner[of_title])
    add(_mixed(np.array(signs, dtype=np.uint64), 4), np.repeat(every, sign_sizes))
    add(_mixed(np.array(shape, dtype=np.uint64).ravel(), 5), np.repeat(every, 4))
    points = np.frombuffer("".join(lows).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    at = np.repeat(every, [len(x) for x in lows])
    if len(points) > 3:
        inside = at[:-3] == at[3:]
        grams = ((points[:-3] * np.uint64(1_000_003) + points[1:-2]) * np.uint64(1_000_003) + points[2:-1]) * np.uint64(1_000_003) + points[3:]
        add(_mixed(grams[inside], 6), at[:-3][inside])
    pairs = np.sort(np.concatenate(owners).astype(np.int64) << BITS | np.concatenate(numbers).astype(np.int64))
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    return pairs & ((1 << BITS) - 1), np.bincount(pairs >> BITS, minlength=len(us))


def train(rows: list[tuple[str, bool, int]]) -> np.ndarray:
    """Weights (features, kinds) from (unit, is_title, kind), kinds weighing alike; zeros without rows."""
    weights = np.zeros((1 << BITS, len(KINDS)))
    if not rows:
        return weights
    numbers, sizes = features([u for u, *_ in rows], [t for _, t, _ in rows])
    found = np.split(numbers, np.cumsum(sizes)[:-1])
    kinds = np.array([k for *_, k in rows])
    balance = np.sqrt(len(rows) / np.maximum(1, np.bincount(kinds, minlength=len(KINDS))))
    balance /= balance[kinds].mean()
    seen = np.full_like(weights, 1e-6)
    order = np.random.default_rng(7).permutation(len(rows))
    for _ in range(EPOCHS):
        for i in order:
            at = found[i]
            mine = weights[at]
            z = mine.sum(axis=0) / np.sqrt(len(at))
            p = np.exp(z - z.max())
            p /= p.sum()
            p[kinds[i]] -= 1
            g = balance[kinds[i]] * p / np.sqrt(len(at)) + L2 * mine
            s = seen[at] + g * g
            seen[at] = s
            weights[at] = mine - RATE * g / np.sqrt(s)
    return weights


def predict(weights: np.ndarray, us: list[str], titles: list[bool]) -> np.ndarray:
    """Probability of each kind for each unit; each has features."""
    if not us:
        return np.zeros((0, len(KINDS)))
    numbers, sizes = features(us, titles)
    z = np.add.reduceat(weights[numbers], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / np.sqrt(sizes)[:, None]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(FOLDS))


def fit(distinct: DataFrame, held_out: bool = False) -> np.ndarray:
    """Weights learnt from a bounded sample of each weak kind, with every weak sign in it as far as it goes; held_out: of units that other hosts than those of fold 0 show."""
    labelled = distinct.where("weak is not null" + (" and seen > 0" if held_out else ""))
    taken: list = []
    for k in range(len(KINDS)):
        for t in (True, False):
            kind = labelled.where((F.col("weak") == k) & (F.col("is_title") == t))
            drawn = kind.orderBy(F.xxhash64("masked"), "masked").limit(SAMPLE * (1 + (k == 0))).select("unit", "is_title", "weak").collect()
            if k == 0:
                drawn += kind.orderBy(F.desc("n"), "masked").limit(SAMPLE).select("unit", "is_title", "weak").collect()
            elif len(drawn) == SAMPLE:  # there may be more: none of the signs is left to chance
                rank = F.row_number().over(Window.partitionBy("sign").orderBy(F.desc("n"), F.xxhash64("masked"), "masked"))
                signs = kind.withColumn("rank", rank).where(F.col("rank") <= PER_SIGN).orderBy("rank", F.desc("n"), "masked").limit(SAMPLE).select("unit", "is_title", "weak").collect()
                drawn = list(dict.fromkeys(drawn + signs))
            taken += drawn
    return train([(r.unit, r.is_title, r.weak) for r in taken])


def judged(distinct: DataFrame, weights: np.ndarray) -> DataFrame:
    """distinct with kind and the confidence of the likeliest kind."""
    shared = distinct.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("struct<kind: int, confidence: double>")
    def kind(us: pd.Series, ts: pd.Series) -> pd.DataFrame:
        p = predict(shared.value, list(us), list(ts))
        best = np.where(p.max(axis=1) >= CONFIDENT, p.argmax(axis=1), 0) if len(p) else np.zeros(0)
        return pd.DataFrame({"kind": best.astype(np.int32), "confidence": p.max(axis=1).astype(np.float64)})

    return distinct.withColumn("k", kind("unit", "is_title")).select("*", "k.*").drop("k")


def unfit_fields(jobs: DataFrame, key: str = "id", text: str = "raw_text", title: str = "title", url: str = "source_url") -> DataFrame:
    """(key, field_name, residue, filler, error_share) of the fields that are cases."""
    parts = units(jobs, key, text, title, url)
    distinct = distinct_units(parts)
    odd = written(judged(distinct, fit(distinct)).where("kind > 0").select(F.xxhash64("masked").alias("h"), F.xxhash64("masked", F.lit(1)).alias("g"), "is_title", "kind"))
    small = F.broadcast(odd) if odd.limit(BROADCAST_UNITS + 1).count() <= BROADCAST_UNITS else odd
    masked = parts.select("key", "is_title", F.length("unit").alias("size"), _masked(F.col("unit")).alias("masked"))
    hashed = masked.select("key", "is_title", "size", F.xxhash64("masked").alias("h"), F.xxhash64("masked", F.lit(1)).alias("g"))
    hits = hashed.join(small, ["h", "g", "is_title"], "left")
    fields = hits.groupBy("key", "is_title").agg(
        F.count_if(F.col("kind") == 1).alias("residue"), F.count_if(F.col("kind") == 2).alias("filler"), (F.sum(F.when(F.col("kind") == 3, F.col("size")).otherwise(0)) / F.sum("size")).alias("error_share")
    )
    cases = fields.where((F.col("residue") > 0) | (F.col("filler") > 0) | (F.col("error_share") >= ERROR_SHARE))
    return cases.select(F.col("key").alias(key), F.when(F.col("is_title"), title).otherwise(text).alias("field_name"), "residue", "filler", "error_share")


def validation(jobs: DataFrame, key: str = "id", text: str = "raw_text", title: str = "title", url: str = "source_url") -> DataFrame:
    """(weak, kind, units): how a classifier that never saw the hosts of fold 0 judges the units that they show."""
    distinct = distinct_units(units(jobs, key, text, title, url))
    return judged(distinct.where("seen < n and weak is not null"), fit(distinct, held_out=True)).groupBy("weak", "kind").agg(F.sum(F.col("n") - F.col("seen")).alias("units"))
