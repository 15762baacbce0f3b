"""Problem 9: evaluation texts leaking into training text.

Every window of SEED_RUN item words has a seed, its rarest n-gram in the corpus, so a
document that holds that many consecutive words of an item holds a seed of it: no
copy that keeps such a run is missed, however much is edited around it. Seeds join
documents to items; Smith-Waterman alignment over words scores the pairs, and the
longest run of equal consecutive words is counted in the same table.

Defined results: null, empty and short texts leak nothing; repeated rows give one
result per (document, item); an empty item table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.session import written

RUN = 12  # consecutive words that make a leak
SCORE = 20.0  # alignment score that makes an edited copy: ten equal words, or more with edits between them
SEED_RUN = 8  # consecutive words that a copy has to keep somewhere to be aligned
GRAM = 6  # words of a seed
CELLS = 200_000  # of one row of all tables that are filled side by side
BROADCAST_ROWS = 50_000  # item n-grams, seeds, or pairs up to which they are broadcast; more are joined by shuffle


def words(text: Column) -> Column:
    """Maximal runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def _grams(w: Column, n: int) -> Column:
    """(position, hash) of each run of n words, as an array."""
    last = F.size(w) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(w, i + 1, n)).alias("h"))))


def align(items: list[np.ndarray], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(Smith-Waterman scores, longest runs of equal consecutive words) of pairs of arrays of word numbers, side by side: match 2, mismatch -1, gap -1.

    Numbers are 0 or more; equal ones are equal words, negative ones equal nothing.
    """
    n, wide = len(items), max(map(len, docs), default=0)
    a = np.full((n, max(map(len, items), default=0)), -1, dtype=np.int32)
    b = np.full((n, wide), -2, dtype=np.int32)
    for k in range(n):
        a[k, : len(items[k])] = items[k]
        b[k, : len(docs[k])] = docs[k]
    row, runs = np.zeros((n, wide + 1), dtype=np.int32), np.zeros((n, wide + 1), dtype=np.int32)
    best, longest = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    gaps = np.arange(wide + 1, dtype=np.int32)
    for x in a.T:
        same = (b == x[:, None]) & (b >= 0)
        step = row - 1
        np.maximum(step[:, 1:], row[:, :-1] + np.where(same, np.int32(2), np.int32(-1)), out=step[:, 1:])
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + gaps, axis=1) - gaps  # the best of the cell and of gaps from its left
        new = np.zeros_like(runs)
        new[:, 1:] = (runs[:, :-1] + 1) * same
        runs = new
        np.maximum(best, row.max(axis=1), out=best)
        np.maximum(longest, runs.max(axis=1), out=longest)
    return best, longest


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def alignments(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, run: int = SEED_RUN, gram: int = GRAM) -> DataFrame:
    """(key, item, score, longest_run) of the documents that share a seed with an item, that is all that have `run` consecutive words of it."""
    docs = documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    tests = items.select(F.col(item).alias("item"), words(F.col(item_text)).alias("iw")).where(F.size("iw") >= run).dropDuplicates(["item"])
    placed = written(tests.select("item", F.inline(_grams(F.col("iw"), gram))))
    # the corpus is taken apart once; what it shares with the items is all that counts and pairs need
    split = docs.select("doc", words(F.col("text")).alias("w")).where(F.size("w") >= run)
    grams = split.select("doc", F.explode(F.array_distinct(F.transform(_grams(F.col("w"), gram), lambda g: g.h))).alias("h"))
    shared = written(grams.join(_sized(placed.select("h").distinct()), "h", "left_semi"))
    ranked = placed.join(shared.groupBy("h").count(), "h").select("item", "pos", "h", F.struct("count", "h", "pos").alias("rank"))
    # windows start at s and hold the grams s .. s + run - gram; a gram absent from the corpus rules its window out
    windows = ranked.select("item", "rank", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - (run - gram)), F.col("pos"))).alias("s"))
    whole = windows.groupBy("item", "s").agg(F.count("*").alias("n"), F.min("rank").alias("seed")).where(F.col("n") == run - gram + 1)
    seeds = written(whole.select("item", F.col("seed.h").alias("h")).distinct())
    pairs = written(shared.join(_sized(seeds), "h").select("doc", "item").distinct())
    asked = docs.join(_sized(pairs.select("doc").distinct()), "doc", "left_semi").distinct()
    texts = asked.select("doc", words(F.col("text")).alias("w")).join(pairs, "doc").join(_sized(tests), "item")

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            number: dict[str, int] = {}
            first = [np.array([number.setdefault(x, len(number)) for x in a], dtype=np.int32) for a in rows.iw]
            second = [np.array([number.get(x, -1) for x in b], dtype=np.int32) for b in rows.w]
            score, longest = np.zeros(len(rows)), np.zeros(len(rows), dtype=np.int32)
            order = sorted(range(len(rows)), key=lambda k: len(second[k]))
            at = 0
            while at < len(order):
                # pairs of like lengths side by side, fewer of long texts
                many = max(1, min(256, CELLS // (len(second[order[min(at + 255, len(order) - 1)]]) + 1)))
                part = order[at : at + many]
                score[part], longest[part] = align([first[k] for k in part], [second[k] for k in part])
                at += many
            yield pd.DataFrame({"doc": rows.doc, "item": rows["item"], "score": score, "longest_run": longest})

    types = dict(texts.dtypes)
    aligned = texts.select("doc", "item", "iw", "w").mapInPandas(scored, f"doc {types['doc']}, item {types['item']}, score double, longest_run int")
    best = aligned.groupBy("doc", "item").agg(F.max("score").alias("score"), F.max("longest_run").alias("longest_run"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item), "score", "longest_run")


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str, score: float = SCORE) -> DataFrame:
    """The alignments that score enough for a copy, whole, in part or edited; longest_run >= RUN is a verbatim leak."""
    return alignments(documents, key, text, items, item, item_text).where(F.col("score") >= score)
