"""Problem 6: near-duplicate records with small edits.

Every text becomes a fingerprint: its distinct word shingles, hashed. The fingerprint
is embedded as bit counts of SEGMENTS equal parts of the hash space; the Manhattan
distance of two embeddings is a lower bound of the shingles that only one has, and a
similarity of t allows at most (1 - t) / (1 + t) of all. The total count is a grid:
pairs can only lie in the same or the next cell. As that grid alone is nearly blind
at a similarity of 0.6 (see README), cells are joined together with min-hash bands;
the embedding then rules out what the bands brought by chance, and the words of the
rest are compared exactly.

Texts are told apart by two 64-bit hashes. The first alone names a text while pairs
are sought; texts that share it are told apart again before words are compared, so a
collision costs work and never makes a pair. A text that many rows hold is sketched
once a task. `links` gives one row a pair of different texts and `memberships` one row
a record with its class of exact copies; `similar_pairs` expands both to records.

Defined results: null, empty and short texts (under MIN_WORDS words) have no
partners; repeated rows of one id count once; ids with one text are partners.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.session import written

SHINGLE = 3
MIN_WORDS = 20
SIMILARITY = 0.6
SEGMENTS = 128
BUCKET = 1_000  # docs that one salt of a crowded bucket holds
BANDS, ROWS = 50, 5  # a pair of similarity 0.6 shares a band with probability 0.983, one of 0.65 with 0.998, one of 0.15 with 0.004

WORD = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = _rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits in lower case."""
    return WORD.findall((text or "").lower())


class Sketcher:
    """Fingerprints, embeddings and band keys of texts; remembers the hashes of words."""

    def __init__(self, shingle: int, min_words: int):
        self.shingle, self.min_words, self.known = shingle, min_words, {}

    def fingerprint(self, text: str | None) -> np.ndarray | None:
        """Distinct shingle hashes, or None of a short text."""
        found = words(text)
        if len(found) < max(self.min_words, self.shingle):
            return None
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in found:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        h = np.array([known[w] for w in found], dtype=np.uint64)
        n = len(h) - self.shingle + 1
        mixed = np.zeros(n, dtype=np.uint64)
        for k in range(self.shingle):
            mixed = (mixed ^ h[k : k + n]) * _MIX[k]
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)

    def sketch(self, text: str | None) -> tuple[int, bytes, list[int]] | None:
        """(number of shingles, segment counts, band keys)."""
        prints = self.fingerprint(text)
        if prints is None:
            return None
        counts = np.minimum(np.bincount((prints >> np.uint64(57)).astype(np.int64), minlength=SEGMENTS), 255).astype(np.uint8)
        low = (prints ^ (prints >> np.uint64(32))).astype(np.uint32)
        mins = np.empty(BANDS * ROWS, dtype=np.uint32)
        for k in range(0, len(mins), 50):
            v = low[None, :] * _MULTIPLY[k : k + 50, None]
            mins[k : k + 50] = (v ^ (v >> np.uint32(15))).min(axis=1)
        keys = np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            keys = (keys ^ mins[k::ROWS].astype(np.uint64)) * _MIX[k]
            keys ^= keys >> np.uint64(31)
        return len(prints), counts.tobytes(), keys.view(np.int64)


def sketches(df: DataFrame, key: str, text: str, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, doc, check, n, counts, keys) of every row whose text is long enough; doc and check are hashes of the text.

    counts and keys are null where the task had the text before, so a text stored under
    any number of ids has at most one sketch for each task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher = Sketcher(shingle, min_words)
        seen: dict[tuple[int, int], int] = {}  # what one task reads is bounded by its partition
        for rows in batches:
            out = []
            for i, d, c, t in zip(rows.id, rows.doc, rows.check, rows.text):
                n = seen.get((d, c))
                if n is None:
                    found = sketcher.sketch(t)
                    n = seen[d, c] = found[0] if found else 0
                    if found:
                        out.append((i, d, c, n, found[1], found[2]))
                elif n:
                    out.append((i, d, c, n, None, None))
            yield pd.DataFrame(out, columns=["id", "doc", "check", "n", "counts", "keys"])

    rows = df.select(F.col(key).alias("id"), F.xxhash64(text).alias("doc"), F.xxhash64(F.lit(1), text).alias("check"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, doc long, check long, n int, counts binary, keys array<long>")


def candidates(table: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the docs that share a band and a grid cell or lie in neighbouring cells, a < b."""
    step = float(-np.log(similarity)) or 1.0
    members = table.where("keys is not null").select("doc", F.floor(F.log(F.col("n").cast("double")) / step).cast("int").alias("cell"), F.explode("keys").alias("key"))
    buckets = members.repartition("key").groupBy("key", "doc").agg(F.first("cell").alias("cell")).groupBy("key").agg(F.count("*").alias("size"), F.min_by(F.struct("doc", "cell"), "doc").alias("x"), F.max_by(F.struct("doc", "cell"), "doc").alias("y")).where("size > 1")
    buckets = written(buckets)
    two = buckets.where("size = 2").where(F.abs(F.col("x.cell") - F.col("y.cell")) <= 1).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
    # buckets of more: joined with themselves by cell, the larger ones salted, so that no task has more than BUCKET docs to hold against the rest of theirs
    salts = F.ceil(F.col("size") / BUCKET).cast("int")
    crowded = members.join(buckets.where("size > 2").select("key", salts.alias("salts")), "key").distinct()
    near = F.explode(F.array("cell", F.col("cell") - 1, F.col("cell") + 1))
    left = crowded.select("key", F.col("doc").alias("a"), near.alias("cell"), "salts").select("key", "a", "cell", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = crowded.select("key", F.col("doc").alias("b"), "cell", F.pmod("doc", "salts").cast("int").alias("salt"))
    more = left.join(right, ["key", "cell", "salt"]).where("a < b").select("a", "b")
    return two.unionByName(more).distinct()


def within_bound(pairs: DataFrame, table: DataFrame, similarity: float) -> DataFrame:
    """(a, check_a, b, check_b): the pairs of texts whose embeddings leave the similarity possible."""
    docs = table.where("keys is not null").groupBy("doc", "check").agg(F.first(F.struct("n", "counts")).alias("s")).select("doc", "check", "s.*")
    side = lambda x: docs.select(F.col("doc").alias(x), F.col("check").alias(f"check_{x}"), F.col("n").alias(f"n{x}"), F.col("counts").alias(f"c{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    allowed = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                x, y = (np.frombuffer(b"".join(rows[c]), dtype=np.uint8).reshape(-1, SEGMENTS).astype(np.int16) for c in ("ca", "cb"))
                rows = rows[np.abs(x - y).sum(axis=1) <= allowed * (rows.na + rows.nb).to_numpy() + 1e-9]
            yield rows[["a", "check_a", "b", "check_b"]]

    return joined.mapInPandas(run, "a long, check_a long, b long, check_b long")


def links(df: DataFrame, table: DataFrame, text: str, similarity: float, shingle: int) -> DataFrame:
    """(a, check_a, b, check_b, similarity) of all pairs of different texts that are similar, compared word by word."""
    near = written(within_bound(candidates(table, similarity), table, similarity))
    asked = near.select(F.explode(F.array(F.struct(F.col("a").alias("doc"), F.col("check_a").alias("check")), F.struct(F.col("b").alias("doc"), F.col("check_b").alias("check")))).alias("x")).select("x.*").distinct()
    texts = df.select(F.xxhash64(text).alias("doc"), F.xxhash64(F.lit(1), text).alias("check"), F.col(text).alias("text")).join(asked, ["doc", "check"]).dropDuplicates(["doc", "check"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def shingles(t: str) -> set:
            w = words(t)
            return {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)}

        for rows in batches:
            found = []
            for x, y in zip(rows.x, rows.y):
                p, q = shingles(x), shingles(y)
                both = len(p & q)
                found.append(both / (len(p) + len(q) - both))
            out = rows[["a", "check_a", "b", "check_b"]].assign(similarity=np.array(found, dtype=np.float64))
            yield out[out.similarity >= similarity]

    side = lambda d, t: texts.select(F.col("doc").alias(d), F.col("check").alias(f"check_{d}"), F.col("text").alias(t))
    pairs = near.join(side("a", "x"), ["a", "check_a"]).join(side("b", "y"), ["b", "check_b"])
    return pairs.select("a", "check_a", "b", "check_b", "x", "y").mapInPandas(run, "a long, check_a long, b long, check_b long, similarity double")


def similar_pairs(df: DataFrame, key: str, text: str, similarity: float = SIMILARITY, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """(id_a, id_b, similarity) of all pairs of different ids whose texts are similar, id_a < id_b; copies are expanded, too."""
    table = written(sketches(df, key, text, shingle, min_words))
    members = table.select("id", "doc", "check").distinct()
    side = lambda d, i: members.select(F.col("doc").alias(d), F.col("check").alias(f"check_{d}"), F.col("id").alias(i))
    between = links(df, table, text, similarity, shingle).join(side("a", "i"), ["a", "check_a"]).join(side("b", "j"), ["b", "check_b"]).select("i", "j", "similarity")
    copies = members.withColumnRenamed("id", "i").join(members.withColumnRenamed("id", "j"), ["doc", "check"]).where("i < j").select("i", "j", F.lit(1.0).alias("similarity"))
    rows = between.where("i <> j").unionByName(copies).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"), "similarity")
    return rows.groupBy("id_a", "id_b").agg(F.max("similarity").alias("similarity"))


def memberships(df: DataFrame, key: str, text: str, similarity: float = SIMILARITY, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, class_id, copies, links): each record of a long enough text with the smallest id that holds the same text, how many ids hold it, and how many different texts are similar to it.

    The result grows with the records, whatever the number of copies: no pairs of copies are made.
    """
    table = written(sketches(df, key, text, shingle, min_words))
    members = table.select("id", "doc", "check").distinct()
    classes = members.groupBy("doc", "check").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    found = links(df, table, text, similarity, shingle)
    ends = found.select(F.explode(F.array(F.struct(F.col("a").alias("doc"), F.col("check_a").alias("check")), F.struct(F.col("b").alias("doc"), F.col("check_b").alias("check")))).alias("x")).select("x.*")
    counted = classes.join(ends.groupBy("doc", "check").agg(F.count("*").alias("links")), ["doc", "check"], "left")
    return members.join(counted, ["doc", "check"]).select(F.col("id").alias(key), "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
