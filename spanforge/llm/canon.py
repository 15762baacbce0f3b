"""Problem 5: map freely typed values to a reference list.

A symmetric-delete dictionary of the reference list (each surface with up to
`radius(length)` letters deleted) is broadcast; a typed value reaches every
surface within that many edits by its own deletes. Hits are ranked by weighted
Damerau-Levenshtein distance, then by how often the typed values mean the entry
exactly, then by id. Values without a hit are reported. Each distinct value is looked
up once and joined back. A reference list beyond BROADCAST_SURFACES is not broadcast:
the deletes of both sides are tables then and meet by a shuffled join, with the same
result.

Surfaces of up to four letters are codes, which have to be exact: at that length one
edit leads from one code to another.

Defined results: null, empty and wrapper-only values are unmatched; repeated rows
are mapped one by one; an empty reference list leaves everything unmatched.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNMATCHED = "unmatched"
BROADCAST_SURFACES = 20_000  # up to it the dictionary is broadcast; the deletes of a longer list are joined by shuffle
REORDERED = 0.2  # cost of another order of words
TRIMMED = 0.05  # cost of leaving out words around the value
SURE = 0.5  # cost up to which an equal spelling is taken without looking for others

# Words around a skill that say how well or how much, not what.
AROUND = frozenset(
    "a an and or the of with in on at for to basic advanced intermediate beginner expert senior junior good solid strong sound deep proven some any very well first hands "
    "working practical daily regular use using usage experience experienced exposure knowledge knowing know understanding grasp command confident confidence familiar familiarity "
    "proficiency proficient fluent skilled skill skills level years year yrs least must plus etc similar equivalent related preferred required desirable optional version ver rel release v x".split()
)


def folded(value: str) -> str:
    """Lower case without accents, signs as spaces."""
    s = unicodedata.normalize("NFKD", value.casefold())
    return re.sub(r"[\W_]+", " ", "".join(c for c in s if not unicodedata.combining(c))).strip()


HEAD = 9  # letters whose deletes are kept: texts within k edits have heads that k deletes on either side make equal


def radius(length: int) -> int:
    """Edits allowed for a surface of so many letters: short codes have to be exact."""
    return 0 if length < 5 else 1 if length < 6 else 2 if length < 10 else 3


@lru_cache(50_000)
def deletes(s: str, most: int) -> frozenset[str]:
    """s with up to `most` letters deleted."""
    out = {s}
    for k in range(1, min(most, len(s) - 1) + 1):
        for gone in combinations(range(len(s)), k):
            out.add("".join(c for i, c in enumerate(s) if i not in gone))
    return frozenset(out)


def distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein: swapped neighbours and doubled letters 0.7, a changed first letter 1.3, else 1. Beyond `most`: inf."""
    if abs(len(a) - len(b)) > most / 0.7:
        return float("inf")
    before, row = [], [0.0]
    for j in range(1, len(b) + 1):
        row.append(row[-1] + (0.7 if j > 1 and b[j - 1] == b[j - 2] else 1))
    for i in range(1, len(a) + 1):
        older, before = before, row
        out = 0.7 if i > 1 and a[i - 1] == a[i - 2] else 1
        row = [before[0] + out]
        for j in range(1, len(b) + 1):
            same = a[i - 1] == b[j - 1]
            into = 0.7 if j > 1 and b[j - 1] == b[j - 2] else 1
            d = min(before[j - 1] + (0 if same else 1.3 if i == j == 1 else 1), before[j] + out, row[j - 1] + into)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and not same:
                d = min(d, older[j - 2] + 0.7)
            row.append(d)
        if min(row) > most and (not before or min(before) > most):
            return float("inf")
    return row[-1] if row[-1] <= most else float("inf")


def edits(a: str, b: str, most: int) -> int:
    """Plain Damerau-Levenshtein distance (swapped neighbours are one edit); most + 1 if it is larger."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before = before, row
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(before[j - 1] + (x != y), before[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def near(form: str, surface: str) -> float:
    """Weighted distance of a form and a surface if neither it nor the number of edits passes the surface's radius, else inf."""
    most = radius(len(surface))
    d = distance(form, surface, most)
    return d if d <= most and edits(form, surface, most) <= most else float("inf")


def spellings(surface: str) -> list[tuple[str, float]]:
    """The squashed spellings that a surface is indexed by, each with its extra cost: as it is and with its words sorted."""
    words = folded(surface).split()
    return list({"".join(sorted(words)): REORDERED, "".join(words): 0.0}.items()) if words else []


def forms(value: str, known: frozenset[str] | set[str]) -> list[tuple[str, float]]:
    """The squashed spellings of a value to look up, each with its extra cost; words of the reference list are never words around."""
    words = folded(value).split()
    core = [w for w in words if (w not in AROUND or w in known) and not re.fullmatch(r"v?\d+", w)]
    out = {"".join(sorted(core)): REORDERED}
    for k in range(1, len(core)):
        out["".join(core[k:] + core[:k])] = REORDERED
    out["".join(core)] = TRIMMED
    out["".join(words)] = 0.0
    return [(s, c) for s, c in out.items() if s]


class Dictionary:
    """Symmetric-delete lookup of surfaces; surfaces: [(surface, entry id, frequency)]."""

    def __init__(self, surfaces: list[tuple[str, str, int]]):
        self.entries: dict[str, list[tuple[float, int, str]]] = defaultdict(list)
        for surface, entry, n in surfaces:
            for spelling, extra in spellings(surface):
                self.entries[spelling].append((extra, -n, entry))
        self.words = {w for s, _, _ in surfaces for w in folded(s).split()}
        self.by_delete: dict[str, list[str]] = defaultdict(list)
        for s in self.entries:
            for d in deletes(s[:HEAD], radius(len(s))):
                self.by_delete[d].append(s)

    def find(self, value: str | None) -> tuple[str, float]:
        """(entry id, distance), or (unmatched, inf)."""
        best = (float("inf"), 0, UNMATCHED)
        looked = forms(value or "", self.words)
        for form, cost in looked:
            if form in self.entries:
                best = min(best, *((cost + extra, n, e) for extra, n, e in self.entries[form]))
        if best[0] < SURE:
            return best[2], best[0]
        for form, cost in looked:
            hits = {s for d in deletes(form[:HEAD], radius(len(form) + 3)) for s in self.by_delete.get(d, ()) if abs(len(s) - len(form)) <= radius(len(s))}
            for s in hits:
                d = near(form, s)
                if d != float("inf"):
                    best = min(best, *((cost + extra + d, n, e) for extra, n, e in self.entries[s]))
        return best[2], best[0]


def _by_broadcast(typed: DataFrame, listed: list[tuple[str, str, int]]) -> DataFrame:
    """(typed, mapped_id, mapped_distance) of distinct values, by a dictionary that each worker builds once."""
    shared = typed.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dictionary = None
        for rows in batches:
            dictionary = dictionary or Dictionary(shared.value)
            found = [dictionary.find(v) for v in rows.typed]
            yield pd.DataFrame({"typed": rows.typed, "mapped_id": [e for e, _ in found], "mapped_distance": [None if d == float("inf") else d for _, d in found]})

    return typed.mapInPandas(run, "typed string, mapped_id string, mapped_distance double")


def _by_shuffle(typed: DataFrame, surfaces: DataFrame, often: DataFrame) -> DataFrame:
    """The same by joins: the deletes of the values meet those of the surfaces; surfaces: (surface, entry), often: (entry, n)."""

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(d, s, extra, e) for surface, e in zip(rows.surface, rows.entry) for s, extra in spellings(surface) for d in deletes(s[:HEAD], radius(len(s)))]
            yield pd.DataFrame(out, columns=["gone", "spelling", "extra", "entry"])

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"word": sorted({w for s in rows.surface for w in folded(s).split()} & AROUND)}, dtype=object)

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(v, f, c, d) for v in rows.typed for f, c in forms(v, known) for d in deletes(f[:HEAD], radius(len(f) + 3))]
            yield pd.DataFrame(out, columns=["typed", "form", "cost", "gone"])

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["d"] = [near(f, s) if f != s else 0.0 for f, s in zip(rows.form, rows.spelling)]
            rows["mapped_distance"] = rows.cost + rows.extra + rows.d
            rows = rows[rows.d != float("inf")]
            yield rows[["typed", "entry", "n", "mapped_distance"]]

    # only the words that could be words around matter, so this set is bounded by that list
    known = frozenset(r.word for r in surfaces.mapInPandas(words_of, "word string").distinct().collect())
    index = surfaces.mapInPandas(indexed, "gone string, spelling string, extra double, entry string").distinct()
    queries = typed.where("typed is not null").mapInPandas(asked, "typed string, form string, cost double, gone string")
    pairs = queries.join(index, "gone").select("typed", "form", "cost", "spelling", "extra", "entry").distinct().join(often, "entry", "left")
    hits = pairs.select("typed", "form", "cost", "spelling", "extra", "entry", F.coalesce("n", F.lit(0)).alias("n")).mapInPandas(measured, "typed string, entry string, n long, mapped_distance double")
    best = hits.groupBy("typed").agg(F.min(F.struct("mapped_distance", (-F.col("n")).alias("n"), "entry")).alias("b")).select("typed", F.col("b.entry").alias("mapped_id"), F.col("b.mapped_distance").alias("mapped_distance"))
    return typed.join(best, "typed", "left").select("typed", F.coalesce("mapped_id", F.lit(UNMATCHED)).alias("mapped_id"), "mapped_distance")


def mapped(df: DataFrame, value: str, reference: DataFrame, entry: str = "id", label: str = "label", aliases: str = "aliases", broadcast_surfaces: int = BROADCAST_SURFACES) -> DataFrame:
    """df with mapped_id (an entry of the reference, or `unmatched`) and mapped_distance (null if unmatched).

    The surfaces of the reference list are counted first: up to broadcast_surfaces they
    go to the workers as a dictionary, more are joined by shuffle.
    """
    surfaces = reference.select(F.col(entry).alias("entry"), F.explode(F.concat(F.array(label), F.coalesce(F.col(aliases), F.array().cast("array<string>")))).alias("surface")).where("surface is not null")
    key = F.lower(F.trim(F.col(value)))
    typed = df.where(F.col(value).isNotNull()).groupBy(key.alias("typed")).count()
    # few bytes but much work a value: as many tasks as the cluster's shuffles have, which AQE leaves alone
    spread = typed.select("typed").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "typed")
    often = typed.join(surfaces.withColumn("typed", F.lower(F.trim("surface"))).distinct(), "typed").groupBy("entry").agg(F.sum("count").alias("n"))
    listed = surfaces.limit(broadcast_surfaces + 1).collect()
    if len(listed) <= broadcast_surfaces:
        n = {r.entry: r.n for r in often.collect()}
        found = _by_broadcast(spread, [(r.surface, r.entry, n.get(r.entry, 0)) for r in listed])
    else:
        found = _by_shuffle(spread, surfaces, often)
    found = found.withColumnsRenamed({"typed": "__typed", "mapped_id": "__id", "mapped_distance": "__distance"})
    joined = df.join(found, key == F.col("__typed"), "left")
    return joined.withColumns({"mapped_id": F.coalesce("__id", F.lit(UNMATCHED)), "mapped_distance": F.col("__distance")}).drop("__typed", "__id", "__distance")


def misses(mapped_rows: DataFrame, value: str) -> DataFrame:
    """(folded value, occurrences) of the values that mean no entry, most frequent first in meaning, unordered in place."""
    return mapped_rows.where(F.col("mapped_id") == UNMATCHED).groupBy(F.lower(F.trim(F.col(value))).alias("typed")).agg(F.count("*").alias("occurrences"))
