"""Problem 2: bring text to one consistent form.

Lines that hold a code point with another form are exploded to positioned code
points, joined to a broadcast mapping (decomposition, combining class, script,
look-alike letters), ordered by combining class, recomposed and rebuilt. All
other lines are their own consistent form and never leave the scan.

Defined results: a null text stays null and has no lines; an empty text is
itself; repeated rows give one result per distinct (key, line).
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that look like a Latin letter, pair by pair.
CYRILLIC_ALIKE = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXaesijopcyxhdqw"
GREEK_ALIKE = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανοικρυχγϲϳ"
GREEK_LATIN = "ABEZHIKMNOPTYXavoikpuxycj"

# Compatibility forms that are no difference (tags of Unicode's decompositions).
KEPT_TAGS = ("<super>", "<sub>", "<fraction>", "<square>", "<circle>", "<vertical>", "<small>")
KEPT_SIGNS = "…‥․№™℠℡℻´¨¯¸˘˙˚˛˜˝ªº"
USUAL = "é§žαя—•№™☎"  # the quick class leaves out the calm runs around these
HYPHENS = "‐‑"
INVISIBLE_EXTRA = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0)


# Hangul letters that compose by rule, and the syllables in the order of that rule.
LEADS, VOWELS, FINALS = range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)
SYLLABLES = range(0xAC00, 0xD7A4)


def _script(cp: int) -> int:
    """1 Latin, 2 Greek, 3 Cyrillic, 0 any other; by the character's name."""
    if not unicodedata.category(chr(cp)).startswith("L"):
        return 0
    name = unicodedata.name(chr(cp), "")
    return 1 if "LATIN" in name else 2 if name.startswith("GREEK") else 3 if name.startswith("CYRILLIC") else 0


def _form(ch: str) -> str:
    """The fully decomposed consistent form of one character; '' if it is invisible."""
    cat, cp = unicodedata.category(ch), ord(ch)
    if cat == "Cf" or cp in INVISIBLE_EXTRA or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
        return ""
    if cat == "Zs":
        return " "
    if ch in HYPHENS:
        return "-"
    d = unicodedata.decomposition(ch)
    if not d or ch in KEPT_SIGNS or d.startswith(KEPT_TAGS):
        return ch
    if d.startswith("<compat>") and not (cat[0] == "L" or cat == "Nl"):
        return ch
    parts = d.split()
    return "".join(_form(chr(int(x, 16))) for x in (parts[1:] if parts[0].startswith("<") else parts))


@cache
def tables() -> tuple[list, dict, str, str]:
    """(mapping rows, composition pairs, class of characters to look at, quick class around it), from Unicode's own data.

    The mapping has one row for each assigned code point that has another form, a
    combining class or a Greek, Cyrillic or non-ASCII Latin script: its size is bound by
    Unicode (some 6,600 rows), not by the data.
    """
    rows, pairs, odd = [], {}, []
    alike = {**dict(zip(CYRILLIC_ALIKE, CYRILLIC_LATIN)), **dict(zip(GREEK_ALIKE, GREEK_LATIN))}
    to_cyrillic = dict(zip(reversed(CYRILLIC_LATIN), reversed(CYRILLIC_ALIKE)))
    to_greek = dict(zip(reversed(GREEK_LATIN), reversed(GREEK_ALIKE)))
    for cp in range(0x20, 0x323B0):
        if 0x3400 <= cp <= 0x9FFF or 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xF8FF or 0x20000 <= cp <= 0x2F7FF:
            continue
        ch = chr(cp)
        form, ccc, script = _form(ch), unicodedata.combining(ch), _script(cp)
        composed = unicodedata.normalize("NFC", form) if form else ""
        d = unicodedata.decomposition(ch)
        if d and d[0] != "<" and len(d.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
            a, b = (chr(int(x, 16)) for x in d.split())
            pairs[a + b] = ch
        if composed != ch or ccc or cp in VOWELS or cp in FINALS:
            odd.append(cp)
        if form != ch or ccc or script:
            parts = [(p, unicodedata.combining(p), _script(ord(p))) for p in form]
            rows.append((ch, [(p, c, s, alike.get(p), to_greek.get(p), to_cyrillic.get(p)) for p, c, s in parts]))
    odd = sorted({*odd, *(ord(p[1]) for p in pairs)}) + list(range(0xE0000, 0xE0080))
    spans, start = [], odd[0]
    for x, y in zip(odd, [*odd[1:], 0]):
        if y != x + 1:
            spans.append(rf"\x{{{start:x}}}-\x{{{x:x}}}")
            start = y
    known, calm, start = set(odd), [r"\x00-\x7e"], 0x80
    for x in (*sorted(x for x in known if 0x80 <= x < 0x3000), 0x3000):
        if any(start <= ord(c) < x for c in USUAL):
            calm.append(rf"\x{{{start:x}}}-\x{{{x - 1:x}}}")
        start = x + 1
    return rows, pairs, "[" + "".join(spans) + "]", "[^" + "".join(calm) + "]"


OTHER_SCRIPTS = r"[\u0370-\u052f\u1c80-\u1c8f\u1d26-\u1d2b\u1f00-\u1fff\u2de0-\u2dff\ua640-\ua69f]"
MIXED = r"[\p{IsLatin}]\p{M}*[\p{IsGreek}\p{IsCyrillic}]|[\p{IsGreek}\p{IsCyrillic}]\p{M}*\p{IsLatin}|\p{IsGreek}\p{M}*\p{IsCyrillic}|\p{IsCyrillic}\p{M}*\p{IsGreek}"
ROW = T.StructType([
    T.StructField("ch", T.StringType()),
    T.StructField("parts", T.ArrayType(T.StructType([
        T.StructField("p", T.StringType()), T.StructField("ccc", T.IntegerType()), T.StructField("script", T.IntegerType()),
        T.StructField("latin", T.StringType()), T.StructField("greek", T.StringType()), T.StructField("cyrillic", T.StringType()),
    ]))),
])


def suspect(text: Column, exactly: bool) -> Column:
    """Whether a text holds anything whose consistent form might differ; not exactly: a cheap test that errs to yes."""
    *_, odd, quick = tables()
    if not exactly:
        return text.rlike(quick) | text.rlike(OTHER_SCRIPTS)
    return (text.rlike(quick) & text.rlike(odd)) | (text.rlike(OTHER_SCRIPTS) & text.rlike(MIXED))


def _syllable(start: Column, p: Column) -> Column:
    """The Hangul syllable of a lead and a vowel, or of a syllable without a final and a final; null of others."""
    a, b = F.ascii(start), F.ascii(p)
    at = F.when(a.between(LEADS[0], LEADS[-1]) & b.between(VOWELS[0], VOWELS[-1]), ((a - LEADS[0]) * len(VOWELS) + b - VOWELS[0]) * (len(FINALS) + 1)).when(
        a.between(SYLLABLES[0], SYLLABLES[-1]) & b.between(FINALS[0], FINALS[-1]) & ((a - SYLLABLES[0]) % (len(FINALS) + 1) == 0), a - SYLLABLES[0] + b - FINALS[0] + 1
    )
    return F.substring(F.lit("".join(map(chr, SYLLABLES))), at + 1, F.lit(1))


def _composed(parts: Column, pairs: Column, seconds: str) -> Column:
    """Canonical composition of code points whose marks are in order: each joins the last starter unless blocked.

    A mark is blocked by one of its class or higher before it, a starter by anything
    before it; seconds are the starters that compose with the one before them.
    """
    state = F.struct(F.lit("").alias("done"), F.lit("").alias("start"), F.lit("").alias("tail"), F.lit(0).alias("last"))
    follows = F.lit(seconds + "".join(map(chr, (*VOWELS, *FINALS))))

    def step(s: Column, x: Column) -> Column:
        pair = F.try_element_at(pairs, F.concat(s.start, x.p))
        joined = F.when((x.ccc > 0) & (s.start != "") & ((s["last"] < x.ccc) | (s.tail == "")), pair).when(
            (x.ccc == 0) & (s.start != "") & (s.tail == "") & follows.contains(x.p), F.coalesce(pair, _syllable(s.start, x.p))
        )
        return (
            F.when(joined.isNotNull(), F.struct(s.done.alias("done"), joined.alias("start"), s.tail.alias("tail"), s["last"].alias("last")))
            .when(x.ccc == 0, F.struct(F.concat(s.done, s.start, s.tail).alias("done"), x.p.alias("start"), F.lit("").alias("tail"), F.lit(0).alias("last")))
            .otherwise(F.struct(s.done.alias("done"), s.start.alias("start"), F.concat(s.tail, x.p).alias("tail"), x.ccc.alias("last")))
        )

    return F.aggregate(parts, state, step, lambda s: F.concat(s.done, s.start, s.tail))


def consistent_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, form, doc): every line that differs from its consistent form, with that form.

    doc is a hash of the whole text. A `\\r` at the line's end belongs to the line
    break and is left alone. Lines are what lies between `\\n`, counted from 0.
    """
    spark = df.sparkSession
    rows, pairs, *_ = tables()
    mapping = F.broadcast(spark.createDataFrame(rows, ROW).coalesce(1))
    nothing = F.lit(None).cast("string")
    lines = (
        df.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .where(suspect(F.col("text"), False))
        .select("key", F.xxhash64("text").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .where(suspect(F.col("line"), True))
        .distinct()
    )
    same = ["key", "doc", "line_no", "line"]
    points = lines.select(*same, F.posexplode(F.split(F.regexp_replace("line", "\r$", ""), "")).alias("pos", "ch"))
    itself = F.array(F.struct(F.col("ch").alias("p"), F.lit(0).alias("ccc"), F.lit(0).alias("script"), nothing.alias("latin"), nothing.alias("greek"), nothing.alias("cyrillic")))
    gone = F.array(F.struct(F.lit("").alias("p"), F.lit(0).alias("ccc"), F.lit(0).alias("script"), nothing.alias("latin"), nothing.alias("greek"), nothing.alias("cyrillic")))
    parts = F.when(F.size("parts") == 0, gone).otherwise(F.coalesce("parts", itself))
    joined = points.join(mapping, "ch", "left").select(*same, "pos", F.posexplode(parts).alias("sub", "x")).select(*same, "pos", "sub", "x.*")
    so_far = Window.partitionBy(*same).orderBy("pos", "sub").rowsBetween(Window.unboundedPreceding, 0)
    numbered = joined.withColumns({
        "starter": F.sum(((F.col("ccc") == 0) & (F.col("p") != "")).cast("int")).over(so_far),
        "word": F.sum((~F.col("p").rlike(r"^[\p{L}\p{M}]?$")).cast("int")).over(so_far),
    })
    word = Window.partitionBy(*same, "word")
    has = lambda s: F.max((F.col("script") == s).cast("int")).over(word)
    lacks = lambda s, c: F.max(((F.col("script") != s) & (F.col("script") > 0) & F.col(c).isNull()).cast("int")).over(word)
    fixed = numbered.withColumns({"scripts": has(1) + has(2) + has(3), "no1": lacks(1, "latin"), "no2": lacks(2, "greek"), "no3": lacks(3, "cyrillic")}).withColumn(
        "q",
        F.when(F.col("scripts") < 2, F.col("p"))
        .when((F.col("no1") == 1) & (F.col("no3") == 0), F.coalesce("cyrillic", "p"))
        .when((F.col("no1") == 1) & (F.col("no2") == 0), F.coalesce("greek", "p"))
        .otherwise(F.coalesce("latin", "p")),
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("starter", "ccc", "pos", "sub", F.col("q").alias("p")))), lambda x: F.struct(x.p.alias("p"), x.ccc.alias("ccc")))
    seconds = "".join(sorted({p[1] for p in pairs if not unicodedata.combining(p[1])}))
    pair = F.from_json(F.lit(json.dumps(pairs, ensure_ascii=False)), T.MapType(T.StringType(), T.StringType()))
    return (
        fixed.groupBy(*same).agg(ordered.alias("parts"))
        .select(*same, _composed(F.filter("parts", lambda x: x.p != ""), pair, seconds).alias("body"))
        .withColumn("form", F.when(F.col("line").endswith("\r"), F.concat("body", F.lit("\r"))).otherwise(F.col("body")))
        .where(F.col("form") != F.col("line"))
        .select(F.col("key").alias(key), "line_no", "line", "form", "doc")
    )


def consistent_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """df with the text column in its consistent form; rows, order of lines and all other columns stay."""
    new = consistent_lines(df, key, text).groupBy(F.col(key).alias("__key"), F.col("doc").alias("__doc")).agg(F.map_from_entries(F.collect_list(F.struct("line_no", "form"))).alias("__forms"))
    on = F.col(key).eqNullSafe(F.col("__key")) & (F.xxhash64(F.col(text)) == F.col("__doc"))
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.coalesce(F.try_element_at(F.col("__forms"), i), x))
    return df.join(new, on, "left").withColumn(text, F.when(F.col("__forms").isNull(), F.col(text)).otherwise(F.array_join(lines, "\n"))).drop("__key", "__doc", "__forms")
