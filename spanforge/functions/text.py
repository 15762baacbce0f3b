"""Scalar functions on text, all inside the JVM. Offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INVISIBLE = r"[\p{Cf}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{034F}\x{180E}]"
SPACE = r"[\s\x{00A0}\x{FEFF}]"
BULLET = r"^(?:[-*•]|\d+[.)])\s+"


def normalize_term(term: Column) -> Column:
    """Lower case, trimmed, white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(term), rf"{SPACE}+", " "))


def strip_invisible(text: Column) -> Column:
    """text without format characters, variation selectors and joiners; spaces and combining marks stay."""
    return F.regexp_replace(text, INVISIBLE, "")


def visible_positions(text: Column) -> Column:
    """Array of the original positions of the characters that strip_invisible keeps."""
    chars = F.transform(F.split(text, ""), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    return F.transform(F.filter(chars, lambda x: (F.length(x.c) > 0) & ~x.c.rlike(f"^{INVISIBLE}$")), lambda x: x.i)


def letters(text: Column) -> Column:
    """Number of letters."""
    return F.regexp_count(text, F.lit(r"\p{L}"))


def letters_and_digits(text: Column) -> Column:
    """Number of letters and digits."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))


def words(text: Column) -> Column:
    """Lower-case runs of letters and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}']+"), 0)


def bearing_text(text: Column) -> Column:
    """text without tokens that bear no language: mail and web addresses, digits, acronyms, dotted or slashed names."""
    token = F.filter(F.split(text, rf"{SPACE}+"), lambda t: (F.length(t) > 0) & ~(t.rlike(r"@|://|^www\.") | t.rlike(r"\p{N}") | t.rlike(r"^[^\p{L}]*\p{Lu}{2,}[^\p{L}]*$") | t.rlike(r"[\p{L}\p{N}][./][\p{L}\p{N}]")))
    return F.array_join(token, " ")


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the non-empty matches of a pattern, by the lengths of the gaps between them."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s.at + F.length(x["0"])
        end = start + F.length(x["1"])
        return F.struct(end.alias("at"), F.concat(s.out, F.array(F.struct(start.alias("start"), end.alias("end"), x["1"].alias("value")))).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(values)), values)
    pairs = F.transform(pairs, lambda x: F.struct(x["0"].alias("0"), x["1"].alias("1")))
    return F.aggregate(pairs, state, step, lambda s: s.out)


def pieces(text: Column, separator: str) -> Column:
    """Array of (start, end, text) of what lies between matches of a separator; blank pieces are left out."""
    gaps, seps = F.split(text, separator, -1), F.regexp_extract_all(text, F.lit(separator), 0)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        end = s.at + F.length(x.g)
        return F.struct((end + F.coalesce(F.length(x.s), F.lit(0))).alias("at"), F.concat(s.out, F.array(F.struct(s.at.alias("start"), end.alias("end"), x.g.alias("text")))).alias("out"))

    both = F.transform(F.arrays_zip(gaps, seps), lambda x: F.struct(x["0"].alias("g"), x["1"].alias("s")))
    return F.filter(F.aggregate(both, state, step, lambda s: s.out), lambda x: F.trim(x.text) != "")


def paragraphs(text: Column) -> Column:
    """pieces between line breaks."""
    return pieces(text, r"\n+")


def sentences(text: Column) -> Column:
    """pieces between line breaks and the white space behind . ! ?"""
    return pieces(text, r"\n+|(?<=[.!?])\s+")


def line_segments(text: Column) -> Column:
    """Array of (start, end, text, is_bullet) of the non-blank lines, trimmed, bullets stripped of their mark."""
    def trimmed(x: Column) -> Column:
        lead = F.length(F.regexp_extract(x.text, rf"^{SPACE}*", 0))
        body = F.regexp_replace(F.regexp_replace(x.text, rf"^{SPACE}+", ""), rf"{SPACE}+$", "")
        mark = F.when(x.text.rlike(BULLET), F.length(F.regexp_extract(x.text, BULLET, 0))).otherwise(F.lit(0))
        start = x.start + F.greatest(lead, mark)
        rest = F.when(mark > 0, F.substring(body, mark - lead + 1, 1_000_000_000)).otherwise(body)
        return F.struct(start.alias("start"), (start + F.length(rest)).alias("end"), rest.alias("text"), (mark > 0).alias("is_bullet"))

    return F.filter(F.transform(pieces(text, r"\n"), trimmed), lambda x: x.text != "")


def span_holds(text: Column, start: Column, end: Column, value: Column) -> Column:
    """Whether 0 <= start < end <= length and the text there is the value, but for case."""
    return (start >= 0) & (start < end) & (end <= F.length(text)) & (F.lower(F.substr(text, start + 1, end - start)) == F.lower(value))


def slug(url: Column) -> Column:
    """Host and last path segment in lower case, other runs as dashes, at most 80 characters; `job` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z]+://", ""), r"[?#].*$", "")
    host, last = F.regexp_extract(bare, r"^([^/]*)", 1), F.regexp_extract(bare, r"/([^/]+)/?$", 1)
    text = F.regexp_replace(F.regexp_replace(F.concat_ws("-", host, last), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(text, 1, 80), F.lit("")), F.lit("job"))


def plain_number(value: Column) -> Column:
    """A number as people write it: 3 rather than 3.0."""
    return F.regexp_replace(F.format_string("%.1f", value.cast("double")), r"\.0$", "")
