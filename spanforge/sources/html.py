"""HTML scans: markup to text, titles, entities and job postings in JSON-LD, as JVM expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Entities known by name, elements without content text, and block elements.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "bull": "•", "middot": "·",
    "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“", "eacute": "é", "egrave": "è", "copy": "©", "amp": "&",
}
EMPTY = ("script", "style", "noscript", "template", "svg", "head")
BLOCKS = "p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|main|aside|nav|blockquote|dt|dd|dl|form|fieldset"


@F.pandas_udf(StringType())
def _numeric_entities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    pattern = regex.compile(r"&#(?:x([0-9a-f]{1,6})|(\d{1,7}));", regex.I)

    def char(m) -> str:
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else m[0]

    for texts in batches:
        yield texts.map(lambda t: t if t is None or "&#" not in t else pattern.sub(char, t))


def decode_entities(text: Column, numeric: bool = True) -> Column:
    """Hexadecimal, decimal and known named entities as characters, others left alone; numeric=False stays in the JVM."""
    out = _numeric_entities(text) if numeric else text
    for name, char in ENTITIES.items():
        out = F.regexp_replace(out, rf"(?i)&{name};", char)
    return out


def html_text(html: Column, numeric: bool = True) -> Column:
    """Visible text: no comments or content-less elements (unclosed ones reach to the end), blocks on lines, spaces collapsed."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for name in EMPTY:
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?(?:</{name}\s*>|$)", "")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCKS})\b[^>]*>", "\n")
    out = decode_entities(F.regexp_replace(out, r"<[^>]+>", " "), numeric)
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\x{00A0}]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def html_title(html: Column) -> Column:
    """The first title, tags as spaces, white space collapsed, at most 200 characters; null if there is none."""
    raw = F.regexp_replace(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1), r"<[^>]+>", " ")
    text = F.trim(F.regexp_replace(decode_entities(raw, numeric=False), r"\s+", " "))
    return F.nullif(F.substring(text, 1, 200), F.lit(""))


def job_posting(html: Column) -> Column:
    """(title, text) of the first JobPosting with a description in the page's JSON-LD; null if there is none.

    Broken blocks are skipped; root arrays and @graph are looked through in order.
    """
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script"), 1)
    node = "struct<`@type`:string,title:string,description:string,hiringOrganization:struct<name:string>,jobLocation:struct<address:struct<addressLocality:string>>,employmentType:string,qualifications:string,responsibilities:string,skills:string>"
    one = lambda b: F.array(F.from_json(b, node))
    many = lambda b: F.coalesce(F.from_json(b, f"array<{node}>"), F.array().cast(f"array<{node}>"))
    graph = lambda b: F.coalesce(F.from_json(b, f"struct<`@graph`:array<{node}>>").getField("@graph"), F.array().cast(f"array<{node}>"))
    nodes = F.flatten(F.transform(blocks, lambda b: F.when(F.ltrim(b).startswith("["), many(b)).otherwise(F.concat(one(b), graph(b)))))
    hit = F.get(F.filter(nodes, lambda n: (n.getField("@type") == "JobPosting") & (F.trim(n.description) != "")), 0)
    head = F.concat_ws("\n", hit.title, hit.hiringOrganization.getField("name"), F.nullif(F.concat_ws(" · ", hit.jobLocation.address.addressLocality, hit.employmentType), F.lit("")))
    text = F.concat_ws("\n\n", F.nullif(head, F.lit("")), html_text(hit.description), *[F.nullif(F.trim(x), F.lit("")) for x in (hit.qualifications, hit.responsibilities, hit.skills)])
    return F.when(hit.isNotNull(), F.struct(hit.title.alias("title"), text.alias("text")))


def page(html: Column) -> Column:
    """(title, text, source): the JSON-LD posting if there is one, else the markup; the title falls back to the markup's."""
    posting = job_posting(html)
    return F.struct(
        F.coalesce(posting.title, html_title(html)).alias("title"), F.coalesce(posting.text, html_text(html)).alias("text"), F.when(posting.isNotNull(), "json-ld").otherwise("markup").alias("source")
    )
