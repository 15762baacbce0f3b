"""Document files: dispatch by format, DOCX text, density gates, and a content-addressed store."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanforge.functions.text import letters_and_digits
from spanforge.sources.html import html_text

FORMATS = ("docx", "html", "htm")
SPARSE = 100  # letters and digits below which a document may be a scan


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, sha256, extension) of binary files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content", F.sha2("content", 256).alias("sha256"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"))


@F.pandas_udf(StringType())
def docx_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Paragraphs of a DOCX file's bytes, one a line; null for bytes that are no DOCX."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def text(content: bytes | None) -> str | None:
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
        except (TypeError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
            return None
        parts = {f"{w}tab": "\t", f"{w}br": "\n", f"{w}cr": "\n"}
        return "\n".join("".join(n.text or "" if n.tag == f"{w}t" else parts.get(n.tag, "") for n in p.iter()) for p in root.iter(f"{w}p"))

    for contents in batches:
        yield contents.map(text)


def extracted(files: DataFrame) -> DataFrame:
    """files with text; rows of other formats get the reason `unsupported_format` and no text."""
    docx = files.where("extension = 'docx'").withColumn("text", docx_text("content"))
    html = files.where("extension in ('html', 'htm')").withColumn("text", html_text(F.decode("content", "UTF-8")))
    other = files.where(~F.col("extension").isin(*FORMATS)).withColumn("text", F.lit(None).cast("string"))
    return docx.unionByName(html).unionByName(other).withColumn("reason", F.when(~F.col("extension").isin(*FORMATS), "unsupported_format"))


def judged(text: Column, base: float, language: Column) -> Column:
    """(status, confidence, reason) of a parsed text: failed when empty, needs attention when sparse or not English.

    base is the confidence of the parser; language is null where it is undetermined.
    """
    n = letters_and_digits(text)
    out = lambda s, c, r: F.struct(F.lit(s).alias("status"), F.lit(c).alias("confidence"), F.lit(r).cast("string").alias("reason"))
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, out("failed", 0.0, "no_text"))
        .when(n < SPARSE, out("needs_attention", 0.2, "low_text_density_possible_scan"))
        .when(language.isNull(), out("needs_attention", base * 0.5, "language_undetermined"))
        .when(language == "mixed", out("needs_attention", base * 0.5, "mixed_language_content"))
        .when(language != "en", out("needs_attention", base, "non_english_language_not_supported"))
        .otherwise(out("ok", base, None))
    )


def store(files: DataFrame, path: str) -> None:
    """Add files to a store keyed by content: empty contents are refused, known ones skipped, so a second run adds nothing."""
    spark = files.sparkSession
    new = files.where(F.length("content") > 0).dropDuplicates(["sha256"]).select("sha256", "content")
    try:
        known = spark.read.parquet(path).select("sha256")
        new = new.join(known, "sha256", "left_anti")
    except Exception as e:  # the store does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """The file of one hash; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col("sha256") == sha256)
