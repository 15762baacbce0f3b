"""The language gate: segments of a text and the words that tell them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.text import bearing_text, paragraphs, sentences, words

LEAST_WORDS = 8
SEGMENT_WORDS = 15
LEAST_HITS = 2
# Common words that belong to one of the languages; used to tell the nearest by votes.
VOTES = {
    "en": "the and of to with for that this was were from have has been their which",
    "de": "der die und das mit für von ist nicht auf ein eine den dem zu bei",
    "fr": "le les des est pour dans avec sur une du aux sont par que nous vous",
    "es": "el los las una para con por que del sus este esta más son como al",
}


def vote(text: Column) -> Column:
    """(language, hits): the language with most distinct common words, ties to the earlier one; null below two hits or eight words."""
    w = F.array_distinct(words(text))
    hits = [F.struct(F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in common.split()]))).alias("hits"), F.lit(-i).alias("o"), F.lit(lang).alias("language")) for i, (lang, common) in enumerate(VOTES.items())]
    best = F.array_max(F.array(*hits))
    return F.when((F.size(words(text)) >= LEAST_WORDS) & (best.hits >= LEAST_HITS), F.struct(best.language.alias("language"), best.hits.alias("hits")))


def segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, floor_cleared): paragraphs and sentences, each span once; a paragraph's flag wins."""
    p = df.select(key, F.inline(paragraphs(F.col(text)))).withColumn("floor_cleared", F.lit(True))
    s = df.select(key, F.inline(sentences(F.col(text)))).withColumn("floor_cleared", F.lit(False))
    return p.unionByName(s).groupBy(key, "start", "end", "text").agg(F.max("floor_cleared").alias("floor_cleared"))


def foreign_segments(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, language, hits) of the segments of enough language-bearing words that read as another language than English."""
    judged = segments(df, key, text).withColumn("bearing", bearing_text(F.col("text")))
    enough = judged.where(F.size(words(F.col("bearing"))) >= F.when(F.col("floor_cleared"), LEAST_WORDS).otherwise(SEGMENT_WORDS))
    return enough.withColumn("v", vote(F.col("bearing"))).where("v.language <> 'en'").select(key, "start", "end", "v.language", "v.hits")
