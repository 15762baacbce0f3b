"""The registered queries of the llm operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import bpe, canon, cutoff, langid, leaks, neardup, pages, pii, residue, unify
from spanforge.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Personal information in CVs."""
    rows = pii.found_spans(table(spark, sf, "candidates").select("id", "raw_text"), "id", "raw_text")
    return rows.select(F.col("id").alias("candidate_id"), "pii_type", "span_start", "span_end").distinct()


def p1_masked(spark: SparkSession, sf: str) -> DataFrame:
    """The CVs with placeholders in place of personal information."""
    cvs = table(spark, sf, "candidates").select("id", "raw_text")
    return pii.masked(cvs, "id", "raw_text").distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of CVs that differ from their consistent form."""
    lines = unify.consistent_lines(table(spark, sf, "candidates").select("id", "raw_text"), "id", "raw_text")
    return lines.select(F.col("id").alias("candidate_id"), "line_no").distinct()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of postings with template residue, filler, or an error message in place of content."""
    rows = residue.unfit_fields(table(spark, sf, "jobs").select("id", "raw_text", "title", "source_url"))
    return rows.select(F.col("id").alias("job_id"), "field_name")


def p3_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion of weak label and verdict on unseen hosts."""
    return residue.validation(table(spark, sf, "jobs").select("id", "raw_text", "title", "source_url"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of postings from pages that are not part of the posting."""
    rows = pages.judged_lines(table(spark, sf, "jobs").select("id", "raw_text", "source_url", "title"))
    return rows.where("not main").select(F.col("id").alias("job_id"), "line_no")


def p4_text(spark: SparkSession, sf: str) -> DataFrame:
    """The posting alone of each page."""
    return pages.main_text(table(spark, sf, "jobs").select("id", "raw_text", "source_url", "title"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Proposals whose stored id is not the entry that their label means."""
    proposals = table(spark, sf, "proposed_skills").select("proposal_id", "label", "canonical_skill_id")
    rows = canon.mapped(proposals, "label", table(spark, sf, "taxonomy_entries"))
    return rows.where(~F.col("mapped_id").eqNullSafe(F.col("canonical_skill_id"))).select("proposal_id", F.col("mapped_id").alias("canonical_skill_id")).distinct()


def p5_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Typed values that mean no entry, with their occurrences."""
    proposals = table(spark, sf, "proposed_skills").select("proposal_id", "label")
    return canon.misses(canon.mapped(proposals, "label", table(spark, sf, "taxonomy_entries")), "label")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of candidates whose CVs are nearly the same."""
    rows = neardup.similar_pairs(table(spark, sf, "candidates").select("id", "raw_text"), "id", "raw_text")
    return rows.select(F.col("id_a").alias("candidate_id_a"), F.col("id_b").alias("candidate_id_b"))


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every CV with its class of exact copies and the number of texts that are nearly the same."""
    rows = neardup.memberships(table(spark, sf, "candidates").select("id", "raw_text"), "id", "raw_text")
    return rows.withColumnRenamed("id", "candidate_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Languages that a record contains and its label does not name."""
    rows = langid.undenoted(table(spark, sf, "candidates").select("id", "raw_text", "language"), table(spark, sf, "jobs").select("id", "raw_text", "language"))
    return rows.select("record_table", F.col("id").alias("record_id"), "lang").distinct()


def p7_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every segment of the CVs with its language and confidence."""
    cvs = table(spark, sf, "candidates").select("id", "raw_text", "language")
    return langid.segments(cvs.dropDuplicates(["id"]), "id", "raw_text", langid.fit(cvs, "id", "raw_text", "language"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as ids of the public vocabulary."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return documents.select("doc_id", bpe.token_ids(documents, "text").alias("ids"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with at least twelve consecutive words of an item."""
    rows = leaks.leaks(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")
    return rows.where(F.col("longest_run") >= leaks.RUN).select("doc_id", "item_id")


def p9_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold a copy of an item, also an edited one, with the alignment's score and longest equal run."""
    return leaks.leaks(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """The items that leaked, with the number of documents and the best alignment."""
    rows = leaks.leaks(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text")
    return rows.where(F.col("longest_run") >= leaks.RUN).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("score").alias("best_score"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that were cut."""
    return cutoff.cut_texts(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text").distinct()


def p10_sources(spark: SparkSession, sf: str) -> DataFrame:
    """How often each source cuts."""
    return cutoff.by_source(table(spark, sf, "documents").select("doc_id", "text", "source"), "doc_id", "text", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query over a data directory."""
    return {f.__name__: f for f in (p1_found, p1_masked, p2_found, p3_found, p3_validation, p4_found, p4_text, p5_found, p5_misses, p6_found, p6_classes, p7_found, p7_segments, p8_ids, p9_found, p9_copies, p9_items, p10_found, p10_sources)}
