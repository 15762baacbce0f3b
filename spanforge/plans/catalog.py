"""The registered queries of the core, each over its whole tables, with their SQL in catalog_sql."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import dates, numeric, text
from spanforge.operators import education, gazetteer, matching, persist, proposals, ranking, reading, sections, spans, tenure
from spanforge.plans import catalog_sql, fixtures
from spanforge.session import table, written
from spanforge.sources import html

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    """Register a query by its name."""
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    """Name to query over a data directory."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to SQL with the same result."""
    return {k: v for k, v in catalog_sql.SQL.items() if k in QUERIES}


# --- keyed tables -----------------------------------------------------------------------------------------------------


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "job_matches").select("id", "job_id", "candidate_id", "score", "engine_version", "created_at", "updated_at")
    return persist.upserted(rows.where("updated_at = created_at"), rows.where("updated_at <> created_at"), ["job_id", "candidate_id"], ["id", "created_at"], "updated_at")


@query
def rank_top_candidates(spark, sf):
    """The best five candidates of each job after the latest upserts."""
    best = ranking.top(_matches(spark, sf).where("score is not null"), ["job_id"], ranking.best_first(), 5)
    return best.select("job_id", "candidate_id", "score", "rank")


@query
def rank_by_score_alone(spark, sf):
    """The best five candidates of each job, ties by candidate, whatever their age."""
    best = ranking.top(_matches(spark, sf).where("score is not null"), ["job_id"], [F.desc("score"), F.asc("candidate_id")], 5)
    return best.select("job_id", "candidate_id", "rank")


@query
def rank_jobs_of_candidates(spark, sf):
    """The best three jobs of each candidate, ties by job."""
    best = ranking.top(_matches(spark, sf).where("score is not null"), ["candidate_id"], [F.desc("score"), F.asc("job_id")], 3)
    return best.select("candidate_id", "job_id", "score", "rank")


@query
def upsert_matches(spark, sf):
    """One row for each job and candidate: first id and creation, last score."""
    return _matches(spark, sf).select("id", "job_id", "candidate_id", "score", "created_at", "updated_at")


@query
def upsert_events(spark, sf):
    """First time, last time and last value of each user and kind of event."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").alias("updated_at"), F.col("ts").alias("created_at"))
    return persist.upserted(e, e.limit(0), ["user_id", "event_type"], ["event_id", "created_at"], "updated_at")


@query
def scored_and_skipped(spark, sf):
    """Scored and skipped pairs of each job."""
    scored, skipped = persist.split_by(_matches(spark, sf), F.col("score").isNotNull())
    both = scored.select("job_id", F.lit("scored").alias("kind")).unionByName(skipped.select("job_id", F.lit("skipped").alias("kind")))
    return both.groupBy("job_id", "kind").agg(F.count("*").alias("pairs"))


@query
def insert_or_get_candidates(spark, sf):
    """The id that holds each upload's content, and whether it was there before."""
    c = persist.latest(table(spark, sf, "candidates").select("id", "file_sha256", "created_at", "updated_at"), ["id"], [F.desc("updated_at")])
    return persist.insert_or_get(c, c.limit(0), "file_sha256", [F.asc("created_at"), F.asc("id")]).select("id", "row_id", "already_existed")


@query
def file_reference_counts(spark, sf):
    """References to each file from candidates and jobs."""
    return persist.reference_counts("file_sha256", table(spark, sf, "candidates"), table(spark, sf, "jobs"))


@query
def delete_failed_candidates(spark, sf):
    """Matches that stay when candidates of failed parses go, counted by job."""
    c = table(spark, sf, "candidates").select("id", "file_sha256", "parse_status")
    m = table(spark, sf, "job_matches").select("job_id", "candidate_id")
    left = persist.deleted(c, c.where("parse_status = 'failed'"), {"matches": (m, "candidate_id")}, "file_sha256", [table(spark, sf, "jobs")])
    return left["matches"].groupBy("job_id").agg(F.count("*").alias("matches"))


@query
def orphaned_files(spark, sf):
    """Files that nothing refers to once candidates of failed parses are gone."""
    c = table(spark, sf, "candidates").select("id", "file_sha256", "parse_status")
    return persist.deleted(c, c.where("parse_status = 'failed'"), {}, "file_sha256", [table(spark, sf, "jobs")])["orphans"]


@query
def deletion_log(spark, sf):
    """Log entries of the deletions."""
    return persist.log_entries(table(spark, sf, "candidates").where("parse_status = 'failed'").select("id").distinct(), "candidate", "deleted")


@query
def requested_job_status(spark, sf):
    """What keeps each job that proposals name from being scored."""
    jobs = table(spark, sf, "jobs")
    rows = jobs.select("id", persist.outcome(F.col("parse_status"), F.col("language")).alias("outcome"))
    asked = table(spark, sf, "proposed_skills").select(F.col("job_id").alias("id")).unionByName(spark.createDataFrame([("unknown-job",)], "id string"))
    return persist.with_status(asked, rows, table(spark, sf, "job_matches").select(F.col("job_id").alias("id")))


@query
def parse_outcomes(spark, sf):
    """Candidates by outcome of parsing and language."""
    c = table(spark, sf, "candidates")
    return c.groupBy(persist.outcome(F.col("parse_status"), F.col("language")).alias("outcome"), "language").agg(F.count("*").alias("rows"))


@query
def warning_counts(spark, sf):
    """Warnings out of their JSON lists."""
    return table(spark, sf, "candidates").select(F.explode(persist.parsed_list(F.col("warnings"))).alias("warning")).groupBy("warning").agg(F.count("*").alias("rows"))


@query
def reference_months(spark, sf):
    """Matches by absolute month of their reference date."""
    m = dates.reference_month(F.col("reference_date"))
    return table(spark, sf, "job_matches").groupBy(m.alias("month"), dates.reference_text(m).alias("text")).agg(F.count("*").alias("rows"))


# --- scalar functions -------------------------------------------------------------------------------------------------


@query
def rounded_amounts(spark, sf):
    """Half-up rounding of amounts to two and six decimals."""
    x = F.col("l_extendedprice") * F.col("l_discount")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", numeric.round_half_up(x, 2).alias("two"), numeric.quantize(x / 7).alias("six"))


@query
def url_slugs(spark, sf):
    """File names made of source urls."""
    return table(spark, sf, "jobs").where("source_url is not null").select("id", text.slug(F.col("source_url")).alias("slug"))


@query
def text_profile(spark, sf):
    """Letters, letters and digits, lines and content hash of every document."""
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", text.letters(F.col("text")).alias("letters"), text.letters_and_digits(F.col("text")).alias("letters_and_digits"), F.size(F.split("text", "\n", -1)).alias("lines"), F.sha2("text", 256).alias("sha256"))


@query
def visible_text(spark, sf):
    """CVs whose visible text is shorter than stored, with both lengths."""
    c = table(spark, sf, "candidates").where("raw_text is not null").select("id", F.length("raw_text").alias("stored"), F.length(text.strip_invisible(F.col("raw_text"))).alias("visible"))
    return c.where("stored <> visible").distinct()


@query
def proposal_spans(spark, sf):
    """Proposals whose span holds their label, by outcome."""
    j = table(spark, sf, "jobs").select(F.col("id").alias("job_id"), "raw_text")
    p = table(spark, sf, "proposed_skills").join(j, "job_id")
    holds = text.span_holds(F.col("raw_text"), F.col("span_start"), F.col("span_end"), F.col("label"))
    return p.groupBy(F.coalesce(holds, F.lit(False)).alias("holds")).agg(F.count("*").alias("proposals"))


@query
def bullet_lines(spark, sf):
    """Non-blank lines and bullets of each posting."""
    lines = table(spark, sf, "jobs").select("id", F.explode(text.line_segments(F.col("raw_text"))).alias("s"))
    return lines.groupBy("id").agg(F.count("*").alias("lines"), F.count_if("s.is_bullet").alias("bullets"), F.sum(F.col("s.end") - F.col("s.start")).alias("letters"))


@query
def section_spans(spark, sf):
    """Sections of every CV."""
    c = table(spark, sf, "candidates").select("id", "raw_text").dropDuplicates(["id"])
    return sections.sections(c, "id", "raw_text")


@query
def letter_windows(spark, sf):
    """Shortest runs of lines with a hundred letters."""
    return sections.letter_windows(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query
def merged_proposal_spans(spark, sf):
    """Proposal spans of each job, touching ones merged."""
    p = table(spark, sf, "proposed_skills").select("job_id", F.col("span_start").alias("start"), (F.col("span_end") + 25).alias("end"))
    return spans.merged(p, "job_id")


@query
def first_proposals(spark, sf):
    """Each job's distinct skills at their first mention."""
    p = table(spark, sf, "proposed_skills").where("canonical_skill_id is not null")
    rows = p.select("job_id", F.col("canonical_skill_id").alias("entry_id"), F.col("label").alias("value"), F.col("span_start").alias("start"), F.col("span_end").alias("end"), F.lit("exact").alias("match_type"))
    return gazetteer.first_mentions(rows, "job_id").select("job_id", "entry_id", "start", "end")


@query
def foreign_segments(spark, sf):
    """Segments of documents that do not read as English."""
    return reading.foreign_segments(table(spark, sf, "documents").where("text is not null").select("doc_id", "text"), "doc_id", "text")


# --- pages ------------------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source")
    body = F.concat(F.lit("<html><head><title>No. &amp; "), F.col("doc_id"), F.lit("</title><style>p{}</style></head><body><!-- <p>gone</p> --><p>Document "), F.col("doc_id"), F.lit("</p><script>var x = 1;</script><div>from&nbsp;<b>"), F.col("source"), F.lit("</b> &#8211; end</div></body></html>"))
    return d.select("doc_id", body.alias("html"))


@query
def page_texts(spark, sf):
    """Text and title of pages."""
    return _pages(spark, sf).select("doc_id", html.html_text(F.col("html")).alias("text"), html.html_title(F.col("html")).alias("title"))


@query
def posting_pages(spark, sf):
    """Postings in JSON-LD where a page has one, else its markup."""
    j = table(spark, sf, "jobs").select("id", "title")
    node = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.col("title"), F.lit("<p>Work</p>").alias("description"), F.lit("FULL_TIME").alias("employmentType")))
    ld = F.when(F.col("title").contains(" / "), F.concat(F.lit('<script type="application/ld+json">{"@graph":['), node, F.lit("]}</script>"))).otherwise(F.lit('<script type="application/ld+json">{broken</script>'))
    rows = j.where("title is not null and title not like '%<%'").select("id", html.page(F.concat(F.lit("<head><title>Page</title>"), ld, F.lit("</head><body>Plain</body>"))).alias("p"))
    return rows.select("id", "p.title", "p.text", "p.source")


# --- extraction -------------------------------------------------------------------------------------------------------


@query
def canonical_labels(spark, sf):
    """The entry whose id or alias each label is."""
    return gazetteer.canonical(table(spark, sf, "proposed_skills").select("proposal_id", "label"), "label", table(spark, sf, "taxonomy_entries"))  .select("proposal_id", "canonical_id")


@query
def related_skills(spark, sf):
    """Related entries, both ways."""
    return matching.related_pairs(table(spark, sf, "taxonomy_entries"))


@query
def skills_in_lists(spark, sf):
    """Skills found in lists written from keys, which the keys tell exactly."""
    named = fixtures.candidate_skills(spark, sf).join(F.broadcast(fixtures.numbered_entries(spark, sf)), F.col("skill_id") == F.col("entry_id"))
    texts = named.groupBy("candidate_id").agg(F.concat(F.lit("Skills\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "label"))), lambda x: x.label), "; ")).alias("text"))
    found = gazetteer.find_terms(texts, "candidate_id", "text", gazetteer.surfaces(table(spark, sf, "taxonomy_entries")))
    return found.select("candidate_id", "entry_id", "match_type").distinct()


@query
def skills_in_postings(spark, sf):
    """Every place of a known skill in the postings."""
    terms = gazetteer.surfaces(table(spark, sf, "taxonomy_entries"))
    return gazetteer.find_terms(table(spark, sf, "jobs").select("id", "raw_text"), "id", "raw_text", terms)


@query
def skills_in_sections(spark, sf):
    """Skills of CVs with the section they stand in and a confidence."""
    c = table(spark, sf, "candidates").select("id", "raw_text").dropDuplicates(["id"])
    found = gazetteer.find_terms(c, "id", "raw_text", gazetteer.surfaces(table(spark, sf, "taxonomy_entries")))
    placed = spans.inside(found, sections.sections(c, "id", "raw_text"), "id", "section")
    return placed.select("id", "entry_id", "match_type", "start", "end", "section", gazetteer.confidence(F.col("match_type"), F.coalesce(F.col("section") == "skills", F.lit(False))).alias("confidence"))


@query
def written_date_ranges(spark, sf):
    """Date ranges read back from text written out of order dates."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Role: "), F.date_format("o_orderdate", "MMM yyyy"), F.lit(" – Present, see file "), F.col("o_orderkey")).alias("t"))
    return tenure.ranges(o, "o_orderkey", "t", fixtures.REFERENCE).select("o_orderkey", "start", F.col("from.month").alias("from_month"), F.col("to.month").alias("to_month"))


@query
def date_ranges_in_cvs(spark, sf):
    """Date ranges of the CVs."""
    c = table(spark, sf, "candidates").select("id", "raw_text").dropDuplicates(["id"])
    return tenure.ranges(c, "id", "raw_text", 2026 * 12 + 8).select("id", "start", "end", F.col("from.kind").alias("from_kind"), F.col("from.month").alias("from_month"), F.col("to.month").alias("to_month"))


@query
def written_claims(spark, sf):
    """Claims of years read back from text written out of keys."""
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("I have "), F.col("c_custkey") % 70, F.lit(" years of experience and am "), F.col("c_custkey") % 50, F.lit(" years old.")).alias("t"))
    return tenure.claims(c, "c_custkey", "t").select("c_custkey", "years", "confidence")


@query
def written_degrees(spark, sf):
    """The best degree read back from text written out of keys."""
    words = F.array(*[F.lit(x) for x in ("High school diploma", "Associate's degree in Art", "BSc in Physics", "MEng in Optics, BSc in Physics", "Ph.D. in Chemistry", "no degree here")])
    c = table(spark, sf, "customer").select("c_custkey", F.get(words, (F.col("c_custkey") % 6).cast("int")).alias("t"))
    return education.best_degree(education.degrees(c, "c_custkey", "t"), "c_custkey")


@query
def degrees_in_cvs(spark, sf):
    """Degrees of the CVs by level."""
    c = table(spark, sf, "candidates").select("id", "raw_text").dropDuplicates(["id"])
    return education.degrees(c, "id", "raw_text").groupBy("degree_level").agg(F.count("*").alias("places"), F.countDistinct("id").alias("candidates"))


# --- tenure and scores ------------------------------------------------------------------------------------------------


@query
def tenure_credit(spark, sf):
    """Months that the union of each candidate's roles covers."""
    roles = tenure.credited(tenure.plausible(fixtures.roles(spark, sf), fixtures.REFERENCE), "candidate_id")
    return roles.groupBy("candidate_id").agg(F.sum("credit").cast("bigint").alias("months"))


def _years(spark: SparkSession, sf: str) -> DataFrame:
    return tenure.total_years(tenure.plausible(fixtures.roles(spark, sf), fixtures.REFERENCE), fixtures.claimed_years(spark, sf), "candidate_id")


@query
def total_years(spark, sf):
    """Years of experience: the union of roles, or the claim."""
    return _years(spark, sf).select("candidate_id", "years")


@query
def discarded_claims(spark, sf):
    """Claims beyond what the roles add up to."""
    return tenure.discarded_claims(_years(spark, sf)).select("candidate_id", "years", "claimed_years")


@query
def requirement_tiers(spark, sf):
    """How each requirement is met by the candidates that meet it."""
    tiers = matching.requirement_tiers(fixtures.job_requirements(spark, sf), fixtures.candidate_skills(spark, sf), matching.related_pairs(table(spark, sf, "taxonomy_entries")))
    return tiers.select("job_id", "req_id", "candidate_id", "tier", "subscore")


@query
def required_skill_fractions(spark, sf):
    """Share of a job's skills that candidates hold outright."""
    held = fixtures.candidate_skills(spark, sf).select("candidate_id", "skill_id")
    return matching.has_all(fixtures.job_requirements(spark, sf), held, "job_id", "skill_id", "candidate_id").select("job_id", "candidate_id", "met", "fraction")


def _scoring_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, candidates, skill scores of the pairs that share any)."""
    required = fixtures.job_requirements(spark, sf)
    tiers = matching.requirement_tiers(required, fixtures.candidate_skills(spark, sf), matching.related_pairs(table(spark, sf, "taxonomy_entries")))
    degree = F.when(F.col("c_custkey") % 6 < 5, (F.col("c_custkey") % 6).cast("int")).alias("degree_index")
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("candidate_id"), degree).join(_years(spark, sf).select("candidate_id", "years"), "candidate_id", "left")
    return fixtures.job_dimensions(spark, sf), people.withColumn("years", F.coalesce("years", F.lit(0.0))), matching.skill_scores(tiers, required)


@query
def score_top_pairs(spark, sf):
    """All pairs of jobs and candidates scored in four dimensions; the best five of each job."""
    jobs, people, skills = _scoring_sides(spark, sf)
    return matching.top_pairs(jobs, people, skills, 5).select("job_id", "candidate_id", "score", "rank")


@query
def score_jobs_of_candidates(spark, sf):
    """The reverse: the best three jobs of every hundredth candidate among all jobs."""
    jobs, people, skills = _scoring_sides(spark, sf)
    asked = people.where("candidate_id % 100 = 0")
    return matching.top_jobs(jobs, asked, skills.where("candidate_id % 100 = 0"), 3).select("candidate_id", "job_id", "score", "rank")


@query
def education_parts(spark, sf):
    """Degree and certificates of keys as one sub-score; every seventh wants no certificate."""
    k = F.col("c_custkey")
    degree = numeric.degree_score(F.when(k % 6 < 5, (k % 6).cast("int")), (k % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", matching.education_part(degree, F.when(k % 7 != 0, (k % 3) / F.lit(2.0))).alias("part"))


@query
def proposed_requirements(spark, sf):
    """Requirements proposed from postings written out of keys."""
    k = F.col("s_suppkey")
    entries = fixtures.numbered_entries(spark, sf)
    rows = table(spark, sf, "supplier").select(k.alias("job_id"), (k * 13 % 102).cast("int").alias("n")).join(F.broadcast(entries), "n")
    text = F.concat(F.lit("Wanted: "), F.col("label"), F.lit("; at least "), F.col("job_id") % 9 + 1, F.lit(" years of experience, better "), F.col("job_id") % 9 + 3, F.lit("+ years.\nMSc in Optics preferred, BSc in Optics required.\nPMP; PMP"))
    found = proposals.attributes(rows.select("job_id", text.alias("t")), "job_id", "t", gazetteer.surfaces(table(spark, sf, "taxonomy_entries")))
    return proposals.proposed(found, "job_id").select("job_id", "kind", "entry_id", "number")


@query
def proposals_of_postings(spark, sf):
    """Requirements proposed from the postings."""
    found = proposals.attributes(table(spark, sf, "jobs").select("id", "raw_text"), "id", "raw_text", gazetteer.surfaces(table(spark, sf, "taxonomy_entries")))
    return proposals.proposed(found, "id")


@query
def score_texts(spark, sf):
    """End to end: requirements out of postings, attributes out of CVs, the best three CVs of each posting that parsed well in English."""
    terms = gazetteer.surfaces(table(spark, sf, "taxonomy_entries"))
    readable = lambda name: table(spark, sf, name).where(persist.outcome(F.col("parse_status"), F.col("language")) == "scoreable").select("id", "raw_text").dropDuplicates(["id"])
    wishes = written(proposals.proposed(proposals.attributes(readable("jobs"), "id", "raw_text", terms), "id"))
    cvs = readable("candidates")
    held = written(proposals.attributes(cvs, "id", "raw_text", terms).drop("place"))
    month = F.struct(F.col("from.month").alias("from_month"), F.col("to.month").alias("to_month"))
    roles = spans.outside(tenure.ranges(cvs, "id", "raw_text", 2026 * 12 + 8), sections.sections(cvs, "id", "raw_text").where("section in ('education', 'certifications')"), "id")
    roles = roles.where("from.kind = 'resolved' and to.kind = 'resolved'").select(F.col("id").alias("candidate_id"), month.alias("m")).select("candidate_id", "m.*")
    stated = held.where("kind = 'years'").select(F.col("id").alias("candidate_id"), F.col("number").alias("years"))
    years = tenure.total_years(tenure.plausible(roles, 2026 * 12 + 8), stated, "candidate_id").select("candidate_id", "years")
    degrees = held.where("kind = 'degree'").groupBy(F.col("id").alias("candidate_id")).agg(F.max("number").cast("int").alias("degree_index"))
    people = cvs.select(F.col("id").alias("candidate_id")).join(years, "candidate_id", "left").join(degrees, "candidate_id", "left").select("candidate_id", F.coalesce("years", F.lit(0.0)).alias("years"), "degree_index")
    required = wishes.where("kind = 'skill'").select(F.col("id").alias("job_id"), F.col("entry_id").alias("req_id"), F.col("entry_id").alias("skill_id"))
    skills = held.where("kind = 'skill'").select(F.col("id").alias("candidate_id"), F.col("entry_id").alias("skill_id"), F.lit("exact").alias("match_type"), "start", "end")
    tiers = matching.requirement_tiers(required, skills, matching.related_pairs(table(spark, sf, "taxonomy_entries")))
    best = matching.top_pairs(proposals.dimensions(wishes, "id"), people, matching.skill_scores(tiers, required), 3)
    return best.select("job_id", "candidate_id", "score", "rank")


@query
def nearest_vectors(spark, sf):
    """The nearest other vector of every twentieth one, by cosine."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    near = matching.cosine(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding")
    best = near.groupBy("left_key").agg(F.max_by("right_key", F.struct("similarity", -F.col("right_key"))).alias("right_key"), F.max("similarity").alias("s"))
    return best.select("left_key", "right_key", numeric.round_half_up(F.col("s"), 4).alias("similarity"))
