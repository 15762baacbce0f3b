"""DuckDB SQL for the queries of catalog: what the data say by plain SQL or by the arithmetic that wrote the texts."""

ROUND = "case when {x} is null then null else floor(cast(printf('%.14e', cast({x} as double) * 1e{d}) as double) + 0.5) / 1e{d} end"


def rounded(x: str, d: int) -> str:
    """Half-up rounding."""
    return ROUND.format(x=f"({x})", d=d)


MATCHES = """matches as (
  select arg_min(id, updated_at) as id, job_id, candidate_id, arg_max(struct_pack(s := score), updated_at).s as score, arg_min(created_at, updated_at) as created_at, max(updated_at) as updated_at
  from job_matches group by job_id, candidate_id)"""
ENTRIES = "entries as (select row_number() over (order by id) - 1 as n, id as entry_id, label from taxonomy_entries)"
SKILLS = f"""{ENTRIES}, skills as (
  select c_custkey as candidate_id, entry_id as skill_id, k, case when k % 2 = 1 then 'exact' else 'alias' end as match_type
  from (select c_custkey, unnest(range(1, c_custkey % 5 + 2)) as k from customer) p join entries on n = (c_custkey * k * 31 + k) % 102),
required as (select s_suppkey as job_id, req_id, entry_id as skill_id from (select s_suppkey, unnest([1, 2]) as req_id from supplier) p join entries on n = (s_suppkey * 7 * req_id + 5) % 102),
related as (select distinct a, b from (select id as a, unnest(related) as b from taxonomy_entries union all select unnest(related), id from taxonomy_entries)),
tiers as (
  select job_id, req_id, candidate_id, min(t) as t from (
    select r.job_id, r.req_id, s.candidate_id, case when match_type = 'exact' then 0 else 1 end as t from required r join skills s on r.skill_id = s.skill_id
    union all select r.job_id, r.req_id, s.candidate_id, 2 from required r join related l on r.skill_id = l.a join skills s on s.skill_id = l.b) group by all)"""
ROLES = """shipped as (select l_orderkey, max(l_shipdate) as last from lineitem group by 1),
roles as (
  select o_custkey as candidate_id, year(o_orderdate) * 12 + month(o_orderdate) as f, least(year(last) * 12 + month(last), 24025) as t
  from orders join shipped on o_orderkey = l_orderkey where year(o_orderdate) * 12 + month(o_orderdate) <= 24025),
sound as (select * from roles where t > f and t - f <= 720),
credited as (select candidate_id, greatest(0, t - greatest(f, coalesce(max(t) over (partition by candidate_id order by f, t rows between unbounded preceding and 1 preceding), f))) as credit from sound)"""
YEARS = f"""{ROLES}, by_range as (select candidate_id, sum(credit) / 12 as range_years from credited group by 1),
by_claim as (select c_custkey as candidate_id, cast(c_custkey % 20 as double) as claimed_years from customer where c_custkey % 3 = 0),
years as (
  select coalesce(r.candidate_id, c.candidate_id) as candidate_id, range_years, claimed_years, {rounded("case when range_years > 0 then range_years else coalesce(claimed_years, 0) end", 1)} as years
  from by_range r full join by_claim c on r.candidate_id = c.candidate_id)"""
RAWS = f"""with {SKILLS}, {YEARS}, wanted as (select job_id, count(*) as n from required group by 1),
sub as (select t.job_id, candidate_id, {rounded("sum([1.0::double, 0.95, 0.7][t + 1]) / any_value(n)", 6)} as skills from tiers t join wanted w on t.job_id = w.job_id group by 1, 2),
pairs as (
  select s_suppkey as job_id, c_custkey as candidate_id, coalesce(skills, 0) as skills, coalesce(years, 0) as years, 3 + s_suppkey % 5 as min_years, s_suppkey % 7 <> 0 as has_degree, s_suppkey % 4 + 1 as degree,
    case when c_custkey % 6 < 5 then c_custkey % 6 end as have
  from supplier cross join customer left join years y on y.candidate_id = c_custkey left join sub on sub.job_id = s_suppkey and sub.candidate_id = c_custkey),
parts as (
  select *, {rounded("least(1.0, years / min_years)", 6)} as y, {rounded("least(1.0, (case when years >= 12 then 4 when years >= 8 then 3 when years >= 5 then 2 when years >= 2 then 1 else 0 end) / 2)", 6)} as l,
    {rounded("case when have is null then 0.0 else least(1.0, have / degree) end", 6)} as d, case when has_degree then 0.4::double + 0.3 + 0.1 + 0.2 else 0.4::double + 0.3 + 0.1 end as w from pairs),
contributions as (
  select job_id, candidate_id, {rounded("(0.4::double / w) * skills", 6)} as a, {rounded("(0.3::double / w) * y", 6)} as b, {rounded("(0.1::double / w) * l", 6)} as c, case when has_degree then {rounded("(0.2::double / w) * d", 6)} else 0 end as e from parts),
raws as (select job_id, candidate_id, least(1.0, {rounded("a + b + c + e", 6)}) as raw from contributions)"""
HOST = "regexp_replace(regexp_replace(lower(source_url), '^[a-z]+://', ''), '[?#].*$', '')"
BLANK = r"regexp_replace(regexp_replace(l, '^[\s\x{00A0}\x{FEFF}]+', ''), '[\s\x{00A0}\x{FEFF}]+$', '')"

SQL = {
    "rank_top_candidates": f"with {MATCHES} select job_id, candidate_id, score, rank from (select *, row_number() over (partition by job_id order by score desc, created_at, candidate_id) as rank from matches where score is not null) where rank <= 5",
    "rank_jobs_of_candidates": f"with {MATCHES} select candidate_id, job_id, score, rank from (select *, row_number() over (partition by candidate_id order by score desc, job_id) as rank from matches where score is not null) where rank <= 3",
    "upsert_matches": f"with {MATCHES} select id, job_id, candidate_id, score, created_at, updated_at from matches",
    "upsert_events": "select arg_min(event_id, ts) as event_id, user_id, event_type, arg_max(value, ts) as value, max(ts) as updated_at, min(ts) as created_at from events group by user_id, event_type",
    "scored_and_skipped": f"with {MATCHES} select job_id, case when score is null then 'skipped' else 'scored' end as kind, count(*) as pairs from matches group by 1, 2",
    "insert_or_get_candidates": """
with c as (select id, file_sha256, arg_max(created_at, updated_at) as created_at from candidates group by 1, 2),
r as (select id, first_value(id) over (partition by file_sha256 order by created_at, id) as row_id from c)
select id, row_id, row_id <> id as already_existed from r""",
    "file_reference_counts": 'select file_sha256, count(*) as "references" from (select file_sha256 from candidates union all select file_sha256 from jobs) group by 1',
    "delete_failed_candidates": "select job_id, count(*) as matches from job_matches where candidate_id is null or candidate_id not in (select id from candidates where parse_status = 'failed') group by 1",
    "orphaned_files": """
with gone as (select distinct id from candidates where parse_status = 'failed')
select distinct file_sha256 from candidates where id in (select id from gone)
and file_sha256 not in (select file_sha256 from candidates where id not in (select id from gone)) and file_sha256 not in (select file_sha256 from jobs)""",
    "deletion_log": "select distinct 'candidate' as entity_type, id as entity_id, 'deleted' as action, cast(null as varchar) as details from candidates where parse_status = 'failed'",
    "requested_job_status": """
select a.id, case when j.id is null then 'unknown' when not coalesce(parse_status = 'ok' and language = 'en', false) then 'not_scoreable' when a.id not in (select job_id from job_matches) then 'not_configured' else 'ready' end as status
from (select distinct job_id as id from proposed_skills union select 'unknown-job') a left join jobs j on a.id = j.id""",
    "parse_outcomes": "select case when parse_status = 'ok' and language = 'en' then 'scoreable' when parse_status = 'failed' then 'failed' else 'needs_attention' end as outcome, language, count(*) as rows from candidates group by 1, 2",
    "warning_counts": "select warning, count(*) as rows from (select unnest(cast(warnings as json)::varchar[]) as warning from candidates) group by 1",
    "reference_months": """
select cast(regexp_extract(reference_date, '^(\\d{4})-(0[1-9]|1[0-2])$', 1) as int) * 12 + cast(regexp_extract(reference_date, '^(\\d{4})-(0[1-9]|1[0-2])$', 2) as int) as month, reference_date as text, count(*) as rows
from job_matches where regexp_matches(reference_date, '^\\d{4}-(0[1-9]|1[0-2])$') group by all
union all select null, null, count(*) from job_matches where reference_date is null or not regexp_matches(reference_date, '^\\d{4}-(0[1-9]|1[0-2])$') having count(*) > 0""",
    "rounded_amounts": f"select l_orderkey, l_linenumber, {rounded('l_extendedprice * l_discount', 2)} as two, {rounded('l_extendedprice * l_discount / 7', 6)} as six from lineitem",
    "url_slugs": f"""
select id, coalesce(nullif(left(regexp_replace(regexp_replace(concat_ws('-', regexp_extract({HOST}, '^([^/]*)', 1), regexp_extract({HOST}, '/([^/]+)/?$', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80), ''), 'job') as slug
from jobs where source_url is not null""",
    "text_profile": r"""
select doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g')) as letters, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) as letters_and_digits, len(string_split(text, chr(10))) as lines, sha256(text) as sha256
from documents where text is not null""",
    "visible_text": r"""
select distinct id, stored, visible from (select id, length(raw_text) as stored, length(regexp_replace(raw_text, '[\p{Cf}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}\x{034F}\x{180E}]', '', 'g')) as visible from candidates where raw_text is not null)
where stored <> visible""",
    "proposal_spans": """
select coalesce(span_start >= 0 and span_start < span_end and span_end <= length(raw_text) and lower(substr(raw_text, span_start + 1, span_end - span_start)) = lower(label), false) as holds, count(*) as proposals
from proposed_skills p join jobs j on p.job_id = j.id group by 1""",
    "bullet_lines": rf"""
with lines as (select id, unnest(string_split(raw_text, chr(10))) as l from jobs),
t as (select id, {BLANK} as body, regexp_matches(l, '^(?:[-*•]|\d+[.)])\s+') as b from lines)
select id, count(*) as lines, count(*) filter (where b) as bullets, sum(length(case when b then regexp_replace(body, '^(?:[-*•]|\d+[.)])\s+', '') else body end)) as letters
from t where case when b then regexp_replace(body, '^(?:[-*•]|\d+[.)])\s+', '') else body end <> '' group by 1""",
    "letter_windows": r"""
with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i, unnest(string_split(text, chr(10))) as line from documents),
n as (select doc_id, i, length(regexp_replace(line, '[^\p{L}]', '', 'g')) as n from l),
s as (select doc_id, i, n, sum(n) over (partition by doc_id order by i) as upto from n)
select a.doc_id, a.i as first_line, min(b.i) as last_line from s a join s b on a.doc_id = b.doc_id and b.i between a.i and a.i + 11 and b.upto - (a.upto - a.n) >= 100 group by 1, 2""",
    "merged_proposal_spans": """
with p as (select job_id, span_start as s, span_end + 25 as e from proposed_skills),
f as (select *, case when s > coalesce(max(e) over (partition by job_id order by s, e rows between unbounded preceding and 1 preceding), -1) then 1 else 0 end as n from p where s < e),
g as (select *, sum(n) over (partition by job_id order by s, e rows unbounded preceding) as island from f)
select job_id, min(s) as start, max(e) as "end" from g group by job_id, island""",
    "first_proposals": """
select job_id, canonical_skill_id as entry_id, min(struct_pack(s := span_start, e := span_end)).s as start, min(struct_pack(s := span_start, e := span_end)).e as "end"
from proposed_skills where canonical_skill_id is not null group by 1, 2""",
    "page_texts": "select doc_id, 'Document ' || doc_id || chr(10) || chr(10) || 'from ' || source || ' – end' as text, 'No. & ' || doc_id as title from documents",
    "posting_pages": """
select id, case when title like '% / %' then title else 'Page' end as title, case when title like '% / %' then title || chr(10) || 'FULL_TIME' || chr(10) || chr(10) || 'Work' else 'Plain' end as text,
case when title like '% / %' then 'json-ld' else 'markup' end as source from jobs where title is not null and title not like '%<%'""",
    "canonical_labels": r"""
with terms as (select lower(unnest(list_append(aliases, id))) as term, id, unnest(list_append([1 for x in aliases], 0)) as o from taxonomy_entries),
known as (select term, min(struct_pack(o := o, id := id)).id as id from terms group by 1)
select proposal_id, k.id as canonical_id from proposed_skills p left join known k on trim(regexp_replace(lower(label), '[\s\x{00A0}\x{FEFF}]+', ' ', 'g')) = k.term""",
    "related_skills": "select distinct a, b from (select id as a, unnest(related) as b from taxonomy_entries union all select unnest(related), id from taxonomy_entries)",
    "skills_in_lists": f"with {SKILLS} select distinct candidate_id, skill_id as entry_id, 'exact' as match_type from skills",
    "written_date_ranges": "select o_orderkey, 6 as start, year(o_orderdate) * 12 + month(o_orderdate) as from_month, 24025 as to_month from orders",
    "written_claims": "select c_custkey, cast(c_custkey % 70 as double) as years, 0.95 as confidence from customer where c_custkey % 70 between 1 and 60",
    "written_degrees": """
select c_custkey, ['high_school', 'associate', 'bachelor', 'master', 'doctorate'][c_custkey % 6 + 1] as degree_level, cast(c_custkey % 6 as int) as degree_index from customer where c_custkey % 6 < 5""",
    "tenure_credit": f"with {ROLES} select candidate_id, sum(credit)::bigint as months from credited group by 1",
    "total_years": f"with {YEARS} select candidate_id, years from years",
    "discarded_claims": f"with {YEARS} select candidate_id, years, claimed_years from years where range_years > 0 and claimed_years > {rounded('range_years', 1)}",
    "requirement_tiers": f"with {SKILLS} select job_id, req_id, candidate_id, ['exact', 'alias', 'related'][t + 1] as tier, [1.0::double, 0.95, 0.7][t + 1] as subscore from tiers",
    "required_skill_fractions": f"""
with {SKILLS}, wanted as (select job_id, count(distinct skill_id) as n from required group by 1),
met as (select r.job_id, s.candidate_id, count(distinct r.skill_id) as met from required r join skills s on r.skill_id = s.skill_id group by 1, 2)
select m.job_id, candidate_id, met, met / n as fraction from met m join wanted w on m.job_id = w.job_id""",
    "score_top_pairs": f"""
{RAWS}
select job_id, candidate_id, cast({rounded("raw * 100", 0)} as bigint) as score, rank
from (select *, row_number() over (partition by job_id order by raw desc, candidate_id) as rank from raws) where rank <= 5""",
    "score_jobs_of_candidates": f"""
{RAWS}
select job_id, candidate_id, cast({rounded("raw * 100", 0)} as bigint) as score, rank
from (select *, row_number() over (partition by candidate_id order by raw desc, job_id) as rank from raws where candidate_id % 100 = 0) where rank <= 3""",
    "rank_by_score_alone": f"with {MATCHES} select job_id, candidate_id, rank from (select *, row_number() over (partition by job_id order by score desc, candidate_id) as rank from matches where score is not null) where rank <= 5",
    "education_parts": f"""
with d as (select c_custkey, case when c_custkey % 6 < 5 then least(1.0, (c_custkey % 6) / (c_custkey % 4 + 1)) else 0.0 end as degree, case when c_custkey % 7 <> 0 then (c_custkey % 3) / 2 end as held from customer)
select c_custkey, {rounded("case when held is null then degree else (degree + held) / 2 end", 6)} as part from d""",
    "proposed_requirements": f"""
with {ENTRIES}, j as (select s_suppkey as job_id, entry_id from supplier join entries on n = s_suppkey * 13 % 102)
select job_id, 'skill' as kind, entry_id, cast(null as double) as number from j
union all select job_id, 'certificate', 'pmp', null from j
union all select job_id, 'degree', 'bachelor', 2.0 from j
union all select job_id, 'years', null, cast(job_id % 9 + 3 as double) from j""",
    "nearest_vectors": f"""
with s as (select a.vec_id as left_key, b.vec_id as right_key, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as s from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
select left_key, arg_max(right_key, struct_pack(s := s, k := -right_key)) as right_key, {rounded("max(s)", 4)} as similarity from s group by 1""",
}
