"""SQL with the same result, where SQL can express an operator over whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"

# every pair of texts by the shingles that they share
PAIRS = f"""texts as (select raw_text, min(id) as class_id, count(distinct id) as copies from candidates where raw_text is not null group by raw_text),
words as (select class_id, copies, w from (select class_id, copies, {WORDS.format(text="raw_text")} as w from texts) where len(w) >= 20),
shingles as (select class_id, unnest(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) as g from words),
sizes as (select class_id, count(*) as n from shingles group by 1),
shared as (select a.class_id as x, b.class_id as y, count(*) as n from shingles a join shingles b on a.g = b.g and a.class_id < b.class_id group by 1, 2),
near as (select x, y from shared s join sizes p on s.x = p.class_id join sizes q on s.y = q.class_id where s.n / (p.n + q.n - s.n) >= 0.6),
members as (select distinct c.id, w.class_id, w.copies from candidates c join texts t on c.raw_text = t.raw_text join words w on t.class_id = w.class_id)"""

SQL = {
    "p6_found": f"""
with {PAIRS}
select distinct least(a.id, b.id) as candidate_id_a, greatest(a.id, b.id) as candidate_id_b
from (select x, y from near union all select class_id, class_id from words) l join members a on a.class_id = l.x join members b on b.class_id = l.y where a.id <> b.id""",
    "p6_classes": f"""
with {PAIRS}, ends as (select x as class_id from near union all select y from near)
select id as candidate_id, class_id, copies, (select count(*) from ends e where e.class_id = m.class_id) as links from members m""",
    "p9_found": f"""
with d as (select doc_id, {WORDS.format(text="text")} as w from documents where text is not null),
i as (select item_id, {WORDS.format(text="text")} as w from eval_items),
dg as (select doc_id, unnest([list_aggregate(w[k:k + 11], 'string_agg', ' ') for k in range(1, len(w) - 10)]) as g from d),
ig as (select item_id, unnest([list_aggregate(w[k:k + 11], 'string_agg', ' ') for k in range(1, len(w) - 10)]) as g from i)
select distinct doc_id, item_id from dg join ig on dg.g = ig.g""",
}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return dict(SQL)
