"""Problem 10: texts cut off by field limits, in pure SQL.

Counts word trigrams, bigrams and words that go on inside texts against those that
stop (before a sentence's end, a comma or a line's end), joins each text's last
ones, and flags texts whose ending usually goes on but almost never stops. A last
word that is the beginning of longer words in the same place counts as going on.

Defined results: null, empty and blank texts are not cut; repeated rows are judged
alike; a text that ends in a sentence's closing punctuation, a semicolon or a link is complete;
behind a bracket, quote or other sign the counts decide.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.session import written

# Tokens are numbers, words, list marks and ends of sentence or line; marks that cutters leave.
PATTERNS = {
    "tokens": r"[a-zA-Z\p{L}\p{M}][a-zA-Z\p{L}\p{M}\p{N}]*+(?:['’][\p{L}\p{M}]++)*+|[0-9\p{N}]++(?:[.,:]\p{N}++)*+|(?:[.!?…]\s|[.!?…]$|\n)(?:[.!?…\s])*+|[,;:–—/|•·]",
    "mark": r"(?:\s*(?:\.{3,}|…|\[\.\.\.\]|\[…\]|\uFFFD+))+\s*$",
    "link": r"(?:://|www\.|@)\S*$",
    "number": r"^\p{N}",
    "ended": r"^[\s.!?…]",
    "listed": r"^[,;:–—/|•·]",
    "name": r"^\p{Lu}",
    "open": r"(?:[\p{L}\p{M}\p{N},:–—/|(\[“„&)\]%+”\"»-]|\p{L}['’])$",
    "names": r"^[\s*•·-]*\p{Lu}[\p{L}\p{M}'’.-]*(?: +(?:&|\p{Lu}[\p{L}\p{M}'’.-]*))*$",
}

EVIDENCE = 4  # occurrences elsewhere that a level needs to decide
LONGER = 30  # times more often that longer words start so than the word itself occurs, for a last word to be cut
STOPS = 0.12  # share of stops below which an ending counts as a cut


# the levels of one trigram (a, b, c), each word with l, its lower case, and u, whether it is written as a name; the words of level 0 lie
# by their first letter, so that those a last word may begin lie together but not all in one place
LEVELS = """array(
            named_struct('level', 3, 'k', concat_ws(' ', a.l, b.l), 'w', c.l), named_struct('level', 2, 'k', b.l, 'w', c.l),
            named_struct('level', 1, 'k', concat_ws(' ', if(a.u, 'X', a.l), if(b.u, 'X', b.l)), 'w', if(c.u, 'X', c.l)), named_struct('level', 0, 'k', left(c.l, 1), 'w', c.l))"""


def ends(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, marked, level, share, cut) of every text that does not end in a sentence's closing punctuation, a semicolon or a link.

    level names what decided: 3 trigram, 2 bigram, 1 trigram with names masked, 0 word, null nothing.
    """
    spark = documents.sparkSession
    view, split_view = (f"{x}_{uuid.uuid4().hex}" for x in ("texts", "split"))
    documents.createTempView(view)
    # the tokens are written once, as four parts of the statement below read them
    split_texts = written(spark.sql(
        f"""
        with texts as (
          select `{key}` as id, rtrim(replace(`{text}`, char(13), '')) as t from {view} where trim(`{text}`) <> ''
        ), bodies as (
          select id, t, case when substr(t, -40) rlike :mark then regexp_replace(t, :mark, '') else t end as body from texts
        )
        select id, t <> body as marked, body rlike :link as linked, right(body, 2) rlike :open as open_end, substring_index(body, char(10), -1) rlike :names as named,
          concat(array(named_struct('l', '¶', 'u', false), named_struct('l', '¶', 'u', false)), transform(regexp_extract_all(body, :tokens, 0), x -> case
            when left(x, 1) between 'a' and 'z' then named_struct('l', lower(x), 'u', false) when left(x, 1) between 'A' and 'Z' then named_struct('l', lower(x), 'u', true)
            when x rlike :number then named_struct('l', '#', 'u', false) when x rlike :ended then named_struct('l', '¶', 'u', false) when x rlike :listed then named_struct('l', ',', 'u', false)
            else named_struct('l', lower(x), 'u', x rlike :name) end)) as w
        from bodies
        """,
        args=PATTERNS,
    ))
    spark.catalog.dropTempView(view)
    split_texts.createTempView(split_view)
    result = spark.sql(
        f"""
        with split_ as (
          select * from {split_view}
        ), grams as (
          select id, g.* from split_ lateral view explode(transform(sequence(2, greatest(2, size(w) - 1)), i -> struct(
            get(w, i - 2) as a, get(w, i - 1) as b, get(w, i) as c, coalesce(get(w, i + 1).l not in ('¶', ','), false) as goes_on))) as g
          where g.c.l not in ('¶', ',')
        ), counted as (
          select a, b, c, sum(cast(goes_on as bigint)) as goes_on, sum(cast(not goes_on as bigint)) as stops from grams group by a, b, c
        ), levels as (
          select l.level, l.k, l.w, sum(goes_on) as goes_on, sum(stops) as stops from counted lateral view inline({LEVELS}) l as level, k, w group by l.level, l.k, l.w
        ), asked as (
          select id, marked, element_at(w, -3) as a, element_at(w, -2) as b, element_at(w, -1) as c, element_at(w, -1).l = ',' as open_, named
          from split_
          where size(w) > 2 and not linked and (element_at(w, -1).l <> '¶' or marked) and (marked or open_end)
        ), wanted as (
          select distinct l.level, l.k, l.w from asked lateral view inline({LEVELS}) l as level, k, w
        ), near_ as (
          select l.level, l.k, l.w, l.goes_on, l.stops from levels l left semi join (select distinct level, k from wanted) q on l.level = q.level and l.k = q.k
        ), prefixes as (
          select level, k, p.n as w, sum(case when p.n = w then goes_on else 0 end) as goes_on, sum(case when p.n = w then stops else 0 end) as stops,
            sum(case when p.n = w then 0 else goes_on + stops end) as longer
          from near_ lateral view inline(transform(sequence(case when level = 1 then length(w) else 1 end, length(w)), i -> named_struct('n', left(w, i)))) p as n
          group by level, k, p.n
        ), judged as (
          select q.level, q.k, q.w, coalesce(p.goes_on, 0) as goes_on, greatest(coalesce(p.stops, 0) - 1, 0) as stops, coalesce(p.longer, 0) as longer
          from wanted q left join prefixes p on q.level = p.level and q.k = p.k and q.w = p.w
        ), best as (
          select a.id, a.marked, a.open_, a.named,
            max_by(named_struct('level', j.level, 'share', j.stops / (j.goes_on + j.stops + j.longer)), case j.level when 1 then 2.5 else j.level end)
              filter (where j.goes_on + j.stops + j.longer >= {EVIDENCE}) as j,
            bool_or(j.level in (0, 2) and j.longer >= {EVIDENCE} and j.longer > {LONGER} * (j.goes_on + j.stops)) as inside
          from (select id, marked, open_, named, l.* from asked lateral view inline({LEVELS}) l as level, k, w) a
          join judged j on a.level = j.level and a.k = j.k and a.w = j.w
          group by a.id, a.marked, a.open_, a.named
        )
        select id as `{key}`, marked, j.level as level, j.share as share,
          case when open_ then true
            when j.level = 3 and not named then j.share < case when marked then 0.5 else {STOPS} end
            when inside then true
            when named then marked
            when j is null then marked
            else j.share < case when marked then 0.5 else {STOPS} end end as cut
        from best
        """,
        args=PATTERNS,
    )
    spark.catalog.dropTempView(split_view)
    return result


def cut_texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    """The keys of the texts that were cut."""
    return ends(documents, key, text).where("cut").select(key)


def by_source(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(source, texts, cut, share): how often each source cuts."""
    cut = cut_texts(documents, key, text).distinct().withColumnRenamed(key, "__key")
    joined = documents.select(key, source).join(cut, F.col(key) == F.col("__key"), "left")
    return joined.groupBy(source).agg(F.count("*").alias("texts"), F.count("__key").alias("cut"), (F.count("__key") / F.count("*")).alias("share"))
