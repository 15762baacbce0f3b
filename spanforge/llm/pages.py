"""Problem 4: page boilerplate mixed with main content.

A page is a tree of lines and of the items on a line. Spark hashes every subtree in
two forms (digits masked; names masked too), counts it per site, over all sites and
over documents that came without a page, and deletes subtrees that recur across many
sites' pages but not in bare documents, or on a share of a site's different pages.
Lines of no evidence follow their neighbours if those agree.

Texts are taken apart once, into a table of 64-bit hashes: two subtrees that share a
hash would only share their counts. The counts weigh as rates: what stands on PAGES
pages but in no bare document is only boilerplate where bare documents are many enough
to have shown it.

Defined results: rows without url or text, and pages with no sign of a posting, give
no rows; blank lines are never cases; repeated rows count over all sites as pages of
their own, but a site's pages that differ in digits only are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import written

SITE_PAGES = 3  # different pages of one site that a subtree has to recur on, at least
SITE_SHARE = 0.02  # share of a site's different pages that it has to recur on
PAGES = 8  # pages of any sites
CONTRAST = 12  # times more frequent on pages than in bare documents
POSTING_LINES = 3  # lines known from bare documents that make a posting; the title alone does, too
ITEMS = r"\s+[|/·›>•]\s+|\s{2,}"


def site(url: Column) -> Column:
    """The registered name of a url's host: its last two labels, three after a short second-level one such as co."""
    host = F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.coalesce(F.nullif(F.regexp_extract(host, r"([^.]+\.(?:co|com|org|net|ac|gov)\.[^.]+)$", 1), F.lit("")), F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")), host)


def _content(text: str) -> Column:
    """A hash of a page that its copies share: its text with digits masked."""
    return F.xxhash64(F.regexp_replace(F.lower(F.col(text)), r"\p{N}+", "#"))


def _lines(jobs: DataFrame, key: str, text: str, url: str, title: str) -> DataFrame:
    own = F.regexp_extract("site", r"^([^.]+)", 1)
    line = F.trim(F.regexp_replace("line", r"^[\s\x{FEFF}]+|[\s]+$", ""))
    plain = F.regexp_replace(F.when(F.length("own") > 2, F.replace(F.lower("line"), F.col("own"), F.lit("§"))).otherwise(F.lower("line")), r"\p{N}+", "#")
    named = F.regexp_replace(F.regexp_replace("line", r"\p{N}+", "#"), r"\p{Lu}[\p{L}\p{M}\p{N}'’#-]*", "X")
    return (
        jobs.select(F.col(key).alias("key"), F.coalesce(site(F.col(url)), F.lit("")).alias("site"), F.lower(F.trim(F.col(title))).alias("title"), F.col(text).alias("text"), _content(text).alias("content"))
        .select("key", "site", "title", "content", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .withColumns({"line": line, "own": own})
        .where(F.col("line") != "")
        .withColumn("is_title", F.coalesce(F.lower("line") == F.col("title"), F.lit(False)))
        .withColumns({"plain": F.when(F.col("is_title"), F.lit("\x01")).otherwise(plain), "named": F.when(F.col("is_title"), F.lit("\x01")).otherwise(named)})
        .withColumn("items", F.filter(F.split("plain", ITEMS), lambda x: F.length(x) > 1))
        .select(
            "key", "site", "content", "line_no", "is_title", F.xxhash64("plain").alias("plain"), F.xxhash64("named").alias("named"), F.col("named").rlike(r"\p{Ll}{2}").alias("worded"),
            F.when(F.size("items") > 1, F.transform("items", lambda x: F.xxhash64(x))).alias("items"),
        )
        .withColumn("tree", F.xxhash64("site", "plain", "named"))
    )


def _recurs(a: Column, b: Column, pages: Column, bare: Column) -> Column:
    """Whether a subtree on a of `pages` pages and b of `bare` bare documents belongs to pages."""
    return (a >= PAGES) & ((a / F.greatest(pages, F.lit(1))) > CONTRAST * (b + F.when(bare > 0, 0.5).otherwise(0)) / F.greatest(bare, F.lit(1)))


def judged_lines(jobs: DataFrame, key: str = "id", text: str = "raw_text", url: str = "source_url", title: str = "title") -> DataFrame:
    """(key, line_no, main): every non-blank line of the pages that hold a posting; main is whether it belongs to the posting."""
    lines = written(_lines(jobs, key, text, url, title))
    on_page = F.col("site") != ""
    pages_of = lines.where(on_page).groupBy("site").agg(F.countDistinct("content").alias("of_site"))
    totals = jobs.agg(F.count_if((site(F.col(url)) != "") & F.col(text).isNotNull()).alias("pages"), F.count_if(F.coalesce(site(F.col(url)), F.lit("")) == "").alias("bare"))
    # one row for each subtree of a site; the counts over everything come from these few
    once = lines.groupBy("tree", "content").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("site", "plain", "named", "worded", "items")])
    by_site = written(once.groupBy("tree").agg(F.sum("n").alias("n"), F.count("*").alias("contents"), *[F.first(c).alias(c) for c in ("site", "plain", "named", "worded", "items")]))
    page, bare = F.sum(F.when(on_page, F.col("n")).otherwise(0)), F.sum(F.when(on_page, 0).otherwise(F.col("n")))
    plain = by_site.groupBy("plain").agg(page.alias("a1"), bare.alias("b1"))
    named = by_site.groupBy("named").agg(page.alias("a2"), bare.alias("b2"))
    items = by_site.select("site", "n", F.explode(F.coalesce("items", F.array("plain"))).alias("item")).groupBy("item").agg(page.alias("a"), bare.alias("b")).crossJoin(F.broadcast(totals))
    known = items.select("item", F.when(_recurs(F.col("a"), F.col("b"), F.col("pages"), F.col("bare")), 1).otherwise(0).alias("hit"))
    menus = (
        by_site.where("items is not null").groupBy("plain").agg(F.first("items").alias("items")).select("plain", F.explode("items").alias("item"))
        .join(known, "item").groupBy("plain").agg(F.avg("hit").alias("menu"))
    )
    is_title = F.col("plain") == F.xxhash64(F.lit("\x01"))
    trees = (
        by_site.where(on_page).join(plain, "plain").join(named, "named").join(menus, "plain", "left").join(pages_of, "site").crossJoin(F.broadcast(totals))
        .select(
            "tree",
            F.when(is_title, 1.0)
            .when(_recurs(F.col("a1"), F.col("b1"), F.col("pages"), F.col("bare")), -1.0)
            .when(F.col("b1") > 0, 1.0)
            .when((F.col("contents") >= SITE_PAGES) & (F.col("contents") >= SITE_SHARE * F.col("of_site")), -1.0)
            .when(F.coalesce("menu", F.lit(0.0)) >= 0.5, -1.0)
            .when(F.col("worded") & _recurs(F.col("a2"), F.col("b2"), F.col("pages"), F.col("bare")), -1.0)
            .when(F.col("worded") & (F.col("b2") > 0), 1.0)
            .otherwise(0.0).alias("sign"),
            ((F.col("b1") > 0) & ~is_title).alias("seen"),
        )
    )
    at = Window.partitionBy("key").orderBy("line_no")
    whole = Window.partitionBy("key")
    near = lambda w: F.last(F.when(F.col("sign") != 0, F.col("sign")), ignorenulls=True).over(w)
    return (
        lines.where(on_page).select("key", "line_no", "is_title", "tree").join(trees, "tree")
        .withColumn("posting", F.sum(F.when(F.col("is_title"), POSTING_LINES).otherwise(F.col("seen").cast("int"))).over(whole))
        .where(F.col("posting") >= POSTING_LINES)
        .withColumns({
            "before": F.coalesce(near(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1.0)),
            "after": F.coalesce(near(Window.partitionBy("key").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1.0)),
        })
        .select(F.col("key").alias(key), "line_no", F.when(F.col("sign") != 0, F.col("sign") > 0).otherwise(~((F.col("before") < 0) & (F.col("after") < 0))).alias("main"), "sign")
    )


def main_text(jobs: DataFrame, key: str = "id", text: str = "raw_text", url: str = "source_url", title: str = "title") -> DataFrame:
    """(key, main_text): the posting of each page, its lines in order."""
    kept = judged_lines(jobs, key, text, url, title).where("main").groupBy(key).agg(F.sort_array(F.collect_list("line_no")).alias("kept"))
    joined = jobs.select(key, text).join(kept, key)
    lines = F.split(F.col(text), "\n", -1)
    return joined.select(key, F.array_join(F.transform("kept", lambda i: F.get(lines, i)), "\n").alias("main_text"))
