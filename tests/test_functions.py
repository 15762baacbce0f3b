import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanforge.functions import dates, numeric, text
from spanforge.sources import documents, html


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("value", "digits", "wanted"), [(1.005, 2, 1.01), (2.5, 0, 3.0), (-2.5, 0, -2.0), (0.1 + 0.2, 6, 0.3), (1e15, 2, 1e15), (None, 2, None), (100.49999999999999, 0, 101.0)])
def test_round_half_up(spark, value, digits, wanted):
    assert one(spark, numeric.round_half_up(F.lit(value).cast("double"), digits)) == wanted


def test_rounding_refuses_infinity(spark):
    with pytest.raises(Exception, match="finite"):
        one(spark, numeric.round_half_up(F.lit(float("inf")), 2))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=200, max_size=200))
def test_rounding_equals_fifteen_digits(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", numeric.round_half_up(F.col("v"), 2).alias("r")).collect()
    assert all(r.r == math.floor(float(f"{r.v * 100:.14e}") + 0.5) / 100 for r in rows)


def test_scores(spark):
    assert one(spark, numeric.ratio_score(F.lit(3.0), F.lit(5))) == 0.6
    assert one(spark, numeric.ratio_score(F.lit(3.0), F.lit(0))) == 1.0
    assert one(spark, numeric.index_score(F.lit(1), F.lit(2))) == 0.5
    assert one(spark, numeric.degree_score(F.lit(None).cast("int"), F.lit(0))) == 0.0
    assert [one(spark, numeric.seniority_index(F.lit(y))) for y in (0, 2, 4.9, 5, 8, 12)] == [0, 1, 1, 2, 3, 4]


@pytest.mark.parametrize(
    ("token", "kind", "month"),
    [("13/04/2019", "resolved", 24232), ("04/13/2019", "resolved", 24232), ("03/04/2019", "ambiguous", None), ("13/25/2019", "invalid", None), ("Sept. 2001", "resolved", 24021), ("2019", "resolved", 24229), ("03.2019", "resolved", 24231), ("2019-13", "invalid", None), ("00/40/2019", "ambiguous", None), ("", "invalid", None)],
)
def test_dates(spark, token, kind, month):
    got = one(spark, dates.parse_date(F.lit(token)))
    assert (got.kind, got.month) == (kind, month)


def test_reference_month(spark):
    assert one(spark, dates.reference_month(F.lit("2019-12"))) == 24240
    assert one(spark, dates.reference_text(F.lit(24240))) == "2019-12"
    assert [one(spark, dates.reference_month(F.lit(x).cast("string"))) for x in ("2019-13", "2019-1", None, "")] == [None] * 4


def test_offsets(spark):
    got = one(spark, text.matches(F.lit("Ruby on Rails, ruby; RUBY"), "(?i)ruby"))
    assert [(m.start, m.end) for m in got] == [(0, 4), (15, 19), (21, 25)]
    assert one(spark, text.matches(F.lit("none"), "x")) == []
    s = "One. Two!\n\nThree"
    assert all(s[m.start : m.end] == m.text for m in one(spark, text.sentences(F.lit(s))))


def test_lines(spark):
    got = one(spark, text.line_segments(F.lit("a\n\n - x\n1. foo \n• b")))
    assert [(s.text, s.is_bullet) for s in got] == [("a", False), ("- x", False), ("foo", True), ("b", True)]


def test_strings(spark):
    assert one(spark, text.slug(F.lit("https://Www.Ex.com/a/Job_12?x=1"))) == "www-ex-com-job-12"
    assert one(spark, text.slug(F.lit("//"))) == "job"
    assert one(spark, text.strip_invisible(F.lit("a​b﻿ c"))) == "ab c"
    assert one(spark, text.visible_positions(F.lit("a​b"))) == [0, 2]
    assert one(spark, text.bearing_text(F.lit("mail a@b.c in 2020 to NASA via x/y now"))) == "mail in to via now"
    assert one(spark, text.plain_number(F.lit(3.0))) == "3"


def test_html(spark):
    page = "<html><head><title> A &amp; <b>B</b></title></head><body><!-- x --><p>one<br>two &#233; &#x41; &trade;</p><script>gone"
    assert one(spark, html.html_text(F.lit(page))) == "one\ntwo é A &trade;"
    assert one(spark, html.html_title(F.lit(page))) == "A & B"
    assert one(spark, html.html_title(F.lit("<p>none"))) is None


def test_json_ld(spark):
    bad = '<script type="application/ld+json">{broken</script>'
    good = '<script type="application/ld+json">[{"@type":"Thing"},{"@type":"JobPosting","title":"T","description":"<p>D</p>","skills":"S"}]</script>'
    got = one(spark, html.page(F.lit(f"<title>M</title>{bad}{good}")))
    assert (got.title, got.text, got.source) == ("T", "T\n\nD\n\nS", "json-ld")
    assert one(spark, html.page(F.lit(f"<title>M</title>{bad}<p>x"))).source == "markup"


def test_documents(spark, tmp_path):
    import zipfile

    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in/a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>Hello</w:t><w:tab/><w:t>you</w:t></w:p><w:p><w:t>there</w:t></w:p></w:document>')
    (tmp_path / "in/b.html").write_text("<p>Hi</p>")
    (tmp_path / "in/c.xyz").write_text("x")
    (tmp_path / "in/d.docx").write_text("no zip")
    files = documents.read_files(spark, str(tmp_path / "in"))
    got = {r.path[-6:]: (r.text, r.reason) for r in documents.extracted(files).collect()}
    assert got == {"a.docx": ("Hello\tyou\nthere", None), "b.html": ("Hi", None), "/c.xyz": (None, "unsupported_format"), "d.docx": (None, None)}
    for _ in range(2):
        documents.store(files, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 4
    assert documents.stored(spark, str(tmp_path / "store"), files.first().sha256).count() == 1


def test_parse_judgement(spark):
    status = lambda t, lang: one(spark, documents.judged(F.lit(t), 0.9, F.lit(lang).cast("string"))).status
    assert [status("", "en"), status("short", "en"), status("x" * 200, "en"), status("x" * 200, "de"), status("x" * 200, None)] == ["failed", "needs_attention", "ok", "needs_attention", "needs_attention"]
