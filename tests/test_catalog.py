from pathlib import Path

import pytest

from spanforge.plans import catalog

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


def test_sql_belongs_to_queries():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.oracle_sql()) > 30


@pytest.mark.parametrize("name", ["rank_top_candidates", "skills_in_lists", "tenure_credit", "requirement_tiers", "bullet_lines", "merged_proposal_spans", "written_degrees"])
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        db.execute(f"create view {f.stem} as select * from '{f}'")
    got = catalog.queries()[name](spark, str(DATA)).toPandas()
    want = db.execute(catalog.oracle_sql()[name]).df()
    key = lambda d: sorted(map(repr, d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)))
    text = lambda d: d.map(lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    assert key(text(got)) == key(text(want))
