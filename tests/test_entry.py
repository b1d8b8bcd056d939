import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 125


@pytest.mark.parametrize("name", ["review_aspect_units", "aspect_metrics_all", "beta_priors_sparse", "clause_segments", "multilabel_report", "grouped_split"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in "nation customer part orders lineitem documents embeddings".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    rows = lambda found, names: sorted(tuple(text(r[names.index(c)]) for c in columns) for r in found)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)
