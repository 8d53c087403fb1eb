"""Every query with an oracle: Spark result == DuckDB result (sf0.001)."""
import duckdb
import pytest

import __spark_entry__ as entry
from helpers import SF_SMALL, norm
from squall.plans.oracle import SQL as REFERENCE

TABLES = "region nation customer supplier part orders lineitem events embeddings labels".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if k in REFERENCE}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, con, key):
    sp = entry.queries()[key](spark, SF_SMALL).toPandas()
    dd = con.execute(SQL[key]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    assert norm(sp) == norm(dd)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["series", "event", "start", "end", "duration_minutes", "meets_min_duration",
                          "min_duration_required_min"]
    assert df.count() > 0


def test_rows_only_queries_run(spark):
    for key in ("sample_rows", "gbt_importance"):
        assert entry.queries()[key](spark, SF_SMALL).count() > 0
