"""Every core query against its SQL on the small tables, by sorted rows."""

import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False, name=None))


def names():
    from watchgrid import catalogs

    # those without SQL have tests of their own
    return sorted(k for c in catalogs.ALL for k in c.oracle_sql())


@pytest.mark.parametrize("name", names())
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from watchgrid import catalogs

    queries, sql = ({k: v for c in catalogs.ALL for k, v in getattr(c, kind)().items()} for kind in ("queries", "oracle_sql"))
    con = duckdb.connect()
    for t in ("events", "customer", "part", "documents", "nation", "pages", "supplier", "orders", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = rows(queries[name](spark, SF).toPandas()), rows(con.sql(sql[name]).df())
    assert got == want
