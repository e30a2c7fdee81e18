"""Every query that has SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from docmill import plans
from tests.conftest import SMALL


LARGER = "/root/testdata/sf0.01"
#: Queries that are also compared on larger tables: those whose rounding, ties or joins the smallest tables may not show.
ALSO_LARGER = ["fu_resolve", "fu_resolve_recent", "fu_resolve_weighted", "fu_merge_resolved", "rt_parse", "rt_decompose", "rt_plan", "rt_fact_first", "rt_community", "rt_community_tree", "rt_truthful", "rt_conflicts", "lb_rules"]


def connected(folder):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="module")
def duck():
    return connected(SMALL)


@pytest.fixture(scope="module")
def larger():
    return connected(LARGER)


def norm(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        df[c] = df[c].map(lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)).astype(object)
    rows = [tuple(None if v is None or v != v else v for v in r) for r in df.itertuples(index=False)]
    return list(df.columns), sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got, want = norm(plans.QUERIES[name](spark, SMALL).toPandas()), norm(duck.sql(plans.ORACLE[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", ALSO_LARGER)
def test_query_equals_sql_on_larger_tables(spark, larger, name):
    assert norm(plans.QUERIES[name](spark, LARGER).toPandas()) == norm(larger.sql(plans.ORACLE[name]).df())
