"""Registered queries against their SQL on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_point  # noqa: E402
from pedalgrid.plans import ORACLES, QUERIES  # noqa: E402
from tools.check import TABLES, rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "commune_coverage",
    "commune_mart",
    "crosstab_share",
    "density_grid",
    "distance_bands",
    "esri_rings",
    "key_resolution",
    "mode_reconstruct",
    "null_profile",
    "panel_union",
    "point_in_polygon",
    "ring_validity",
    "scope_kpi",
    "snapshot_diff",
]

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables not here")


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES) <= set(entry_point.oracle_sql())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["threshold", "pob", "pct_pob", "bici", "pct_bici"] and df.count() == 5


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry_point.queries()[name](spark, FOLDER)
    cur = con.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, want)
