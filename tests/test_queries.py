import os

import duckdb
import pytest

import __spark_entry__ as entry
from tideline.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = ["site_month_days", "min_denominator_shift", "cum_count_study", "bootstrap_weights", "study_bounds", "ref_bounds_per_target", "bounds_long", "map_exclusion_source", "screening_failures_md5"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_names():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    text = lambda df: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in row) for row in df[columns].itertuples(index=False))
    assert text(got) == text(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
