"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(df):
    columns = sorted(df.columns)

    def value(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        return repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)

    return columns, sorted(tuple(value(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    got = plain(registry.QUERIES[name](spark, SF).toPandas())
    want = plain(duck.sql(registry.ORACLE_SQL[name]).df())
    assert got == want


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark, capsys):
    registry.QUERIES["filter_between"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "GreaterThanOrEqual(l_quantity,10.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan


def test_profile_reads_a_table_once_and_each_column_alone(spark, capsys):
    from lodestone.operators.profile import column_stats

    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    column_stats(df, "lineitem", approximate=True).explain()
    assert capsys.readouterr().out.count("FileScan") == 1
    column_stats(df, "lineitem").explain("formatted")
    schemas = [line for line in capsys.readouterr().out.splitlines() if "ReadSchema" in line]
    assert len(schemas) == 1 + len(df.columns) and sum("," not in s for s in schemas) == len(df.columns)


def test_distinct_counts_of_a_computed_table(spark):
    from lodestone.operators.profile import column_stats

    df = spark.range(100).selectExpr("id % 7 AS a", "repeat(cast(id % 5 AS STRING), 50) AS b").groupBy("a", "b").count()
    assert [r["distinct_count"] for r in column_stats(df, "t").collect()] == [7, 5, 2]
