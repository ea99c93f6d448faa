"""NOT IN and OR joins: the same rows as Spark gives, by plans that grow with the data."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import scaling
from lodestone.operators.joins import join_any, not_in, partner_counts
from lodestone.plans import registry, relational
from lodestone.sources.adapters import SparkAdapter
from lodestone.sources.catalog import Catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    catalog = Catalog(spark)
    catalog.add("aa", spark.createDataFrame([(1, 10, "x"), (1, 10, "x"), (2, None, "y"), (None, 30, "z"), (3, 10, None), (4, 40, "w")], "id int, k int, s string"))
    catalog.add("bb", spark.createDataFrame([(1, 10, "x"), (2, 20, "q"), (2, 20, "q"), (None, 30, "z"), (5, None, "w")], "id int, m int, s string"))
    catalog.add("cc", spark.createDataFrame([(10, "ten"), (20, "twenty"), (30, None)], "code int, label string"))
    catalog.add("nothing", spark.createDataFrame([], "id int, k int"))
    catalog.register()
    return catalog


NOT_IN = [
    "SELECT id FROM aa WHERE id NOT IN (SELECT m FROM bb)",
    "SELECT id FROM aa WHERE id NOT IN (SELECT m FROM bb WHERE m IS NOT NULL)",
    "SELECT id, k FROM aa WHERE k NOT IN (SELECT m FROM bb WHERE m IS NOT NULL) AND s LIKE '%'",
    "SELECT * FROM aa WHERE k NOT IN (SELECT id FROM nothing)",
    "SELECT aa.id FROM aa JOIN bb ON aa.id = bb.id WHERE aa.k NOT IN (SELECT code FROM cc WHERE code > 10) AND bb.s NOT IN (SELECT s FROM aa WHERE s > 'x')",
    "SELECT count(*) AS n FROM aa WHERE lower(s) NOT IN (SELECT s FROM bb)",
    "SELECT s FROM aa WHERE k * 2 NOT IN (SELECT code FROM cc) GROUP BY s ORDER BY s LIMIT 2",
]
KEPT = [
    "SELECT id FROM aa WHERE id NOT IN (SELECT m FROM bb) OR k = 10",
    "SELECT id FROM aa WHERE id NOT IN (SELECT bb.id FROM bb WHERE bb.m = aa.k)",
    "SELECT id FROM aa WHERE (id, k) NOT IN (SELECT id, m FROM bb)",
    "SELECT id FROM aa WHERE id NOT IN (1, 2)",
    "SELECT id, id NOT IN (SELECT m FROM bb WHERE m IS NOT NULL) AS t FROM aa",
    "SELECT code FROM cc JOIN bb ON code = m OR code = id WHERE EXISTS (SELECT 1 FROM aa WHERE aa.k = code)",  # the outer name would be lost
    "SELECT id FROM aa WHERE k - id NOT IN (SELECT m FROM bb WHERE m IS NOT NULL)",
]
OR_JOINS = [
    "SELECT aa.id, bb.id AS other FROM aa JOIN bb ON aa.id = bb.id OR aa.k = bb.m",
    "SELECT a.id, b.m FROM aa AS a INNER JOIN bb b ON (a.id = b.id OR a.k = b.m OR a.s = b.s) WHERE a.id IS NOT NULL ORDER BY b.m",
    "SELECT k, m FROM aa JOIN bb ON k = m OR aa.s = bb.s AND aa.id = bb.id",
    "SELECT label, count(*) AS n, sum(k) AS t FROM aa JOIN bb ON aa.id = bb.id OR aa.k = bb.m JOIN cc ON cc.code = aa.k GROUP BY label",
    "SELECT label FROM aa JOIN bb ON aa.id = bb.id JOIN cc ON cc.code = aa.k OR cc.code = bb.m",
    "SELECT a.* FROM aa a JOIN aa b ON a.id = b.k OR a.k = b.k",
]


def rows(df):
    return Counter(map(str, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sql", NOT_IN + OR_JOINS)
def test_rewritten_statements_give_the_same(spark, tables, sql):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = scaling.rewritten(spark, sql)
        assert new != sql and rows(spark.sql(new)) == rows(spark.sql(sql)) and spark.sql(new).columns == spark.sql(sql).columns
        text = plan(spark.sql(new))
        assert "NestedLoop" not in text and "Cartesian" not in text and "BroadcastHashJoin" not in text, text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("sql", [*KEPT, "SELECT * FROM aa", "SELECT a.id FROM aa a LEFT JOIN bb b ON a.id = b.id OR a.k = b.m", "SELECT * FROM aa JOIN bb ON aa.id = bb.id OR aa.k = bb.m", "no sql (", "SELECT 'x NOT IN (SELECT'"])
def test_other_statements_stay(spark, tables, sql):
    assert scaling.rewritten(spark, sql) == sql


@pytest.mark.parametrize("name", ["anti_not_in", "join_or_condition", "join_or_direct"])
def test_registered_queries_need_no_large_broadcast(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(registry.QUERIES[name](spark, SF))
        assert "NestedLoop" not in text and "Cartesian" not in text and "BroadcastHashJoin" not in text, text
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_adapter_rewrites(spark, tables):
    for dialect in (False, True):
        got = SparkAdapter(tables, dialect=dialect).query("SELECT id FROM aa WHERE k NOT IN (SELECT m FROM bb WHERE m IS NOT NULL)")
        assert got.error is None and sorted(r["id"] for r in got.df.collect()) == [4]


@pytest.mark.parametrize("values", [[], [1], [1, None], [None], [7, 8]])
def test_not_in_frames(spark, tables, values):
    left = tables.frames["aa"]
    right = spark.createDataFrame([(v,) for v in values], "v int")
    right.createOrReplaceTempView("vv")
    assert rows(not_in(left, "id", right, "v")) == rows(spark.sql("SELECT * FROM aa WHERE id NOT IN (SELECT v FROM vv)"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_any_frames(spark, tables, how):
    a, b = tables.frames["aa"].toDF("a1", "a2", "a3"), tables.frames["bb"].toDF("b1", "b2", "b3")
    branches = [F.col("a1") == F.col("b1"), F.col("a2") == F.col("b2"), (F.col("a3") == F.col("b3")) & (F.col("a1") > 0)]
    assert rows(join_any(a, b, branches, how)) == rows(a.join(b, branches[0] | branches[1] | branches[2], how))


# Windows without a partition


WINDOWS = [
    "SELECT id, k, rank() OVER (ORDER BY k) AS place FROM aa",
    "SELECT id, RANK() OVER (ORDER BY k DESC) AS place, dense_rank() OVER (ORDER BY s) AS other FROM aa WHERE id IS NOT NULL",
    "SELECT a.s, rank() OVER (ORDER BY a.k * 2 DESC NULLS FIRST) AS place FROM aa AS a JOIN bb ON a.id = bb.id ORDER BY place DESC, s LIMIT 3",
    "SELECT id, k - avg(k) OVER () AS above, count(*) OVER () AS n, 100.0 * k / sum(k) OVER () AS share FROM aa WHERE k > 5",
    "SELECT id, sum(k) OVER (ORDER BY id) AS so_far FROM aa",
    "SELECT id, SUM(k) OVER (ORDER BY id DESC) AS so_far, rank() OVER (ORDER BY s DESC) AS place FROM aa",
]
GATHERED = [
    "SELECT id, rank() OVER (PARTITION BY s ORDER BY k) AS place FROM aa",
    "SELECT s, rank() OVER (ORDER BY count(*)) AS place FROM aa GROUP BY s",
    "SELECT id, 1 + rank() OVER (ORDER BY k) AS place FROM aa",
    "SELECT id, rank() OVER (ORDER BY k, s) AS place FROM aa",
    "SELECT id, lag(k) OVER (ORDER BY id) AS before FROM aa",
    "SELECT id, sum(k) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS so_far FROM aa WHERE id > 1",
    "SELECT rank() OVER (ORDER BY k) AS place FROM aa ORDER BY id",
]


def values(df):
    return Counter(tuple(map(str, r)) for r in df.collect())


@pytest.mark.parametrize("sql", WINDOWS)
def test_windows_by_ranges(spark, tables, sql):
    got, want = scaling.run(spark, sql), spark.sql(sql)
    assert got.columns == want.columns and values(got) == values(want)
    assert "SinglePartition" in plan(want)
    text = plan(got)
    gathered = [line for line in text.splitlines() if "Window " in line and "specifiedwindowframe" in line and "_span" not in line]
    assert not gathered, text


@pytest.mark.parametrize("sql", GATHERED)
def test_other_windows_stay(spark, tables, sql):
    assert values(scaling.run(spark, sql)) == values(spark.sql(sql))


def test_row_numbers_are_a_permutation(spark, tables):
    rows = scaling.run(spark, "SELECT k, row_number() OVER (ORDER BY k) AS at FROM aa").collect()
    assert sorted(r["at"] for r in rows) == list(range(1, 7))
    assert [r["k"] for r in sorted(rows, key=lambda r: r["at"])] == [None, 10, 10, 10, 30, 40]


def test_ranks_through_the_adapter(spark, tables):
    got = SparkAdapter(tables, dialect=True).query("SELECT s, RANK() OVER (ORDER BY k DESC) AS place FROM aa WHERE k IS NOT NULL ORDER BY place, s")
    assert [tuple(r) for r in got.df.collect()] == [("w", 1), ("z", 2), (None, 3), ("x", 3), ("x", 3)]


COUNTED = [
    "SELECT label, count(*) AS n FROM aa JOIN bb ON aa.id = bb.id OR aa.k = bb.m AND aa.s < bb.s JOIN cc ON code = k GROUP BY label",
    "SELECT count(*) FROM aa JOIN bb ON k = m AND aa.id <= bb.id OR aa.s = bb.s OR aa.id = bb.id",
    "SELECT b.m, COUNT(*) AS n, count(*) AS again FROM aa AS a INNER JOIN bb b ON (a.s = b.s AND b.id > a.id OR a.k = b.m) WHERE b.m IS NOT NULL GROUP BY b.m HAVING count(*) > 1 ORDER BY count(*), b.m LIMIT 5",
    "SELECT a.s, count(*) AS n FROM aa a JOIN aa b ON a.id = b.k OR a.k = b.k AND a.id >= b.id GROUP BY a.s",
    "SELECT count(*) AS n FROM aa JOIN nothing ON aa.id = nothing.id OR aa.k = nothing.k AND aa.id < nothing.id",
]
PAIRS_WANTED = [
    "SELECT bb.id, count(*) AS n FROM aa JOIN bb ON aa.id = bb.id OR aa.k = bb.m GROUP BY bb.id, aa.id",
    "SELECT count(*) AS n, sum(k) AS t FROM aa JOIN bb ON aa.id = bb.id OR aa.k = bb.m",
    "SELECT aa.s FROM aa JOIN bb ON aa.id = bb.id OR aa.k = bb.m",
    "SELECT count(*) AS n FROM aa JOIN bb ON aa.id = bb.id OR aa.k = bb.m + 1",
    "SELECT count(*) AS n FROM aa JOIN bb ON aa.id = bb.id AND aa.k < bb.m OR aa.s = bb.s AND aa.id < bb.id",
    "SELECT count(*) AS n FROM aa JOIN bb USING (id)",
]


@pytest.mark.parametrize("sql", COUNTED)
def test_counted_pairs_are_not_made(spark, tables, sql):
    found = scaling._without_pairs(spark, sql)
    assert found is not None and found.columns == spark.sql(sql).columns and rows(found) == rows(spark.sql(sql)) == rows(scaling.run(spark, sql))


@pytest.mark.parametrize("sql", PAIRS_WANTED)
def test_other_pairs_are_made(spark, tables, sql):
    assert scaling._without_pairs(spark, sql) is None and rows(scaling.run(spark, sql)) == rows(spark.sql(sql))


def test_a_later_join_by_a_column_without_its_table(spark, tables):
    sql = "SELECT label, bb.id FROM aa JOIN bb ON aa.id = bb.id OR aa.k = m JOIN cc ON code = k"
    assert scaling.rewritten(spark, sql) != sql and rows(scaling.run(spark, sql)) == rows(spark.sql(sql))


@pytest.mark.parametrize("sign", ["<", "<=", ">", ">="])
def test_partners_in_an_order(spark, sign):
    values = [None, float("nan"), float("inf"), -0.0, 0.0, *[i / 4 for i in range(-9, 9)]]
    left = spark.createDataFrame([(i, i % 3 or None, values[i % len(values)]) for i in range(80)], "id int, k int, x double")
    right = spark.createDataFrame([(i % 4, values[i * 7 % len(values)]) for i in range(90)], "m int, y double")
    want = left.join(right, F.expr(f"k = m AND x {sign} y")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    for ranges in (3, 256):
        assert rows(partner_counts(left, right, [("k", "m")], ("x", sign, "y"), "n", ranges).select("id", "n")) == rows(want)


def test_three_branches_make_no_pairs(spark):
    for name, key, shift in (("supplier", "s_suppkey", 10), ("customer", "c_custkey", 150), ("nation", "n_nationkey", None)):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        many = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn(key, F.col(key) + F.col("_i") * shift).drop("_i") if shift else df
        many.createOrReplaceTempView(name)
    sql = relational.SAME["join_or_three"]
    df = scaling.run(spark, sql)
    text = plan(df)
    assert rows(df) == rows(spark.sql(sql)) and "NestedLoop" not in text and "Cartesian" not in text, text
