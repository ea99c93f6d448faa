"""Profiles from merged sketches against exact ones; heavy values against a full grouping."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import sketches
from lodestone.operators.profile import column_stats

SF = "/root/testdata/sf0.01"
EXACT = ["row_count", "null_count", "empty_count", "whitespace_count", "filled_count", "numeric_looking_count", "min_value", "max_value"]


def by_column(df):
    return {r["column_name"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def rows(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    return orders.withColumns({"spaced": F.when(F.col("o_orderkey") % 9 == 0, " x ").when(F.col("o_orderkey") % 9 == 1, "").when(F.col("o_orderkey") % 9 == 2, "12"), "nothing": F.lit(None).cast("double"), "part": F.col("o_orderkey") % 2})


def check(got, rows):
    exact = by_column(column_stats(rows, "t"))
    assert got.keys() == exact.keys()
    for name, want in exact.items():
        own = got[name]
        assert [own[c] for c in EXACT] == [want[c] for c in EXACT], name
        assert own["null_percent"] == pytest.approx(want["null_percent"]) and own["avg_value"] == pytest.approx(want["avg_value"])
        assert abs(own["distinct_count"] - want["distinct_count"]) <= max(1, 4 * sketches.DISTINCT_ERROR * want["distinct_count"]), name
    values = sorted(r[0] for r in rows.select("o_totalprice").collect() if r[0] is not None)
    for q, v in zip(sketches.QUANTILES, got["o_totalprice"]["quantiles"]):
        low, high = sum(x < v for x in values) / len(values), sum(x <= v for x in values) / len(values)
        assert low - 3 * sketches.RANK_ERROR <= q <= high + 3 * sketches.RANK_ERROR
    mean = sum(values) / len(values)
    assert got["o_totalprice"]["deviation"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in values) / len(values)), rel=1e-6)
    assert got["nothing"]["quantiles"] is None and got["nothing"]["distinct_count"] == 0


def test_two_halves_equal_the_whole(spark, rows, tmp_path):
    path, store = f"{tmp_path}/t", sketches.ProfileStore(spark, f"{tmp_path}/store")
    rows.filter("part = 0").repartition(2).write.parquet(path)
    assert len(store.update("t", path)) == 2
    check(by_column(store.stats("t", path)), spark.read.parquet(path))
    rows.filter("part = 1").repartition(3).write.mode("append").parquet(path)
    new = store.update("t", path)
    assert len(new) == 3 and store.update("t", path) == []  # only new files are read, and once
    check(by_column(store.stats("t", path)), spark.read.parquet(path))
    parts = [sketches.file_sketches(spark.read.parquet(path).filter(f"part = {i}"), "t") for i in (0, 1)]
    merged = by_column(sketches.merged(parts[0].union(parts[1])))
    whole = by_column(sketches.merged(sketches.file_sketches(spark.read.parquet(path), "t")))
    assert all(merged[c]["row_count"] == whole[c]["row_count"] and merged[c]["distinct_count"] == pytest.approx(whole[c]["distinct_count"], rel=0.1) for c in whole)
    assert store.document({"t": path})["t"]["o_orderkey"]["row_count"] == rows.count()


def test_files_that_go_and_change(spark, tmp_path):
    path, store = f"{tmp_path}/t", sketches.ProfileStore(spark, f"{tmp_path}/store")
    spark.range(100).coalesce(1).write.parquet(path)
    store.update("t", path)
    spark.range(1000, 1010).coalesce(1).write.mode("overwrite").parquet(path)
    assert len(store.update("t", path)) == 1
    got = by_column(store.stats("t", path))["id"]
    assert (got["row_count"], got["min_value"], got["max_value"], got["distinct_count"]) == (10, 1000.0, 1009.0, 10)


def test_an_interrupted_update_does_not_count(spark, tmp_path):
    path, store = f"{tmp_path}/t", sketches.ProfileStore(spark, f"{tmp_path}/store")
    spark.range(50).coalesce(1).write.parquet(path)
    sketches.file_sketches(spark.read.parquet(path), "t").write.parquet(f"{tmp_path}/store/parts/00000000")
    (tmp_path / "store/parts/00000000/_SUCCESS").unlink()
    assert len(store.update("t", path)) == 1
    assert by_column(store.stats("t", path))["id"]["row_count"] == 50


@pytest.mark.parametrize("kind", ["skewed", "flat", "few", "empty"])
def test_heavy_hitters_equal_a_grouping(spark, kind):
    rng = random.Random(kind)
    n = {"skewed": 30_000, "flat": 5_000, "few": 400, "empty": 0}[kind]
    values = [None if rng.random() < 0.1 else int(rng.paretovariate(0.6)) if kind == "skewed" else i if kind == "flat" else rng.randrange(5) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    want = sorted(Counter(str(v) for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:7]
    got = sketches.heavy_hitters(df, "v", 7, most=40)
    assert [tuple(r) for r in got.collect()] == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ("LeftSemi" in plan) == (kind == "skewed")  # else nothing can be ruled out, or no counter was dropped


def test_counters_are_too_low_by_the_slack_at_most(spark):
    rng = random.Random(1)
    values = [int(rng.paretovariate(0.8)) for _ in range(20_000)]
    true, got, slack = Counter(map(str, values)), Counter(), 0
    for r in sketches.counters(spark.createDataFrame([(v,) for v in values], "v long").repartition(4), "v", 50).collect():
        slack += r["slack"]
        if r["value"] is not None:
            got[r["value"]] += r["n"]
    assert 0 < slack <= len(values) / 51 and all(true[v] - slack <= got[v] <= true[v] for v in true)


@pytest.mark.parametrize("values", [[5], [1, 1, 1, 2], list(range(101)), [i % 7 for i in range(50)], [None, 3, 9, None, 4], [0.5 * i * i for i in range(30)]])
def test_ranks_hold_as_percentiles_do(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    for share, error in ((0.5, 0.04), (0.5, 0.0), (0.1, 0.3), (0.9, 0.02)):
        low, high = df.agg(F.percentile("x", max(0.0, share - error)), F.percentile("x", min(1.0, share + error))).first()
        tried = sorted({float(v) for v in values if v is not None})
        tried = tried[:: max(1, len(tried) // 6)] + [tried[0] - 1, tried[-1] + 1, (tried[0] + tried[-1]) / 2 + 0.01]
        wide = df.select(*[F.col("x").alias(f"x{i}") for i in range(len(tried))])
        got = {r["column_name"]: r["holds"] for r in sketches.ranks_hold(wide, {f"x{i}": v for i, v in enumerate(tried)}, share, error).collect()}
        assert got == {f"x{i}": low <= v <= high for i, v in enumerate(tried)}, (share, error)


def test_the_median_check_gathers_no_column(spark):
    from lodestone.plans import registry

    text = registry.QUERIES["merged_profile_orders"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in text
    assert sketches.ranks_hold(spark.range(3), {}, 0.5, 0.1).count() == 0
