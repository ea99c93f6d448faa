"""Places and running sums by ranges against sorted rows, for every type of key."""

import datetime
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ranking

KINDS = {
    "long": lambda rng: 2**53 + rng.randrange(6) if rng.random() < 0.5 else rng.randrange(-(2**62), 2**62),
    "decimal(38,6)": lambda rng: Decimal(10**30) + Decimal(rng.randrange(40)) / 10**6,
    "string": lambda rng: "same beginning " * 6 + str(rng.randrange(30)) if rng.random() < 0.5 else rng.choice(["", "é", "z", "Z"]) + str(rng.randrange(9)),
    "date": lambda rng: datetime.date(2020, 1, 1) + datetime.timedelta(rng.randrange(500)),
    "timestamp": lambda rng: datetime.datetime(2020, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(microseconds=rng.randrange(50)),
    "double": lambda rng: rng.choice([0.1, -5.0, 1e300, rng.random()]),
    "boolean": lambda rng: rng.random() < 0.4,
}


def keyed(kind, n=600, hot=0.0, nulls=0.1):
    rng = random.Random(kind)
    common = KINDS[kind](rng)
    return [(i, None if rng.random() < nulls else common if rng.random() < hot else KINDS[kind](rng), rng.randrange(100) if rng.random() < 0.8 else None) for i in range(n)]


def in_order(rows, descending, nulls_first):
    full = sorted((r for r in rows if r[1] is not None), key=lambda r: r[1] if not isinstance(r[1], str) else r[1].encode(), reverse=descending)
    empty = [r for r in rows if r[1] is None]
    return empty + full if nulls_first else full + empty


def expected(rows, descending, nulls_first):
    """{id: (rank, dense rank, running sum)}"""
    out, rank, dense, total, at, group = {}, 0, 0, None, 0, []
    ordered = in_order(rows, descending, nulls_first)
    while at < len(ordered):
        group = [r for r in ordered[at:] if r[1] == ordered[at][1]]
        rank, dense = at + 1, dense + 1
        for r in group:
            total = total if r[2] is None else (total or 0) + r[2]
        out.update({r[0]: (rank, dense, total) for r in group})
        at += len(group)
    return out


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("descending, nulls_first, hot", [(False, False, 0.0), (True, False, 0.7), (False, True, 0.7)])
def test_places_equal_sorted_rows(spark, kind, descending, nulls_first, hot):
    rows = keyed(kind, hot=hot)
    df = spark.createDataFrame(rows, f"id long, `the key` {kind}, v int").repartition(3)
    how = {"descending": descending, "nulls_first": nulls_first, "ranges": 12}
    df = df.cache()
    ranks = ranking.placed(df, "the key", "r", ties=True, **how).select("id", "r")
    dense = ranking.placed(df, "the key", "d", dense=True, **how).select("id", "d")
    sums = ranking.running_sum(df, "the key", "v", "s", **how).select("id", "s")
    got = {r["id"]: (r["r"], r["d"], r["s"]) for r in ranks.join(dense, "id").join(sums, "id").collect()}
    assert got == expected(rows, descending, nulls_first)
    numbers = {r["id"]: r["n"] for r in ranking.placed(df, "the key", "n", **how).collect()}
    assert sorted(numbers.values()) == list(range(1, len(rows) + 1))
    assert all(got[i][0] <= n < got[i][0] + Counter(x[0] for x in got.values())[got[i][0]] for i, n in numbers.items())
    df.unpersist()


def test_neighbours_beyond_doubles_have_their_own_rank(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,), (2**53 + 2,), (-(2**63),), (2**63 - 1,)], "x long")
    got = {r["x"]: r["p"] for r in ranking.placed(df, "x", "p", ties=True).collect()}
    assert got == {-(2**63): 1, 2**53: 2, 2**53 + 1: 3, 2**53 + 2: 4, 2**63 - 1: 5}


def test_a_value_in_most_rows_fills_no_task(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("x"), "id")
    cut = ranking.ranged(df, "x", False, False, True, 20)
    assert max(r["count"] for r in cut.groupBy("_span").count().collect()) < 450
    shared = ranking.placed(df, "x", "p", ties=True, ranges=20)
    assert {r["p"] for r in shared.filter("x = 7").collect()} == {2}


def test_empty_table_and_only_nulls(spark):
    assert ranking.placed(spark.createDataFrame([], "x string"), "x", "p").count() == 0
    rows = ranking.placed(spark.createDataFrame([(None,), (None,)], "x string"), "x", "p", ties=True).collect()
    assert [r["p"] for r in rows] == [1, 1]
