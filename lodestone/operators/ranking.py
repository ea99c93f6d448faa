"""Places and running sums over a whole table without putting it into one task.

Rows are cut into ranges of the order column, by its own type, so long whole numbers, decimals, texts and times keep their
order to the last digit. A range is worked out alone, and what the ranges before hold is added. A value that fills several
ranges has one of its own: where its rows share a place they are not sorted at all, else they are dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Ranges in which rows are placed.
RANGES = 256
#: Rows that cuts of a column without quantiles come from, and letters of a cut.
SAMPLE, CUT_LETTERS = 8192, 64


def cuts_of(df: DataFrame, column: str, n: int) -> tuple[list, list]:
    """(cuts, hot): values of the column, ascending, that cut df's rows into n ranges of about equal size; and those that
    fill more than one range. Any values do as cuts, they need not be exact quantiles."""
    kind = df.schema[column].dataType
    key = F.col(f"`{column}`")
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        got = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 1000).alias("s")).first()["s"] or []
    else:
        few = F.substring(key, 1, CUT_LETTERS) if isinstance(kind, T.StringType) else key
        rows = df.filter(key.isNotNull()).select(few.alias("k"), F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant"))]).alias("h"))
        some = sorted(r["k"] for r in rows.orderBy("h").limit(SAMPLE).collect())
        got = [some[len(some) * i // n] for i in range(1, n)] if some else []
    times: dict = {}
    for v in got:
        times[v] = times.get(v, 0) + 1
    return sorted(times), sorted(v for v, k in times.items() if k > 1)


def ranged(df: DataFrame, column: str, descending: bool, nulls_first: bool, spread: bool, ranges: int | None = None) -> DataFrame:
    """df with _span, the number of its row's range in the order of rows, and _hot, whether one value fills it. spread: the rows of
    such a value are dealt to more ranges, by all their columns."""
    n = ranges or RANGES
    cuts, hot = cuts_of(df, column, n)
    kind, key = df.schema[column].dataType, F.col(f"`{column}`")
    literal = lambda v: F.lit(v).cast(kind)
    if cuts:
        array = F.array(*[literal(v) for v in cuts])
        count = F.size(F.filter(array, (lambda s: s > key) if descending else (lambda s: s < key))).cast("long")
        at_hot = key.isin(*[literal(v) for v in hot]) if hot else F.lit(False)
        span = count * 2 + at_hot.cast("long")  # a hot value's range follows that of the values between the cut before and itself
    else:
        span, at_hot = F.lit(0).cast("long"), F.lit(False)
    at_hot = F.coalesce(at_hot, F.lit(False)) | key.isNull()
    span = F.when(key.isNull(), F.lit(-1 if nulls_first else 2 * n + 2).cast("long")).otherwise(span)
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant"))]), F.lit(n)) if spread else F.lit(0)
    return df.withColumns({"_span": span * F.lit(n) + F.when(at_hot, part).otherwise(F.lit(0)), "_hot": at_hot})


def _order(column: str, descending: bool, nulls_first: bool) -> Column:
    key = F.col(f"`{column}`")
    name = ("desc" if descending else "asc") + ("_nulls_first" if nulls_first else "_nulls_last")
    return getattr(key, name)()


def _with_before(df: DataFrame, totals: DataFrame, out: str) -> DataFrame:
    """df with out, the sum of _n over the ranges before its row's; totals (_span, _n) has a row for each range."""
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("_span").alias("_at"), before.alias(out))  # at most RANGES^2 rows: a span and a part
    return df.join(F.broadcast(totals), F.col("_span") == F.col("_at")).drop("_at")


def placed(df: DataFrame, column: str, out: str, descending: bool = False, ties: bool = False, dense: bool = False, nulls_first: bool = False, ranges: int | None = None) -> DataFrame:
    """df with out: each row's place from 1 in the order of a column. ties: equal values share a place, as rank() does; dense: and
    the next value has the next place, as dense_rank() does. Else rows of equal values follow each other in any order.

    df is read three times, so it must give the same rows each time.
    """
    shared = ties or dense
    df = ranged(df, column, descending, nulls_first, not shared, ranges)
    key = F.col(f"`{column}`")
    if dense:
        totals = df.select("_span", key.alias("_k")).distinct().groupBy("_span").agg(F.count(F.lit(1)).alias("_n"))
    else:
        totals = df.groupBy("_span").agg(F.count(F.lit(1)).alias("_n"))
    window = Window.partitionBy("_span").orderBy(_order(column, descending, nulls_first))
    if shared:
        place = F.dense_rank() if dense else F.rank()
        rows = df.filter(~F.col("_hot")).withColumn("_place", place.over(window)).unionByName(df.filter("_hot").withColumn("_place", F.lit(1)))
    else:
        rows = df.withColumn("_place", F.row_number().over(window))
    return _with_before(rows, totals, "_before").withColumn(out, (F.col("_place") + F.col("_before")).cast("long")).drop("_span", "_hot", "_before", "_place")


def running_sum(df: DataFrame, column: str, value: str, out: str, descending: bool = False, nulls_first: bool = False, ranges: int | None = None) -> DataFrame:
    """df with out: the sum of value over the rows up to each row's, in the order of a column; equal ones count together, as in
    sum() OVER (ORDER BY ..). Null values add nothing; where there is none but nulls so far, the sum is null."""
    df = ranged(df, column, descending, nulls_first, False, ranges)
    add = F.col(f"`{value}`")
    window = Window.partitionBy("_span").orderBy(_order(column, descending, nulls_first))  # with equal ones
    totals = df.groupBy("_span").agg(F.sum(add).alias("_n"), F.count(add).alias("_m"))
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.select(F.col("_span").alias("_at"), F.sum("_n").over(before).alias("_before"), F.col("_n").alias("_whole"))  # a row for each range
    rows = df.filter(~F.col("_hot")).withColumn("_own", F.sum(add).over(window))
    met = rows.join(F.broadcast(sums), F.col("_span") == F.col("_at"))
    hot = df.filter("_hot").join(F.broadcast(sums), F.col("_span") == F.col("_at")).withColumn("_own", F.col("_whole"))
    both = met.unionByName(hot)
    total = F.when(F.col("_own").isNull(), F.col("_before")).when(F.col("_before").isNull(), F.col("_own")).otherwise(F.col("_own") + F.col("_before"))
    return both.withColumn(out, total).drop("_span", "_hot", "_at", "_before", "_whole", "_own")
