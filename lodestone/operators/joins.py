"""Joins that Spark would plan as a broadcast of any size or as a nested loop: NOT IN, and conditions joined by OR; and counts of
partners where the pairs themselves would be far more than the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import ranking


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """The rows of left whose column is NOT IN the values of right's column, by SQL's rules: none if a value is null; all if there is
    no value; else those that are neither null nor among them.

    Two numbers of the right side are broadcast, the rest is an anti join on the key, so neither side need fit anywhere.
    """
    values = right.select(F.col(other).alias("_value"))
    facts = values.agg(F.count(F.lit(1)).alias("_all"), F.count_if(F.col("_value").isNull()).alias("_null"))  # one row
    rows = left.join(values.filter("_value IS NOT NULL"), left[column] == F.col("_value"), "left_anti")
    open_ = (F.col("_null") == 0) & ((F.col("_all") == 0) | rows[column].isNotNull())
    return rows.crossJoin(F.broadcast(facts)).filter(open_).drop("_all", "_null")


def join_any(left: DataFrame, right: DataFrame, branches: list[Column], how: str = "inner") -> DataFrame:
    """left joined with right where any of the branches holds; how: inner, left or semi or anti (left_semi, left_anti).

    Each branch should hold an equality between both sides, which its hash join uses. A pair of rows comes from the first branch
    that holds, so it comes once; rows that are repeated stay repeated. A row without a partner has none in any branch.
    """
    if not branches:
        raise ValueError("a join needs a condition")
    if how in ("semi", "left_semi"):
        # a row for which an earlier branch holds is not asked again
        parts, rest = [], left
        for b in branches:
            parts.append(rest.join(right, b, "left_semi"))
            rest = rest.join(right, b, "left_anti")
        return reduce(DataFrame.unionAll, parts)
    alone = reduce(lambda rows, b: rows.join(right, b, "left_anti"), branches, left)
    if how in ("anti", "left_anti"):
        return alone
    held = [F.coalesce(b, F.lit(False)) for b in branches]
    pairs = reduce(DataFrame.unionAll, [left.join(right, reduce(lambda c, before: c & ~before, held[:i], b)) for i, b in enumerate(branches)])
    if how == "inner":
        return pairs
    if how == "left":
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields]
        return pairs.unionAll(alone.select(*[alone[c] for c in left.columns], *empty))
    raise ValueError(f"no such join: {how}")


def ordered(kind: T.DataType) -> bool:
    """Whether partner_counts() takes columns of a type for its order."""
    return isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)) or kind == T.StringType()


def partner_counts(left: DataFrame, right: DataFrame, equal: list[tuple[str, str]], order: tuple[str, str, str] | None, out: str, ranges: int | None = None) -> DataFrame:
    """The rows of left that have partners in right, with their number: rows of right that agree in all pairs of columns of equal and,
    if order is (x, sign, y), where left's x and right's y stand in that order. Columns that are compared have the same type.

    No pair is made. Both sides' values are grouped; with an order, the rows of right up to each value are summed by ranges of the
    values, so equal keys of any number share the work of several tasks.
    """
    keys = [f"_k{i}" for i in range(len(equal))]
    full = lambda df, names: df.filter(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]))
    of = lambda df, side: [F.col(f"`{pair[side]}`").alias(k) for pair, k in zip(equal, keys)]
    if order is None:
        found = full(right.select(*of(right, 1)), keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
        met = [F.col(f"`{x}`") == F.col(k) for (x, _), k in zip(equal, keys)]
        return left.join(found, met).select(*[left[f"`{c}`"] for c in left.columns], out)
    x, sign, y = order
    asked = left.select(*of(left, 0), F.col(f"`{x}`").alias("_v"), F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_asked"))
    there = right.select(*of(right, 1), F.col(f"`{y}`").alias("_v"), F.lit(1).cast("long").alias("_n"), F.lit(False).alias("_asked"))
    values = full(asked.unionAll(there), [*keys, "_v"]).groupBy(*keys, "_v").agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked"))
    spans = ranking.ranged(values, "_v", False, False, False, ranges)
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_span").orderBy("_v"))
    one = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_m").over(one.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = spans.groupBy(*keys, "_span").agg(F.sum("_n").alias("_m")).select(*keys, "_span", before.alias("_before"), F.sum("_m").over(one).alias("_all"))  # at most two rows a range for each key
    rows = spans.withColumn("_upto", upto).filter("_asked").join(totals, [*keys, "_span"])
    reached = F.col("_upto") + F.col("_before")
    n = {"<": F.col("_all") - reached, "<=": F.col("_all") - reached + F.col("_n"), ">": reached - F.col("_n"), ">=": reached}[sign]
    found = rows.select(*keys, "_v", n.alias(out)).filter(F.col(out) > 0)
    met = [F.col(f"`{c}`") == F.col(k) for (c, _), k in zip(equal, keys)] + [F.col(f"`{x}`") == F.col("_v")]
    return left.join(found, met).select(*[left[f"`{c}`"] for c in left.columns], out)
