"""What vector operators share: valid vectors, classes of equal ones, and the way from found classes to ranked rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Lengths of vectors that one table may mix.
MOST_LENGTHS = 64


def valid(vector: Column) -> Column:
    """Whether an array is there, not empty, and has neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def lengths(df: DataFrame, vector: str) -> list[int]:
    """The lengths of df's vectors; only vectors of one length are compared. More than MOST_LENGTHS are an error: such a table
    does not hold the vectors of a few models."""
    found = sorted(r["d"] for r in df.select(F.size(vector).alias("d")).distinct().limit(MOST_LENGTHS + 1).collect())
    if len(found) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    return found


def classes_of(df: DataFrame, most: int) -> DataFrame:
    """(class_id, vec, ids) for each distinct vector of df (vec_id, vec): its least vec_id, and its `most` least ids, ascending."""
    first = Window.partitionBy("vec").orderBy("vec_id")
    few = df.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= most)  # cut down before the shuffle as well
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("class_id"), "vec", "ids")


def stacked(column, kind=np.float64) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, best first."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= kth)
        return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
    return np.lexsort((ids, -scores))[:k]


def ranked_results(found: DataFrame, classes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows other than itself, ties to the smaller vec_id.

    found: (query_class, class_id, score), which holds the k + 1 best classes of each query class at least, of which
    the k + 1 best rows are members. queries: (query_id, query_class). No step gathers more than (k + 1)^2 rows of a
    query class, however many queries share one vector.
    """
    best = Window.partitionBy("query_class").orderBy(F.desc("score"), "class_id")
    top = found.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1).drop("_n")
    rows = top.join(classes.select("class_id", "ids"), "class_id").select("query_class", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query_class").orderBy(F.desc("score"), "vec_id")
    rows = rows.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k + 1)
    lists = rows.groupBy("query_class").agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), "vec_id", "score"))).alias("found"))
    own = queries.join(lists, "query_class").select("query_id", F.slice(F.filter("found", lambda r: r["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    out = own.select("query_id", F.posexplode("found").alias("at", "r"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("r")["vec_id"].alias("vec_id"), F.col("r")["score"].alias("score"))
