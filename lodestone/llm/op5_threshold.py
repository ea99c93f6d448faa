"""Exact top-k inner products by the threshold algorithm (Fagin, Lotem and Naor, 2001).

Distinct vectors are dealt into blocks, distinct queries into chunks, and each block meets each chunk in one task. A
block has one sorted list of its rows for each dimension. A query walks all lists from the end that its sign favours,
scores every row that it meets in full, and stops when the sum of the values at the lists' fronts cannot reach its
k-th result. Its k-th result among SAMPLE rows is a bound to start from in every block.

How early the stop comes depends on the data: with few dimensions, or few that matter to a query, most rows are never
scored; in many dimensions of equal weight the fronts stay above every real row, and the walk ends with the lists.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, read, worker_for
from .vectors import best_rows, classes_of, ranked_results, stacked, valid

K = 5
QUERY_EVERY = 50
#: Rows in a block, queries in a chunk on average, and queries that walk the lists at a time.
BLOCK, CHUNK, TOGETHER = 16_384, 16_384, 256
#: Rows of each list in the first round; doubled each round.
FIRST_STEP = 16
#: Rows, those with the least hashes, that give each query a bound to start from.
SAMPLE = 2048
#: Sums of products up to these are exact in double precision and in 64 bits.
EXACT, WIDE = 2.0**53, 2.0**62


def kind_for(rows: np.ndarray, queries: np.ndarray):
    """The narrowest kind of number in which all sums of products are exact: double, 64-bit integer, or integers of any length."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    return np.float64 if most < EXACT else np.int64 if most < WIDE else object


def converted(x: np.ndarray, kind) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape) if kind is object else x.astype(kind)


def _float(score) -> float:
    try:
        return float(score)
    except OverflowError:
        return np.inf if score > 0 else -np.inf


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray | list[int]:
    if scores.dtype != object:
        return best_rows(scores, ids, k)
    return sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k]


def threshold_search(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each query (whole numbers) the scores and ids of the k best rows, ties to the smaller id, best first; and the number of
    rows scored. floors: for each query a score below which no row is wanted."""
    kind = kind_for(rows, queries)
    exact = kind is np.float64
    r, q = converted(rows, kind), converted(queries, kind)
    n = len(r)
    order = np.argsort(rows, axis=0, kind="stable").astype(np.int32)
    lists = np.take_along_axis(rows, order, axis=0).astype(float)
    out, scored = [], 0
    for at in range(0, len(q), TOGETHER):
        part = q[at : at + TOGETHER]
        high, low = (f(queries[at : at + TOGETHER], 0).astype(float) for f in (np.maximum, np.minimum))
        met = np.zeros((len(part), n), bool)
        best = [(np.zeros(0, kind), np.zeros(0, np.int64))] * len(part)
        kth = np.full(len(part), -np.inf) if floors is None else floors[at : at + TOGETHER].astype(float)
        depth, step = 0, FIRST_STEP
        active = np.arange(len(part))
        while depth < n and len(active):
            with np.errstate(over="ignore", invalid="ignore"):
                bound = np.nan_to_num(high[active] @ lists[n - 1 - depth] + low[active] @ lists[depth], nan=np.inf, posinf=np.inf, neginf=-np.inf)
                room = 0 if exact else np.abs(bound) * 1e-9 + (np.abs(high[active]) @ np.abs(lists[n - 1 - depth]) + np.abs(low[active]) @ np.abs(lists[depth])) * 1e-9
                active = active[~(bound + room < kth[active])]  # an unmet row may tie
            end = min(n, depth + step)
            for i in active:
                new = np.zeros(n, bool)
                new[order[n - end : n - depth, high[i] > 0].ravel()] = True
                new[order[depth:end, low[i] < 0].ravel()] = True
                if end == n:
                    new[:] = True  # dimensions in which the query is 0 have no list to walk
                new &= ~met[i]
                met[i] |= new
                rows_met = np.flatnonzero(new)
                if not len(rows_met):
                    continue
                scored += len(rows_met)
                score = r[rows_met] @ part[i]
                if exact and kth[i] > -np.inf:
                    rows_met, score = rows_met[score >= kth[i]], score[score >= kth[i]]
                s, x = np.concatenate([best[i][0], score]), np.concatenate([best[i][1], ids[rows_met]])
                top = _best(s, x, k)
                best[i] = s[top], x[top]
                if len(top) == k:
                    kth[i] = max(kth[i], _float(s[top[-1]]) if exact else np.nextafter(_float(s[top[-1]]), -np.inf))
            depth, step = end, step * 2
        out += best
    return out, scored


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors of whole numbers (vec_id, vec: array<double>) for queries (query_id, vec).

    A row is no candidate of a query with its own id, nor one of another length. Fewer candidates than k: all of them.
    Equal vectors are searched once. Scores are exact; a score among the results that does not fit into 64 bits is an
    error, as is one of more than 38 digits among those of a block.
    """
    classes = cut(classes_of(vectors, k + 1).withColumn("dims", F.size("vec")))
    asked = cut(queries.join(classes.select("class_id", "vec"), "vec").select("query_id", F.col("class_id").alias("query_class")))
    most = F.max(F.array_max(F.transform("vec", lambda x: F.abs(x)))).alias("most")
    facts = classes.agg(F.count(F.lit(1)).alias("n"), most, F.max("dims").alias("dims")).first()
    wide = (facts["most"] or 0.0) ** 2 * (facts["dims"] or 1) >= WIDE if (facts["most"] or 0.0) < 1e150 else True
    n_rows, n_queries = facts["n"], asked.select("query_class").distinct().count()
    blocks, chunks = max(1, -(-n_rows // BLOCK)), max(1, -(-n_queries // CHUNK))
    sample: dict[int, list] = {}
    for r in classes.orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE).select("dims", "vec").collect():  # at most SAMPLE rows
        sample.setdefault(r["dims"], []).append(r["vec"])
    known = classes.sparkSession.sparkContext.broadcast({d: np.array(x, np.float64) for d, x in sample.items() if len(x) > k and not wide})
    block, chunk = F.pmod(F.xxhash64("class_id"), F.lit(blocks)), F.pmod(F.xxhash64(F.col("class_id"), F.lit(1)), F.lit(chunks))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = classes.select("class_id", "vec", "dims", block.alias("block"), numbers(chunks).alias("chunk"))
    right = classes.join(asked.select(F.col("query_class").alias("class_id")).distinct(), "class_id", "left_semi")
    right = right.select(F.col("class_id").alias("query_class"), F.col("vec").alias("query"), F.col("dims").alias("dims_met"), numbers(blocks).alias("block_met"), chunk.alias("own_chunk"))

    def search(rows, asked):
        import pyarrow as pa

        worker_for("op5")
        out: list[list] = [[], [], []]
        if rows.num_rows and asked.num_rows:
            of, q = asked["query_class"].to_numpy(), stacked(asked["query"])
            some, floors = known.value.get(q.shape[1]), None
            if some is not None and kind_for(some, q) is np.float64:
                floors = np.concatenate([np.partition(q[at : at + TOGETHER] @ some.T, len(some) - k - 1, axis=1)[:, len(some) - k - 1] for at in range(0, len(q), TOGETHER)])
            found, _ = threshold_search(stacked(rows["vec"]), rows["class_id"].to_numpy(), q, k + 1, floors)
            for i, (score, x) in zip(of.tolist(), found):
                out[0] += [i] * len(x)
                out[1] += x.tolist()
                out[2] += map(int, score.tolist())
        if wide:
            if any(abs(s) >= 10**38 for s in out[2]):
                raise OverflowError("an inner product has more than 38 digits")
            out[2] = list(map(Decimal, out[2]))
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.decimal128(38, 0) if wide else pa.int64()))], names=["query_class", "class_id", "score"])

    met = left.groupBy("dims", "block", "chunk").cogroup(right.groupBy("dims_met", "block_met", "own_chunk"))
    found = met.applyInArrow(search, f"query_class long, class_id long, score {'decimal(38,0)' if wide else 'long'}")
    return ranked_results(found, classes, asked, k).withColumn("score", F.col("score").cast("long"))  # ANSI mode: an error if it does not fit


def op5_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's 5 highest integer inner products over all embeddings, components as floor(256 x).

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without vec_id. Vectors
    of several lengths are compared within each length. Scores beyond 64 bits, and components whose 256-fold is not
    finite, are errors.
    """
    rows = read(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL").filter(valid(F.col("embedding")))

    def whole(x):
        y = x.cast("double") * F.lit(256.0)
        too_large = F.raise_error(F.lit("a component times 256 is not finite")).cast("double")
        return F.when(F.abs(y) == float("inf"), too_large).when(F.abs(y) >= EXACT, y).otherwise(F.floor(y).cast("double"))

    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("vec"))
    return top_inner_products(rows, rows.filter(F.col("vec_id") % QUERY_EVERY == 0).withColumnRenamed("vec_id", "query_id"))


#: DuckDB SQL for op5_threshold_topk: every query against every row.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
