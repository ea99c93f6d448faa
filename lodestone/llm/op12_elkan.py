"""Centroid clustering (Lloyd's rounds) with Elkan's bounds (2003), exact on vectors of whole numbers.

Each vector keeps its centroid, an upper bound of the distance to it and a lower bound of the distance to every centroid.
When centroids move, bounds change by at most as much. A distance is worked out only where neither the lower bound nor
half the distance between the two centroids shows that another centroid is strictly farther away, so ties are always
compared exactly. Distances are whole numbers; bounds are 32-bit floats, upper ones rounded up and lower ones down.

A round reads the vectors with their bounds, narrowly, and writes them with new ones to the shared folder; the sums of the
clusters are added up in each task first, so k rows for each dimension and task are shuffled, and k of them reach the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, read, remove, rewritten, worker_for
from .vectors import valid

CLUSTERS = 8
ROUNDS = 10
DIMS = 64
SCALE = 1024.0
SEED = 3
#: Components below this are squared and added up in 64-bit integers (64 of them, and more: see distances); others as Python's.
NARROW = 1 << 27
#: Vectors that are compared at a time.
TOGETHER = 4096


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to those of y (or to one)."""
    gap = x - y
    return (gap * gap).sum(axis=-1)


def number_kind(most: int, dims: int) -> type:
    """The kind of numbers in which squared distances of components up to `most` are exact."""
    return np.int64 if (2 * most) ** 2 * max(1, dims) < 1 << 62 else object


def root(squared: np.ndarray) -> np.ndarray:
    """Square roots of whole numbers, to 2^-51 of their value."""
    return np.sqrt(np.asarray(squared).astype(np.float64))


def up(x: np.ndarray) -> np.ndarray:
    """32-bit floats above x, further than the errors of a few operations on 64-bit floats."""
    return np.nextafter(np.asarray(x).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x).astype(np.float32), np.float32(-np.inf))


class Centroids:
    """Centroids of one round: their halved distances to each other, rounded down, and how far each has moved at most."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at, k = at, len(at)
        self.moved = up(root(distances(at, before))).astype(np.float64) if before is not None else np.zeros(k)
        self.half = np.stack([down(root(distances(at, c)) / 2).astype(np.float64) for c in at])
        np.fill_diagonal(self.half, np.inf)

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(own, upper, lower, distances worked out) of vectors x, from their centroids and bounds before the centroids moved."""
        own, upper = own.copy(), up(upper + self.moved[own])
        lower = np.maximum(down(lower - self.moved), np.float32(0))
        rivals = (upper[:, None] >= lower) & (upper[:, None] >= self.half[own])
        rivals[np.arange(len(own)), own] = False
        todo = np.flatnonzero(rivals.any(axis=1))
        best = distances(x[todo], self.at[own[todo]])
        upper[todo] = up(root(best))
        lower[todo, own[todo]] = np.maximum(down(root(best)), np.float32(0))
        worked = len(todo)
        for c in range(len(self.at)):
            mine, bound = own[todo], upper[todo]
            at = np.flatnonzero((mine != c) & (bound >= lower[todo, c]) & (bound >= self.half[mine, c]))
            if not len(at):
                continue
            worked += len(at)
            rows = todo[at]
            far = distances(x[rows], self.at[c])
            lower[rows, c] = np.maximum(down(root(far)), np.float32(0))
            nearer = ((far < best[at]) | ((far == best[at]) & (c < own[rows]))).astype(bool)
            at, rows = at[nearer], rows[nearer]
            best[at], own[rows], upper[rows] = far[nearer], c, up(root(far[nearer]))
        return own, upper, lower, worked


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A column of equally long lists of numbers as rows."""
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False)
    if kind is object:
        values = np.array(flat.to_pylist(), object)
    return values.astype(kind).reshape(len(column), -1)


def parts(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, TOGETHER):
        yield batch.slice(at, TOGETHER)


def assigned(state: DataFrame, now: Centroids, kind: type, last: bool) -> DataFrame:
    """The next state (vec_id, vec, cluster, upper, lower); at last vec_id, cluster and the squared distance."""
    k = len(now.at)

    def run(batches):
        worker_for("op12")
        for batch in batches:
            for part in parts(batch):
                x, own = matrix(part["vec"], kind), part["cluster"].to_numpy()
                own, upper, lower, _ = now.assign(x, own, part["upper"].to_numpy(), matrix(part["lower"], np.float32))
                cluster = pa.array(own.astype(np.int32))
                if last:
                    far = [int(d) for d in distances(x, now.at[own])]
                    if far and max(far) >= 1 << 63:
                        raise OverflowError("a squared distance does not fit into 64 bits")
                    yield pa.RecordBatch.from_arrays([part["vec_id"], cluster, pa.array(far, pa.int64())], names=["vec_id", "cluster", "distance"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * k), pa.array(lower.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([part["vec_id"], part["vec"], cluster, pa.array(upper), lists], names=["vec_id", "vec", "cluster", "upper", "lower"])

    return state.mapInArrow(run, "vec_id long, cluster int, distance long" if last else "vec_id long, vec array<long>, cluster int, upper float, lower array<float>")


def means(state: DataFrame, before: np.ndarray, kind: type) -> np.ndarray:
    """The componentwise floor of each cluster's mean; an empty one stays where it was."""
    k, dims = before.shape

    def add(batches):
        worker_for("op12")
        total, n = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for batch in batches:
            for part in parts(batch):
                x, own = matrix(part["vec"], kind), part["cluster"].to_numpy()
                for c in np.unique(own).tolist():  # TOGETHER components at a time do not leave 64 bits where kind is int64
                    total[c] += x[own == c].sum(axis=0)
                n += np.bincount(own, minlength=k)
        for c in np.flatnonzero(n).tolist():
            rows = [pa.array([c] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array(list(map(int, total[c])), pa.decimal128(38, 0)), pa.array([n[c]] * dims, pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, names=["cluster", "dim", "total", "n"])

    sums = state.select("vec", "cluster").mapInArrow(add, "cluster int, dim int, total decimal(38,0), n long")
    out = before.copy()
    for r in sums.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():  # k rows for each dimension
        out[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return out


def elkan(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) for each row of vectors (vec_id, vec: array<long>), the centroids).

    Vectors have one length and no nulls. The first centroids are the vectors whose vec_id, after the seed and a colon, has the
    least SHA-256 (a null vec_id counts as empty; rows that share one are ordered by their components); there are fewer
    if there are fewer rows. Each of the rounds assigns every vector to the nearest centroid, ties to the smaller number, and
    moves each centroid to the floor of its vectors' mean; then vectors are assigned once more. Rounds end early only when
    no centroid has moved, as all that follow would be the same. A squared distance beyond 64 bits is an error.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vec").cast("array<long>").alias("vec"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = [r["vec"] for r in vectors.orderBy(digest, "vec_id", "vec").limit(clusters).collect()]
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, 0), np.int64)
    k, dims = len(first), len(first[0])
    start = [F.lit(0).alias("cluster"), F.lit(float("inf")).cast("float").alias("upper"), F.array_repeat(F.lit(0.0).cast("float"), k).alias("lower")]
    state = rewritten(vectors.select("*", *start), "op12")
    ends = state.agg(F.max(F.array_max("vec")).alias("a"), F.min(F.array_min("vec")).alias("b")).first()
    kind = number_kind(max(abs(ends["a"]), abs(ends["b"])) if dims else 0, dims)
    now = Centroids(np.array(first, object).reshape(k, dims).astype(kind))
    for _ in range(rounds):
        before, state = state, rewritten(assigned(state, now, kind, False), "op12")
        remove(spark, before)
        at = means(state, now.at, kind)
        settled = bool((at == now.at).all())
        now = Centroids(at, now.at)
        if settled:
            break
    found = cut(assigned(state, now, kind, True))
    remove(spark, state)
    return found, now.at


def whole_numbers(embeddings: DataFrame, dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    """(vec_id, vec) of the rows of embeddings that have exactly dims components, none null or non-finite, as floor(scale * x).
    A product beyond 64 bits is an error."""
    rows = embeddings.filter((F.size("embedding") == dims) & valid(F.col("embedding")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long")).alias("vec"))


def op12_elkan_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kept row of embeddings: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. Rows that share a vec_id
    are clustered one by one; a null vec_id is kept."""
    found, at = elkan(whole_numbers(read(spark, sf_dir, "embeddings")))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one for each centroid
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in at]
    facts = spark.createDataFrame([(c, s, sum(sums.values()), digests[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), vec_id, e) - 1 AS c, e FROM v QUALIFY c < 8)",
    ]
    for r in range(ROUNDS + 1):
        near = f"SELECT uid, vec_id, v.e, c, list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c{r}.e) + list_inner_product(c{r}.e, c{r}.e) AS d FROM v CROSS JOIN c{r}"
        steps.append(f"a{r} AS MATERIALIZED (SELECT * FROM ({near}) QUALIFY row_number() OVER (PARTITION BY uid ORDER BY d, c) = 1)")
        if r < ROUNDS:
            mean = f"SELECT c, list(m ORDER BY i) AS e FROM (SELECT c, i, floor(sum(x) / count(*)) AS m FROM (SELECT c, unnest(e) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i) GROUP BY c"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.e, c{r}.e) AS e FROM c{r} LEFT JOIN ({mean}) m USING (c))")
    last = f"""SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(k.e, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} k USING (c)"""
    return "WITH " + ",\n".join(steps) + "\n" + last


#: DuckDB SQL for op12_elkan_bounds: every distance of every round.
ORACLE = _oracle()
