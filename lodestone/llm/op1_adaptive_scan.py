"""Approximate nearest neighbours by an adaptive dimension scan (ADSampling, Gao and Long, 2023; PDX, 2025).

Vectors are scaled to length 1 and dealt into lists around centroids; a query probes the lists of its nearest
centroids. Vectors and queries are rotated at random, and a list is scanned in column blocks: after each block of
dimensions, a hypothesis test on the partial distance abandons the candidates that are too far to be among the k
nearest. Survivors are scored in full, in double precision, on the original vectors.

Centroids and the number of probes are fitted on a bounded sample of TRAINING vectors; every row is indexed. The
number of probes is the least that finds PROBE_RECALL of the sample's own neighbours. The sample also gives each query
a bound on its k-th distance to start from.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, read, worker_for
from .vectors import best_rows, classes_of, lengths, ranked_results, stacked, valid

K = 5
QUERY_EVERY = 50
#: Vectors, those with the least hashes, that centroids and probes are fitted on, and queries among them.
TRAINING, TRAINING_QUERIES = 16_384, 512
LEAST_LISTS, MOST_LISTS = 4, 1024
PROBE_RECALL = 0.98
#: Rows in a unit of lists, and queries that meet one at a time on average; a unit's rows are copied only where more do.
UNIT, CHUNK = 8192, 8192
#: Dimensions in a column block; the test's confidence (in the published notation, epsilon 0).
STEP, EPSILON = 16, 2.1
#: Share of live candidates below which distances go on pair by pair.
SPARSE = 0.25
#: Sample neighbours beyond the k + 1 that a query's first bound leaves room for, should a test abandon a true one.
SPARE = 4


def unit_length(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(dims: int, seed: int = 1) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def cluster(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centroids of unit vectors by k-means, from an even choice of rows."""
    centroids = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centroids.T, axis=1)
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.diff(own[order], prepend=-1))
        sums = np.add.reduceat(x[order], first)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids[own[order][first]] = np.where(length > 0, sums / np.maximum(length, 1e-300), centroids[own[order][first]])
    return centroids


class Index:
    """Centroids, number of probes and sample."""

    def __init__(self, sample: np.ndarray, n_rows: int, k: int):
        x = unit_length(sample)
        lists = int(2 ** round(np.log2(max(1, n_rows) ** 0.5)))
        lists = max(1, min(max(LEAST_LISTS, min(MOST_LISTS, lists)), len(x)))
        self.sample, self.k = x.astype(np.float32), k
        self.centroids = cluster(x, lists)
        own = np.argmax(x @ self.centroids.T, axis=1)
        self.own = own
        some = x[:: max(1, len(x) // TRAINING_QUERIES)]
        near = np.argsort(-(some @ x.T), axis=1)[:, 1 : k + 1]  # the first is the query itself
        order = np.argsort(-(some @ self.centroids.T), axis=1)
        place = np.argsort(order, axis=1)
        needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
        self.probes = int(needed[int(PROBE_RECALL * (len(needed) - 1))]) + 1 if len(needed) else lists

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return np.argmax(unit_length(x) @ self.centroids.T, axis=1)

    def probed(self, x: np.ndarray) -> np.ndarray:
        """For each query, whether it probes each list."""
        near = unit_length(x) @ self.centroids.T
        out = np.zeros(near.shape, bool)
        np.put_along_axis(out, np.argpartition(-near, self.probes - 1, axis=1)[:, : self.probes], True, axis=1)
        return out

    def bounds(self, x: np.ndarray, probed: np.ndarray) -> np.ndarray:
        """For each query a squared distance that k + SPARE rows at least of the lists it probes do not exceed (infinite, if the
        sample has too few there)."""
        out = np.full(len(x), np.inf)
        nth = self.k + SPARE
        for at in range(0, len(x), 256):
            part = unit_length(x[at : at + 256]).astype(np.float32) @ self.sample.T
            part = np.where(probed[at : at + 256][:, self.own], part, -2.0)
            if part.shape[1] >= nth:
                top = np.partition(part, part.shape[1] - nth, axis=1)[:, -nth].astype(np.float64)
                out[at : at + 256] = np.where(top > -2, np.maximum(0.0, 2 - 2 * top) + 1e-5, np.inf)
        return out


def scan(rows: np.ndarray, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) numbers of the pairs that no test has abandoned; rows and queries are rotated unit vectors, bound is
    each query's squared distance to beat. Column block by column block over all queries of a list."""
    dims = rows.shape[1]
    part = np.zeros((len(queries), len(rows)))
    at, live = 0, None
    while at < dims:
        end = min(dims, at + STEP)
        a, b = queries[:, at:end], rows[:, at:end]
        if live is None:
            part += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
        else:
            q, r = live
            part += ((a[q] - b[r]) ** 2).sum(axis=1)
        at = end
        factor = 1.0 if at == dims else at / dims * (1 + EPSILON / at**0.5) ** 2
        if live is None:
            on = part <= bound[:, None] * factor
            if at == dims or on.mean() < SPARSE:
                live = np.nonzero(on)
                part = part[on]
        else:
            on = part <= bound[live[0]] * factor
            live, part = (live[0][on], live[1][on]), part[on]
    return live


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision; vectors near the ends of the range are scaled first."""
    big = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) > 1e140
    small = min(np.abs(a).max(axis=1).min(initial=1), np.abs(b).max(axis=1).min(initial=1)) < 1e-140
    if big or small:
        a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def search_unit(ids: np.ndarray, rows: np.ndarray, own: np.ndarray, queries: np.ndarray, probed: list[np.ndarray], bound: np.ndarray, k: int):
    """For each query (scores, ids) of the k best rows met in the lists it probes."""
    turn = rotation(rows.shape[1])
    turned, asked = unit_length(rows) @ turn, unit_length(queries) @ turn
    bound = bound.copy()
    best = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)
    by_list: dict[int, list[int]] = {}
    for i, lists in enumerate(probed):
        for x in lists:
            by_list.setdefault(int(x), []).append(i)
    for x in np.unique(own):
        if int(x) not in by_list:
            continue
        here, who = np.flatnonzero(own == x), np.array(by_list[int(x)])
        for at in range(0, len(who), 512):
            some = who[at : at + 512]
            q, r = scan(turned[here], asked[some], bound[some])
            if not len(q):
                continue
            q, r = some[q], here[r]
            score = cosine(queries[q], rows[r])
            order = np.argsort(q, kind="stable")
            q, r, score = q[order], r[order], score[order]
            first = np.flatnonzero(np.diff(q, prepend=-1))
            for a, b in zip(first, np.append(first[1:], len(q))):
                i = q[a]
                s, y = np.concatenate([best[i][0], score[a:b]]), np.concatenate([best[i][1], ids[r[a:b]]])
                top = best_rows(s, y, k)
                best[i] = s[top], y[top]
                if len(top) == k:
                    bound[i] = min(bound[i], max(0.0, 2 - 2 * s[top[-1]]) + 1e-9)
    return best


def units_of(sizes: dict[int, int], rows: int = UNIT) -> dict[int, tuple[int, int]]:
    """For each list its first unit and its number of units: large lists get several of their own, small ones share."""
    out, unit, room = {}, -1, 0
    for x, n in sorted(sizes.items()):
        parts = -(-n // rows)
        if parts > 1:
            out[x] = (unit + 1, parts)
            unit, room = unit + parts, 0
        else:
            if n > room:
                unit, room = unit + 1, rows
            out[x] = (unit, 1)
            room -= n
    return out


def chunks_of(asking: dict[int, int], units: dict[int, tuple[int, int]], queries: int = CHUNK) -> dict[int, int]:
    """For each list that queries probe (asking: how many) into how many chunks of queries those of its unit are cut."""
    together: dict[int, int] = {}
    for x, n in asking.items():
        together[units[x][0]] = together.get(units[x][0], 0) + n
    return {x: -(-together[units[x][0]] // queries) for x in units if units[x][0] in together}


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for queries (query_id, vec) the k nearest found among vectors (vec_id, vec), by
    largest cosine; ties to the smaller vec_id. A row is no candidate of a query with its own id. Equal vectors are
    searched once. All vectors are of one length."""
    import pyarrow as pa

    spark = vectors.sparkSession
    classes = cut(classes_of(vectors, k + 1))
    n_rows = classes.count()
    asked = cut(queries.join(classes.select("class_id", "vec"), "vec").select("query_id", F.col("class_id").alias("query_class")))
    first = classes.orderBy(F.xxhash64("class_id"), "class_id").limit(TRAINING).select("vec").collect()  # at most TRAINING rows
    if not first:
        return ranked_results(spark.createDataFrame([], "query_class long, class_id long, score double"), classes, asked, k)
    fitted = spark.sparkContext.broadcast(Index(np.array([r["vec"] for r in first], np.float64), n_rows, k))

    def assign(batches):
        worker_for("op1")
        for batch in batches:
            if batch.num_rows:
                lists = fitted.value.lists_of(stacked(batch.column("vec")))
                yield pa.RecordBatch.from_arrays([batch.column("class_id"), batch.column("vec"), pa.array(lists.astype(np.int32))], names=["class_id", "vec", "list"])

    vec_type = classes.schema["vec"].dataType.simpleString()
    indexed = cut(classes.select("class_id", "vec").mapInArrow(assign, f"class_id long, vec {vec_type}, list int"))
    sizes = {r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}  # at most MOST_LISTS rows
    units = units_of(sizes)

    def probe(batches):
        worker_for("op1")
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = stacked(part.column("vec"))
                probed = fitted.value.probed(x)
                bounds = fitted.value.bounds(x, probed)
                place, unit, lists = [], [], []
                for i in range(len(x)):
                    meets: dict[int, list[int]] = {}
                    for own in np.flatnonzero(probed[i]).tolist():
                        start, n = units.get(own, (0, 0))
                        for u in range(start, start + n):
                            meets.setdefault(u, []).append(own)
                    for u, own in meets.items():
                        place.append(i)
                        unit.append(u)
                        lists.append(own)
                if place:
                    t = pa.array(place)
                    yield pa.RecordBatch.from_arrays([part.column("class_id").take(t), part.column("vec").take(t), pa.array(lists, pa.list_(pa.int32())), pa.array(bounds[place]), pa.array(unit, pa.int32())], names=["query_class", "query", "lists", "bound", "unit_met"])

    wanted = classes.join(asked.select(F.col("query_class").alias("class_id")).distinct(), "class_id", "left_semi").select("class_id", "vec")
    right = cut(wanted.mapInArrow(probe, f"query_class long, query {vec_type}, lists array<int>, bound double, unit_met int"))
    asking = right.select("unit_met", F.explode("lists").alias("list")).groupBy("unit_met", "list").count().groupBy("list").agg(F.max("count").alias("n")).collect()  # at most MOST_LISTS rows
    chunks = chunks_of({r["list"]: r["n"] for r in asking}, units)
    if not chunks:
        return ranked_results(spark.createDataFrame([], "query_class long, class_id long, score double"), classes, asked, k)
    table = lambda values: F.create_map(*[F.lit(v) for pair in values.items() for v in pair])
    starts, parts = (table({x: u[i] for x, u in units.items()}) for i in (0, 1))
    unit = starts[F.col("list")] + F.pmod(F.xxhash64("class_id"), parts[F.col("list")].cast("long")).cast("int")
    met = indexed.filter(F.col("list").isin(list(chunks)))  # rows of lists that no query probes go nowhere
    left = met.select("class_id", "vec", "list", unit.alias("unit"), F.explode(F.sequence(F.lit(0), table(chunks)[F.col("list")] - 1)).alias("chunk"))
    right = right.withColumn("own_chunk", F.pmod(F.xxhash64("query_class"), table(chunks)[F.col("lists")[0]].cast("long")).cast("int"))

    def search(rows, asked):
        worker_for("op1")
        out: list[list] = [[], [], []]
        if rows.num_rows and asked.num_rows:
            of = asked["query_class"].to_pylist()
            probed = [np.array(x) for x in asked["lists"].to_pylist()]
            found = search_unit(rows["class_id"].to_numpy(), stacked(rows["vec"]), rows["list"].to_numpy(), stacked(asked["query"]), probed, asked["bound"].to_numpy(), k + 1)
            for i, (score, x) in zip(of, found):
                out[0] += [i] * len(x)
                out[1] += x.tolist()
                out[2] += score.tolist()
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))], names=["query_class", "class_id", "score"])

    found = left.groupBy("unit", "chunk").cogroup(right.groupBy("unit_met", "own_chunk")).applyInArrow(search, "query_class long, class_id long, score double")
    return ranked_results(found, classes, asked, k)


def op1_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest found of every embedding whose vec_id is divisible by 50.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without vec_id.
    Vectors of several lengths are compared within each length, by an index of its own.
    """
    rows = read(spark, sf_dir, "embeddings").filter("vec_id IS NOT NULL").filter(valid(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    found = []
    for d in lengths(rows, "vec") or [0]:
        own = rows.filter(F.size("vec") == d)
        found.append(nearest(own, own.filter(F.col("vec_id") % QUERY_EVERY == 0).withColumnRenamed("vec_id", "query_id")))
    return reduce(DataFrame.union, found)
