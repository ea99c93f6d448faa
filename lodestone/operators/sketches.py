"""Column profiles that grow with the data: one row of mergeable sketches for each file and column, merged when they are asked for.

A profile of new files reads only these. Counts, sums, least and greatest values merge exactly; distinct counts come from
HyperLogLog sketches (standard error 1.04 / sqrt(2^LOG_BUCKETS), 1.6 %), quantiles from KLL sketches (rank error about 1.33 % with
KLL_K), the sums of squares that the deviation needs as doubles. Values that are heavy are found with counters that merge.
"""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.canonical import canonical
from .profile import Profiled, _columns, numeric_looking, ticked

LOG_BUCKETS, KLL_K = 12, 200
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (LOG_BUCKETS / 2), 0.0133
QUANTILES = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Counters of heavy_hitters() in a task.
COUNTERS = 4096
#: Candidates whose exact counts are asked for by a broadcast list.
MOST_CANDIDATES = 100_000

STATE = "table_name string, file string, modified timestamp, column_name string, ordinal int, row_count long, set_count long, empty_count long, whitespace_count long, filled_count long, numeric_looking_count long, min_value double, max_value double, sum_value double, square_sum double, distinct_sketch binary, quantile_sketch binary"


def file_sketches(df: DataFrame, table: str, types: dict[str, str] | None = None) -> DataFrame:
    """A row of STATE for each file and column of df, which must read files: one pass, one grouping by file that is combined within
    the tasks. Arrays, maps, structs and binary columns are left out."""
    columns = _columns(df, types)
    if not columns:
        return df.sparkSession.createDataFrame([], STATE)
    sums = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        x, kind = ticked(c.name), df.schema[c.name].dataType
        hashed = x if isinstance(kind, (T.LongType, T.IntegerType, T.StringType)) else canonical(x, kind)
        sums += [F.count(x).alias(f"set{i}"), F.hll_sketch_agg(hashed, LOG_BUCKETS).alias(f"distinct{i}")]
        if c.text:
            s = x.cast("string")
            sums += [F.count_if(s == "").alias(f"empty{i}"), F.count_if(s != F.trim(s)).alias(f"space{i}"), F.count_if(s != "").alias(f"filled{i}"), F.count_if(numeric_looking(s)).alias(f"looks{i}")]
        if c.numeric:
            d = x.cast("double")
            sums += [F.min(d).alias(f"lo{i}"), F.max(d).alias(f"hi{i}"), F.sum(d).alias(f"sum{i}"), F.sum(d * d).alias(f"square{i}"), F.kll_sketch_agg_double(d, KLL_K).alias(f"kll{i}")]
    own = df.metadataColumn("_metadata")
    grouped = df.groupBy(own["file_path"].alias("file"), own["file_modification_time"].alias("modified")).agg(*sums)
    none = lambda kind: F.lit(None).cast(kind)

    def of(i: int, c: Profiled) -> Column:
        text = lambda name: F.col(f"{name}{i}") if c.text else F.lit(0).cast("long")
        number = lambda name: F.col(f"{name}{i}") if c.numeric else none("double")
        return F.struct(
            F.lit(c.name).alias("column_name"), F.lit(i).alias("ordinal"), F.col("n").alias("row_count"), F.col(f"set{i}").alias("set_count"), text("empty").alias("empty_count"), text("space").alias("whitespace_count"),
            text("filled").alias("filled_count"), text("looks").alias("numeric_looking_count"), number("lo").alias("min_value"), number("hi").alias("max_value"), number("sum").alias("sum_value"),
            number("square").alias("square_sum"), F.col(f"distinct{i}").alias("distinct_sketch"), (F.when(F.col(f"set{i}") > 0, F.col(f"kll{i}")) if c.numeric else none("binary")).alias("quantile_sketch"),
        )

    rows = grouped.select("file", "modified", F.explode(F.array(*[of(i, c) for i, c in enumerate(columns)])).alias("s"))
    return rows.select(F.lit(table).alias("table_name"), "file", "modified", "s.*")


def merged(state: DataFrame) -> DataFrame:
    """The statistics of all files of a state: those of column_stats(), with estimates of distinct counts, and deviation and quantiles."""
    total = [F.sum(c).alias(c) for c in ("row_count", "set_count", "empty_count", "whitespace_count", "filled_count", "numeric_looking_count", "sum_value", "square_sum")]
    one = state.groupBy("table_name", "column_name").agg(
        F.max("ordinal").alias("ordinal"), *total, F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"), F.count("quantile_sketch").alias("sketches"),
    )
    mean = F.try_divide(F.col("sum_value"), F.col("set_count"))
    missing = F.col("row_count") - F.col("set_count")
    at = F.array(*[F.lit(q) for q in QUANTILES])
    return one.select(
        "table_name", "column_name", "ordinal", "row_count", missing.alias("null_count"), F.coalesce(F.try_divide(missing * 100.0, F.col("row_count")), F.lit(0.0)).alias("null_percent"),
        F.hll_sketch_estimate("distinct_sketch").alias("distinct_count"), "empty_count", "whitespace_count", "filled_count", "numeric_looking_count", "min_value", "max_value", mean.alias("avg_value"),
        F.when(mean.isNotNull(), F.sqrt(F.greatest(F.try_divide(F.col("square_sum"), F.col("set_count")) - mean * mean, F.lit(0.0)))).alias("deviation"),
        F.when(F.col("sketches") > 0, F.kll_sketch_get_quantile_double("quantile_sketch", at)).alias("quantiles"),
    )


def ranks_hold(df: DataFrame, estimates: dict[str, float], share: float, error: float) -> DataFrame:
    """(column_name, holds): whether a value of each numeric column, such as an estimated quantile, lies between the exact quantiles
    share - error and share + error, as F.percentile gives them. Values below it are counted, so no column is sorted or gathered."""
    if not estimates:
        return df.sparkSession.createDataFrame([], "column_name string, holds boolean")
    sums = []
    for i, (name, estimate) in enumerate(estimates.items()):
        x, value = ticked(name).cast("double"), F.lit(float(estimate))
        sums += [F.count(x).alias(f"n{i}"), F.count_if(x < value).alias(f"less{i}"), F.count_if(x <= value).alias(f"upto{i}"), F.max(F.when(x < value, x)).alias(f"under{i}"), F.min(F.when(x > value, x)).alias(f"over{i}")]
    one = df.agg(*sums)

    def quantile(i: int, q: float) -> Column:
        """The quantile, if both values beside its place are the estimate or next to it; else some value on the same side."""
        place = F.lit(q) * (F.col(f"n{i}") - 1)
        value = F.lit(float(list(estimates.values())[i]))
        at = lambda k: F.when(k < F.col(f"less{i}"), F.col(f"under{i}")).when(k < F.col(f"upto{i}"), value).otherwise(F.col(f"over{i}"))
        low, high = at(F.floor(place)), at(F.ceil(place))
        return low + (high - low) * (place - F.floor(place))

    holds = [F.struct(F.lit(name).alias("column_name"), F.lit(float(v)).between(quantile(i, max(0.0, share - error)), quantile(i, min(1.0, share + error))).alias("holds")) for i, (name, v) in enumerate(estimates.items())]
    return one.select(F.explode(F.array(*holds)).alias("h")).select("h.*")


class ProfileStore:
    """Sketches of a database's files in a folder that Spark reaches, beside its context document. Each update writes one new part
    with the files that are new or have changed; an interrupted update leaves no part that counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _all(self) -> DataFrame:
        parts = self._parts()
        return self.spark.read.schema(STATE).parquet(*parts) if parts else self.spark.createDataFrame([], STATE)

    def files(self, path: str) -> DataFrame:
        """(file, modified) of the files at path now: their metadata, no column is read."""
        df = self.spark.read.parquet(path)
        own = df.metadataColumn("_metadata")
        return df.select(own["file_path"].alias("file"), own["file_modification_time"].alias("modified")).distinct()

    def update(self, table: str, path: str, types: dict[str, str] | None = None) -> list[str]:
        """Sketches the table's files at path that are new or changed, and returns them. Their list is as long as the one that Spark
        makes of a folder anyway."""
        known = self._all().filter(F.col("table_name") == table).select("file", "modified").distinct()
        new = sorted(r["file"] for r in self.files(path).join(known, ["file", "modified"], "left_anti").collect())
        if new:
            n = len(self._parts())
            file_sketches(self.spark.read.parquet(*new), table, types).write.mode("overwrite").parquet(f"{self.folder}/parts/{n:08d}")
        return new

    def _parts(self) -> list[str]:
        """The complete parts; one without Spark's mark of success is written over."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/parts")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = (f.getPath() for f in fs.listStatus(path))
        return [str(p) for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def stats(self, table: str, path: str) -> DataFrame:
        """The merged statistics of the table's present files; of a file that has changed only the latest sketches count."""
        present = self.files(path)
        state = self._all().filter(F.col("table_name") == table).join(present, ["file", "modified"], "left_semi")
        return merged(state)

    def document(self, tables: dict[str, str]) -> dict:
        """The merged statistics as part of a context document: {table: {column: {...}}}; tables: their paths."""
        out: dict = {}
        for table, path in tables.items():
            for r in self.stats(table, path).orderBy("ordinal").collect():  # a row for each column
                own = r.asDict()
                out.setdefault(own.pop("table_name"), {})[own.pop("column_name")] = json.loads(json.dumps(own, default=str))
        return out


# Heavy values


def counters(df: DataFrame, column: str, most: int = COUNTERS) -> DataFrame:
    """(value, n, slack) of each task: at most `most` values with counts that are too low by at most the task's slack; the slack stands
    in one row without a value (Misra and Gries, 1982). Values in canonical text; nulls do not count."""

    def count(batches):
        held: dict[str, int] = {}
        slack = 0
        for batch in batches:
            counts = pc.value_counts(batch.column(0))
            for value, n in zip(counts.field("values").to_pylist(), counts.field("counts").to_pylist()):
                held[value] = held.get(value, 0) + n
            if len(held) > most:
                cut = sorted(held.values(), reverse=True)[most]
                slack += cut
                held = {v: n - cut for v, n in held.items() if n > cut}
        yield pa.RecordBatch.from_arrays([pa.array([*held, None], pa.string()), pa.array([*held.values(), 0], pa.int64()), pa.array([0] * len(held) + [slack], pa.int64())], names=["value", "n", "slack"])

    text = canonical(ticked(column), df.schema[column].dataType).alias("value")
    return df.select(text).filter("value IS NOT NULL").mapInArrow(count, "value string, n long, slack long")


def heavy_hitters(df: DataFrame, column: str, top: int = 15, most: int = COUNTERS) -> DataFrame:
    """(value, n): exactly the `top` most frequent values of a column, ties to the smaller value in canonical text.

    Counters of all tasks are added up; a value's true count is at most the sum of the tasks' slacks higher. Only values that
    may then be among the first are counted exactly, in a second pass. Where values without a counter might be (nearly all
    values equally rare), the whole column is grouped.
    """
    found = counters(df, column, most).groupBy("value").agg(F.sum("n").alias("n"), F.sum("slack").alias("slack")).cache()
    try:
        slack = found.filter("value IS NULL").agg(F.sum("slack").alias("s")).first()["s"] or 0
        best = [r["n"] for r in found.filter("value IS NOT NULL").orderBy(F.desc("n")).limit(top).collect()]
        text = canonical(ticked(column), df.schema[column].dataType).alias("value")
        rows = df.select(text).filter("value IS NOT NULL")
        floor = best[-1] if len(best) == top else 0
        if slack:
            candidates = found.filter((F.col("value").isNotNull()) & (F.col("n") + slack >= floor)).select("value")
            if floor > slack and candidates.count() <= MOST_CANDIDATES:
                few = [r["value"] for r in candidates.collect()]  # at most MOST_CANDIDATES
                listed = df.sparkSession.createDataFrame([(v,) for v in few], "value string")
                rows = rows.join(F.broadcast(listed), "value", "left_semi")
        return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(top)
    finally:
        found.unpersist()


def heavy_table(df: DataFrame, table: str, columns: list[str], top: int = 15) -> DataFrame:
    """(table_name, column_name, value, n) of heavy_hitters() for several columns."""
    parts = [heavy_hitters(df, c, top).select(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), "value", "n") for c in columns]
    return reduce(DataFrame.unionAll, parts)
