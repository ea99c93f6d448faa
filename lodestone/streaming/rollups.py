"""Roll-ups of an evaluation that is still running: a stream over the folder of its records, with the latest verdict of each case as
state.

Records are appended as JSON lines, by several writers and perhaps twice after a failure. The stream keeps one verdict for each
id, that of the record with the greatest sequence (ties: the greatest record as text), so a record that comes again changes
nothing. What a micro-batch touches goes to a folder of its number; a repeated micro-batch writes it over. A query that is
started again goes on where its checkpoint ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.report import difficulty_breakdown, error_counts, summary

RECORD = "id LONG, is_correct BOOLEAN, error_type STRING, error_reason STRING, difficulty STRING, sequence LONG"
#: State on disk, for evaluations of any size.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FIELDS = ["is_correct", "error_type", "error_reason", "difficulty"]


def start(spark: SparkSession, records: str, folder: str, files_a_batch: int = 1000, once: bool = False) -> StreamingQuery:
    """Follows the JSON lines in the folder records; state and results stay in folder. once: what is there now, then it ends."""
    lines = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_a_batch).json(records).filter("id IS NOT NULL")
    latest = lines.groupBy("id").agg(F.max(F.struct(F.coalesce("sequence", F.lit(0)).alias("sequence"), *_FIELDS)).alias("last"), F.count(F.lit(1)).alias("seen"))

    def put(touched: DataFrame, batch: int) -> None:
        touched.write.mode("overwrite").parquet(f"{folder}/touched/batch={batch}")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STATE_STORE)
    try:
        writer = latest.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state")
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """The latest verdict of each case so far, as the batch roll-ups take them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/touched")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], RECORD).drop("sequence")
    touched = spark.read.parquet(f"{folder}/touched")
    latest = touched.groupBy("id").agg(F.max(F.struct("seen", "last")).alias("s"))  # seen only grows
    return latest.select("id", *[F.col(f"s.last.{f}").alias(f) for f in _FIELDS])


def running_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summary(verdicts(spark, folder))


def running_difficulties(spark: SparkSession, folder: str) -> DataFrame:
    return difficulty_breakdown(verdicts(spark, folder))


def running_errors(spark: SparkSession, folder: str) -> DataFrame:
    return error_counts(verdicts(spark, folder))
