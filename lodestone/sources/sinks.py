"""Outputs of evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.report import category, error_counts, summary
from .commits import write_array_parts


def write_predictions(records: DataFrame, path: str) -> None:
    """One line a record in the order of id: the statement, a tab, the database; `SELECT 1` where there is none, white space collapsed."""
    sql = F.trim(F.regexp_replace(F.coalesce("generated_sql", F.lit("")), r"\s+", " "))
    line = F.concat_ws("\t", F.when(sql == "", "SELECT 1").otherwise(sql), "db_id")
    records.orderBy("id").select(line.alias("value")).write.mode("overwrite").text(path)


def append_records(records: DataFrame, path: str) -> None:
    """Adds JSON lines; what is there stays valid at any time."""
    records.write.mode("append").json(path)


def unfinished(records: DataFrame, path: str) -> DataFrame:
    """Those of records (id, ...) whose id is not among the JSON lines at path, for a run that is taken up again."""
    from pyspark.errors import AnalysisException

    try:
        done = records.sparkSession.read.schema("id LONG").json(path).filter("id IS NOT NULL").distinct()
    except AnalysisException:  # nothing is there yet
        return records
    return records.join(done, "id", "left_anti")


def write_json_array(spark: SparkSession, path: str, target: str) -> None:
    """The JSON lines at path as one valid JSON array, a record on each line: the contents of target's files in the order of their names."""
    write_array_parts(spark.read.text(path).filter(F.trim("value") != ""), target)


def read_json_array(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The records of an array that write_json_array() wrote, each line by itself, so the array need not fit into a task; a line that
    is no record is an error."""
    lines = spark.read.text(target).filter("value NOT IN ('[', ']')").select(F.regexp_replace("value", "^,", "").alias("value"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_classified(verdicts: DataFrame, path: str) -> None:
    """JSON lines in one folder for each category."""
    verdicts.withColumn("category", category()).write.mode("overwrite").partitionBy("category").json(path)


def summary_report(verdicts: DataFrame) -> DataFrame:
    """One row: the summary with the counts of errors, most first."""
    counts = error_counts(verdicts).filter("error_type NOT IN ('exact_match', 'semantic_match', 'spj_correct')")
    listed = counts.agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "error_type")))).alias("error_counts"))  # a row for each error type
    return summary(verdicts).crossJoin(listed)


def write_summary(verdicts: DataFrame, path: str) -> None:
    summary_report(verdicts).coalesce(1).write.mode("overwrite").json(path)
