"""Files of evaluation runs as DataFrames. Schemas are given, so nothing is inferred from data."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

CASE = "id INT, db_name STRING, question STRING, gt_sql STRING, pred_sql STRING, thinking STRING, ambiguous STRING, spj_type STRING, difficulty STRING"
RESULT = "db_id STRING, question STRING, evidence STRING, gold_sql STRING, generated_sql STRING, status STRING, error STRING, time_seconds DOUBLE, llm_calls INT, total_tokens INT, selected_tables ARRAY<STRING>, difficulty STRING"
EXEC = "STRUCT<Success: BOOLEAN, Error: STRING, Rows: ARRAY<ARRAY<STRING>>>"
JUDGED = f"id INT, db_id STRING, question STRING, thinking STRING, difficulty STRING, gt_sql STRING, pred_sql STRING, is_correct BOOLEAN, is_equivalent BOOLEAN, error_reason STRING, gt_result {EXEC}, pred_result {EXEC}, gt_error STRING, pred_error STRING"
SPIDER = "db_id STRING, query STRING, question STRING, result_fields ARRAY<STRING>, result_fields_description STRING"
BIRD = "question_id INT, db_id STRING, question STRING, evidence STRING, SQL STRING, difficulty STRING, result_fields ARRAY<STRING>, result_fields_description STRING"


def read_result_array(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of results as cases, numbered from 1 in the order of the file (one file is one row of text, so its order is known)."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", f"ARRAY<STRUCT<{RESULT.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE').replace(' INT', ': INT').replace(' ARRAY', ': ARRAY')}>>")))
    return rows.select((F.col("pos") + 1).alias("id"), F.col("col.db_id").alias("db_name"), "col.question", F.col("col.gold_sql").alias("gt_sql"), F.col("col.generated_sql").alias("pred_sql"), "col.status", "col.error", "col.time_seconds", "col.llm_calls", "col.total_tokens", "col.selected_tables", F.coalesce("col.difficulty", F.lit("unknown")).alias("difficulty"))


def read_case_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; lines that cannot be read are left out, malformed_lines() has them."""
    return spark.read.schema(CASE).option("mode", "DROPMALFORMED").json(path)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): what read_case_lines() leaves out; empty lines are none."""
    parsed = F.from_json("value", f"{CASE}, _line STRING", {"columnNameOfCorruptRecord": "_line"})
    return spark.read.text(path).filter(F.trim("value") != "").select(parsed["_line"].alias("line")).filter("line IS NOT NULL")


def read_judged_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All judged cases below a folder, one for each id, from the file whose path comes first; reports and summaries are left out."""
    files = spark.read.schema(JUDGED).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    path = F.col("_metadata.file_path")
    cases = files.select(F.struct(*files.columns).alias("case"), path.alias("path")).filter(~F.element_at(F.split("path", "/"), -1).rlike("analysis|report|summary") & F.col("case.id").isNotNull())
    return cases.groupBy(F.col("case.id").alias("_id")).agg(F.min_by("case", "path").alias("case")).select("case.*")


def read_error_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of the incorrect_* categories below a folder: error_type from the category, numbers of data rows, success flags."""
    files = spark.read.schema(JUDGED).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "incorrect_*.json").json(folder)
    kind = F.regexp_extract(F.col("_metadata.file_path"), r"/incorrect_(row_count|data_mismatch|execution|timeout)/", 1)
    rows = lambda c: F.greatest(F.size(F.coalesce(F.col(c)["Rows"], F.array().cast("array<array<string>>"))) - 1, F.lit(0))
    return files.withColumn("error_type", kind).filter("error_type <> ''").withColumns({"gt_rows": rows("gt_result"), "pred_rows": rows("pred_result"), "gt_success": F.coalesce(F.col("gt_result")["Success"], F.lit(False)), "pred_success": F.coalesce(F.col("pred_result")["Success"], F.lit(False))})


def read_benchmark(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Examples of a benchmark's JSON array: kind `spider` or `bird`."""
    return spark.read.schema({"spider": SPIDER, "bird": BIRD}[kind]).option("multiLine", True).json(path)


def read_sql_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sql, db_id) of a file with one statement, a tab and a database on each line."""
    parts = F.split(F.col("value"), "\t")
    return spark.read.text(path).filter(F.trim("value") != "").select(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "\t").alias("sql"), F.element_at(parts, -1).alias("db_id"))


def merge_tags(cases: DataFrame, tags: DataFrame | None) -> DataFrame:
    """cases with spj_type from tags (index, spj_type): index counts from 0 in the order of id. Without tags: null."""
    cases = cases.drop("spj_type")
    if tags is None:
        return cases.withColumn("spj_type", F.lit(None).cast("string"))
    return cases.join(tags.select((F.col("index") + 1).alias("id"), "spj_type"), "id", "left")


def read_tags(spark: SparkSession, path: str) -> DataFrame | None:
    """(index, spj_type) of a JSON array of tags; None if the file is not there."""
    from pyspark.errors import AnalysisException

    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return None
    return text.select(F.posexplode(F.from_json("value", "ARRAY<STRUCT<db_id: STRING, query: STRING, spj_type: STRING>>"))).select(F.col("pos").alias("index"), F.col("col.spj_type").alias("spj_type"))


def discover_results(root: str) -> list[dict]:
    """Runs below <root>/<benchmark>/<time>_<mode>, newest first, from a local or mounted folder: benchmark, run, mode, path."""
    found = []
    for bench in sorted(os.scandir(root), key=lambda e: e.name) if os.path.isdir(root) else ():
        for run in os.scandir(bench.path) if bench.is_dir() else ():
            if m := re.match(r"(\d{8}_\d{6})_(.+)$", run.name):
                found.append({"benchmark": bench.name, "run": m[1], "mode": m[2], "path": run.path})
    return sorted(found, key=lambda r: (r["run"], r["benchmark"]), reverse=True)

