"""Rules that find suspicious gold statements among judged cases, as column expressions.

Columns of a case: gt_sql, pred_sql, question, evidence, error_type (row_count or data_mismatch), gt_rows, pred_rows
(numbers of data rows), gt_success, pred_success.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.sqltext import parse_verdict
from .tasks import ANSWER_TIMEOUT, ASKING, ask_all

# Word lists. Fixed values.
HIGHEST = r"(?i)\b(highest|most|greatest|maximum|max|best|largest|top|biggest)\b"
LOWEST = r"(?i)\b(lowest|least|minimum|min|worst|smallest|bottom|fewest)\b"
ASCENDING, DESCENDING = r"(?i)ORDER\s+BY\s+\S+\s+ASC", r"(?i)ORDER\s+BY\s+\S+\s+DESC"
CURRENT = r"(?i)\bCURRENT_(TIMESTAMP|DATE|TIME)\b"
LIMIT_ONE = r"(?is)ORDER\s+BY\s+.+LIMIT\s+1(?![0-9])"


def _has(column: str, pattern: str) -> Column:
    return F.coalesce(F.col(column).rlike(pattern), F.lit(False))


def _suspicion(kind: str, reason: Column | str) -> Column:
    return F.struct(F.lit(kind).alias("suspicion_type"), (F.lit(reason) if isinstance(reason, str) else reason).alias("suspicion_reason"))


def sort_direction() -> Column:
    up, down = _has("gt_sql", ASCENDING), _has("gt_sql", DESCENDING)
    high, low = (_has("question", p) | _has("evidence", p) for p in (HIGHEST, LOWEST))
    return F.when(up & ~down & high & ~low, _suspicion("sort_direction_error", "question asks for the highest, gold SQL sorts ascending")).when(down & ~up & low & ~high, _suspicion("sort_direction_error", "question asks for the lowest, gold SQL sorts descending"))


def current_time() -> Column:
    return F.when(_has("gt_sql", CURRENT), _suspicion("current_timestamp_dependency", "gold SQL depends on the current time"))


def tie_handling() -> Column:
    fits = (F.col("error_type") == "row_count") & _has("gt_sql", LIMIT_ONE) & (F.col("pred_rows") > F.col("gt_rows")) & _has("pred_sql", r"(?i)SELECT M(AX|IN)")
    return F.when(fits, _suspicion("tie_handling", F.concat(F.lit("gold SQL returns one row, predicted SQL "), F.col("pred_rows").cast("string"), F.lit(" rows by a subquery; these may be ties"))))


def _only_one(word: str) -> Column:
    a, b = (F.contains(F.upper(F.coalesce(F.col(c), F.lit(""))), F.lit(word)) for c in ("gt_sql", "pred_sql"))
    return a != b


def cast_or_trim() -> Column:
    fits = (F.col("error_type") == "data_mismatch") & F.col("gt_success") & F.col("pred_success") & (F.col("gt_rows") == F.col("pred_rows")) & (F.col("gt_rows") >= 1)
    return F.when(fits & _only_one("CAST("), _suspicion("cast_difference", "only one of the statements uses CAST")).when(fits & _only_one("TRIM("), _suspicion("trim_difference", "only one of the statements uses TRIM"))


def audit(cases: DataFrame) -> DataFrame:
    """cases with suspicion_type, suspicion_reason and phase (`rule`), from the first rule that fits; null where none does."""
    first = F.coalesce(sort_direction(), current_time(), tie_handling(), cast_or_trim())
    return cases.withColumn("_s", first).withColumns({"suspicion_type": F.col("_s")["suspicion_type"], "suspicion_reason": F.col("_s")["suspicion_reason"], "phase": F.when(F.col("_s").isNotNull(), "rule")}).drop("_s")


def model_prompt(case: dict) -> str:
    """What a model is asked about a case that no rule fits."""
    parts = [("Question", case.get("question")), ("Evidence", case.get("evidence")), ("Gold SQL", case.get("gt_sql")), ("Rows of gold SQL", case.get("gt_brief")), ("Predicted SQL", case.get("pred_sql")), ("Rows of predicted SQL", case.get("pred_brief"))]
    told = "\n".join(f"{name}: {value}" for name, value in parts if value)
    return f"{told}\nDoes the gold SQL answer the question? Answer as JSON with `verdict` (GOLD_CORRECT, GOLD_SUSPICIOUS or PRED_BETTER) and `explanation`."


def audit_with_model(audited: DataFrame, generator, workers: int = ASKING, timeout: float = ANSWER_TIMEOUT) -> DataFrame:
    """audited, whose cases that no rule fits were put to a model: GOLD_SUSPICIOUS and PRED_BETTER become suspicions of phase `model`.

    Cases come from a benchmark's list, so those asked about are few enough for the driver. An answer that fails or takes
    too long raises no suspicion. audited has the column id.
    """
    asked = {r["id"]: model_prompt(r.asDict()) for r in audited.filter("suspicion_type IS NULL").collect()}
    found = []
    for id, out in ask_all(asked, generator, workers, timeout).items():
        verdict, explanation = parse_verdict(out.value) if out is not None and out.value else ("", "")
        if verdict in ("GOLD_SUSPICIOUS", "PRED_BETTER"):
            found.append((id, verdict.lower(), explanation))
    told = audited.sparkSession.createDataFrame(found, T.StructType([T.StructField("id", audited.schema["id"].dataType), T.StructField("_type", T.StringType()), T.StructField("_reason", T.StringType())]))
    joined = audited.join(told, "id", "left")
    return joined.withColumns({
        "suspicion_type": F.coalesce("suspicion_type", "_type"),
        "suspicion_reason": F.coalesce("suspicion_reason", "_reason"),
        "phase": F.coalesce("phase", F.when(F.col("_type").isNotNull(), "model")),
    }).select(*audited.columns)


def suspicion_breakdown(audited: DataFrame) -> DataFrame:
    return audited.filter("suspicion_type IS NOT NULL").groupBy("suspicion_type").agg(F.count(F.lit(1)).alias("n"))
