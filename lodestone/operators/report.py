"""Roll-ups of verdicts. Columns of a verdict: id, is_correct, error_type, error_reason, difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import placed

#: Categories of wrong answers by error type. Fixed values.
CATEGORIES = {
    "ambiguous_query": "ambiguous_queries",
    "projection_error": "incorrect_projection",
    "row_count_error": "incorrect_row_count",
    "data_mismatch": "incorrect_data_mismatch",
    "execution_error": "incorrect_execution",
    "timeout_error": "incorrect_timeout",
    "reference_error": "incorrect_reference",
}
ALL_CATEGORIES = ("correct_exact_match", "correct_equivalent", *CATEGORIES.values(), "incorrect_unknown")
DIFFICULTIES = ("simple", "moderate", "challenging", "unknown")


def category() -> Column:
    """The category of a verdict; a tie verdict counts as an exact match."""
    rule = F.when(F.col("is_correct"), F.when(F.col("error_type") == "semantic_match", "correct_equivalent").otherwise("correct_exact_match"))
    for kind, name in CATEGORIES.items():
        rule = rule.when(F.col("error_type") == kind, name)
    return rule.otherwise("incorrect_unknown")


def error_counts(verdicts: DataFrame) -> DataFrame:
    """(error_type, n); counts of parts add up."""
    return verdicts.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


def summary(verdicts: DataFrame) -> DataFrame:
    """One row. correct_rate: exact and equivalent ones; lenient_rate also counts ambiguous and reference errors."""
    kind = lambda *names: F.count_if(F.col("error_type").isin(*names))
    one = verdicts.agg(
        F.count(F.lit(1)).alias("total"),
        kind("exact_match").alias("correct_count"),
        kind("semantic_match", "spj_correct").alias("equivalent_count"),
        kind("ambiguous_query").alias("ambiguous_count"),
        kind("reference_error").alias("reference_error_count"),
    )
    good = F.col("correct_count") + F.col("equivalent_count")
    rate = lambda n: F.coalesce(F.try_divide(n * 100.0, F.col("total")), F.lit(0.0))
    return one.select("*", (F.col("total") - good - F.col("ambiguous_count")).alias("error_count"), rate(good).alias("correct_rate"), rate(good + F.col("ambiguous_count") + F.col("reference_error_count")).alias("lenient_rate"))


def difficulty_breakdown(verdicts: DataFrame) -> DataFrame:
    """(difficulty, total, correct, accuracy, one column for each of the main errors), simple ones first; levels other than the known ones count as unknown."""
    level = F.when(F.col("difficulty").isin(*DIFFICULTIES), F.col("difficulty")).otherwise("unknown")
    errors = [F.count_if(F.col("error_type") == k).alias(k) for k in ("row_count_error", "data_mismatch", "projection_error", "execution_error", "timeout_error")]
    rows = verdicts.groupBy(level.alias("difficulty")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("is_correct")).alias("correct"), *errors)
    return rows.withColumn("accuracy", F.col("correct") * 100.0 / F.col("total")).orderBy(F.array_position(F.array(*[F.lit(d) for d in DIFFICULTIES]), F.col("difficulty")))


def eval_summary(records: DataFrame) -> DataFrame:
    """One row over evaluation records (status, time_seconds, llm_calls, total_tokens): success share and averages."""
    return records.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        (F.coalesce(F.try_divide(F.count_if(F.col("status") == "success") * 100.0, F.count(F.lit(1))), F.lit(0.0))).alias("success_rate"),
        F.avg("time_seconds").alias("avg_seconds"),
        F.avg("llm_calls").alias("avg_llm_calls"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
    )


def select_cases(cases: DataFrame, first: int | None = None, last: int | None = None, limit: int | None = None, difficulty: str | None = None, order: str = "id") -> DataFrame:
    """The cases of a difficulty whose 1-based place by `order` lies in first .. last, `limit` of them at most."""
    if difficulty:
        cases = cases.filter(F.col("difficulty") == difficulty)
    if first is not None or last is not None:
        cases = placed(cases, order, "_place")
        cases = cases.filter((F.col("_place") >= (first or 1)) & (F.col("_place") <= (last if last is not None else 1 << 30))).drop("_place")
    return cases.orderBy(order).limit(limit) if limit is not None else cases
