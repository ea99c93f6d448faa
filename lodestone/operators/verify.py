"""Checks of a candidate statement before it is accepted: text, then analysis, then a look at its rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.canonical import canonical_frame
from ..sources.adapters import SparkAdapter

SAMPLE_ROWS, SAMPLE_CHARS = 3, 1000
NULL_SHARE = 0.5


@dataclass
class Verification:
    ok: bool
    row_count: int = 0
    sample: list[list] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    error: str = ""


def static_problems(sql: str) -> list[str]:
    """Problems that the text alone shows: an alias that looks like a call, parentheses that do not balance (quotes are not looked at)."""
    found = []
    if m := re.search(r"(?i)\bAS\s+(\w+\s*\()", sql):
        found.append(f"illegal alias: AS {m[1]}")
    depth = 0
    for c in sql:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            break
    if depth:
        found.append("unbalanced parentheses")
    return found


def null_share(df: DataFrame) -> DataFrame:
    """One row (cells, null_cells, null_ratio) over all cells of a result; ratio 0 without rows."""
    df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    nulls = [F.sum(F.col(c).isNull().cast("long")) for c in df.columns]
    total = F.count(F.lit(1)) * len(df.columns)
    one = df.agg(total.alias("cells"), F.coalesce(sum(nulls[1:], nulls[0]), F.lit(0)).alias("null_cells"))
    return one.withColumn("null_ratio", F.coalesce(F.try_divide(F.col("null_cells").cast("double"), F.col("cells")), F.lit(0.0)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, in canonical text, with the column n."""
    rows = canonical_frame(df)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def verify(adapter: SparkAdapter, sql: str) -> Verification:
    """Text, analysis, number of rows, a few rows, and warnings: no row, mostly nulls, repeated rows."""
    if problems := static_problems(sql):
        return Verification(False, error="; ".join(problems))
    outcome = adapter.query(sql)
    if outcome.error:
        return Verification(False, error=outcome.error)
    df = outcome.df.persist()
    try:
        n = df.count()
        found = Verification(True, n, [list(r) for r in df.limit(SAMPLE_ROWS).collect()])
        if not n:
            found.warnings.append("query returned 0 rows")
            return found
        if null_share(df).first()["null_ratio"] > NULL_SHARE:
            found.warnings.append("most cells are NULL")
        if n > 1 and not duplicate_rows(df).isEmpty():
            found.warnings.append("result has duplicate rows")
        return found
    except Exception as e:
        return Verification(False, error=str(e).splitlines()[0])
    finally:
        df.unpersist()


def execute(adapter: SparkAdapter, sql: str, dry_run: bool = False, most: int = 10) -> str:
    """Rows of a statement as text, cut at SAMPLE_CHARS; or its error."""
    if dry_run and (error := adapter.dry_run(sql)):
        return f"Error: {error}"
    outcome = adapter.query(sql)
    if outcome.error:
        return f"Error: {outcome.error}"
    try:
        rows = outcome.df.limit(most + 1).collect()
    except Exception as e:
        return f"Error: {str(e).splitlines()[0]}"
    text = "\n".join([" | ".join(outcome.columns), *[" | ".join("NULL" if v is None else str(v) for v in r) for r in rows[:most]]])
    if len(rows) > most:
        text += "\n..."
    return text if len(text) <= SAMPLE_CHARS else text[:SAMPLE_CHARS] + "... (truncated)"
