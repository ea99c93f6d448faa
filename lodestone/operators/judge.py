"""Many cases at once: grouped by database, judged in parallel within time limits, as a table of verdicts."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import DatabaseConnectionError
from .compare import Verdict, judge
from .tasks import SLOW, TIMEOUT, WORKERS, run_all, run_with_timeout

VERDICT = "id INT, db_id STRING, question STRING, gt_sql STRING, pred_sql STRING, difficulty STRING, is_correct BOOLEAN, is_equivalent BOOLEAN, error_type STRING, error_reason STRING, strategy STRING, spj_result STRING, seconds DOUBLE, slow BOOLEAN"


def _failed(case: dict, kind: str, reason: str) -> Verdict:
    return Verdict(case["id"], case.get("db_id", ""), case.get("question", ""), case.get("gt_sql") or "", case.get("pred_sql") or "", case.get("difficulty") or "unknown", error_type=kind, error_reason=reason)


def judge_all(spark: SparkSession, cases: list[dict], open_database, workers: int = WORKERS, timeout: float = TIMEOUT, slow: float = SLOW) -> DataFrame:
    """Verdicts on cases (a benchmark's list, so small), ordered by id.

    open_database(db_id) gives an adapter, once for each database; databases run at the same time, their cases one after
    the other. A case over its time is a timeout_error, a database that cannot be opened a db_connection_error.
    """
    groups: dict[str, list[dict]] = {}
    for case in cases:
        groups.setdefault(case.get("db_id", ""), []).append(case)

    def one_database(db_id: str, own: list[dict]):
        try:
            adapter = open_database(db_id)
        except DatabaseConnectionError as e:
            return [(_failed(c, "db_connection_error", str(e)), 0.0, False) for c in own]
        found = []
        for case in own:
            out = run_with_timeout(spark, lambda c=case: judge(c, adapter), timeout, slow)
            if out.timed_out:
                verdict = _failed(case, "timeout_error", f"timeout after {timeout:g} s")
            else:
                verdict = out.value or _failed(case, "unknown_error", out.error)
            found.append((verdict, out.seconds, out.slow))
        return found

    done = run_all({db: (lambda d=db, o=own: one_database(d, o)) for db, own in groups.items()}, workers)
    rows = []
    for verdict, seconds, is_slow in (x for found in done.values() for x in found or ()):
        values = asdict(verdict)
        values.pop("timings")
        rows.append((*values.values(), float(seconds), is_slow))
    return spark.createDataFrame(sorted(rows), VERDICT)
