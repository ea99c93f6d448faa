"""Roll-ups of an evaluation that is still running, over restarts and records that come twice."""

import json

import pytest

from lodestone.operators import report
from lodestone.streaming import rollups


def record(i, kind, sequence=1, level="simple"):
    return {"id": i, "is_correct": kind in ("exact_match", "semantic_match"), "error_type": kind, "error_reason": None, "difficulty": level, "sequence": sequence}


def append(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))


def totals(spark, folder):
    row = rollups.running_summary(spark, folder).first()
    return row["total"], row["correct_count"], row["equivalent_count"]


def test_restarts_count_nothing_twice(spark, tmp_path):
    records, folder = tmp_path / "records", f"{tmp_path}/state"
    append(records, "a.json", [record(1, "exact_match"), record(2, "row_count_error"), record(3, "semantic_match", level="moderate")])
    rollups.start(spark, str(records), folder, once=True).awaitTermination()
    assert totals(spark, folder) == (3, 1, 1)
    rollups.start(spark, str(records), folder, once=True).awaitTermination()  # nothing new
    assert totals(spark, folder) == (3, 1, 1)
    append(records, "b.json", [record(1, "exact_match"), record(4, "timeout_error"), record(2, "exact_match", 2)])  # 1 again, 2 judged anew
    append(records, "c.json", [record(5, "exact_match"), record(4, "data_mismatch", 0)])  # an older verdict of 4 comes late
    rollups.start(spark, str(records), folder, files_a_batch=1, once=True).awaitTermination()
    assert totals(spark, folder) == (5, 3, 1)
    errors = {r["error_type"]: r["n"] for r in rollups.running_errors(spark, folder).collect()}
    assert errors == {"exact_match": 3, "semantic_match": 1, "timeout_error": 1}
    levels = {r["difficulty"]: (r["total"], r["correct"]) for r in rollups.running_difficulties(spark, folder).collect()}
    assert levels == {"simple": (4, 3), "moderate": (1, 1)}
    batch = rollups.verdicts(spark, folder)
    assert report.summary(batch).first() == rollups.running_summary(spark, folder).first()


def test_a_failed_batch_is_repeated(spark, tmp_path, monkeypatch):
    records, folder = tmp_path / "records", f"{tmp_path}/state"
    append(records, "a.json", [record(i, "exact_match") for i in range(20)])
    writer = type(spark.range(1).write)
    real, calls = writer.parquet, []

    def fails_once(self, to, *a, **b):
        real(self, to, *a, **b)
        calls.append(to)
        if len(calls) == 1:
            raise RuntimeError("lost after writing")

    monkeypatch.setattr(writer, "parquet", fails_once)
    with pytest.raises(Exception, match="lost after"):
        rollups.start(spark, str(records), folder, once=True).awaitTermination()
    rollups.start(spark, str(records), folder, once=True).awaitTermination()
    assert totals(spark, folder) == (20, 20, 0) and calls[0] == calls[1]


def test_nothing_yet_and_bad_lines(spark, tmp_path):
    assert totals(spark, f"{tmp_path}/none") == (0, 0, 0)
    records, folder = tmp_path / "records", f"{tmp_path}/state"
    records.mkdir()
    (records / "a.json").write_text('not json\n{"error_type": "exact_match"}\n' + json.dumps(record(1, "exact_match")) + "\n")
    rollups.start(spark, str(records), folder, once=True).awaitTermination()
    assert totals(spark, folder) == (1, 1, 0)
