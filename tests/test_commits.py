"""Records of several writers: commits as a whole, repeated and interrupted ones, and arrays written by many tasks."""

import json
import threading
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.sources import commits, sinks
from lodestone.sources.commits import RecordFolder, write_array_parts

SCHEMA = "id long, text string"


def frame(spark, ids):
    return spark.createDataFrame([(i, f"r{i} \"quoted\" é, ]") for i in ids], SCHEMA)


def ids(folder):
    return sorted(r["id"] for r in folder.records(SCHEMA).collect())


def array(folder, target):
    write_array_parts(folder.lines(), str(target), 5)
    text = "".join(p.read_text() for p in sorted(Path(target).glob("part-*.txt")))
    return sorted(r["id"] for r in json.loads(text))


def test_commits_count_once(spark, tmp_path):
    folder = RecordFolder(spark, str(tmp_path / "f"))
    assert ids(folder) == [] and folder.commits() == [] and array(folder, tmp_path / "a0") == []
    assert folder.commit(frame(spark, [1, 2]), "one") and folder.commit(frame(spark, [3]), "two")
    assert not folder.commit(frame(spark, [9]), "one") and ids(folder) == [1, 2, 3] and folder.commits() == ["one", "two"]
    assert array(folder, tmp_path / "a1") == [1, 2, 3]
    rest = folder.unfinished(frame(spark, [2, 3, 4, 5]))
    assert sorted(r["id"] for r in rest.collect()) == [4, 5]
    with pytest.raises(ValueError, match="no name"):
        folder.commit(frame(spark, [1]), "../x")


def test_killed_between_two_commits(spark, tmp_path, monkeypatch):
    """Parts without a manifest are not read; the array stays valid; the same commit can be made again."""
    folder = RecordFolder(spark, str(tmp_path / "f"))
    folder.commit(frame(spark, [1]), "one")

    def killed(self, version, listed):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(RecordFolder, "_swap", killed)
        with pytest.raises(KeyboardInterrupt):
            folder.commit(frame(spark, [2, 3]), "two")
    assert ids(folder) == [1] and array(folder, tmp_path / "a1") == [1]
    assert folder.commit(frame(spark, [2, 3, 4]), "two") and ids(folder) == [1, 2, 3, 4] and array(folder, tmp_path / "a2") == [1, 2, 3, 4]


def test_killed_with_a_number_taken(spark, tmp_path, monkeypatch):
    folder = RecordFolder(spark, str(tmp_path / "f"))
    folder.commit(frame(spark, [1]), "one")
    (tmp_path / "f/manifests/.taken-000000000002").touch()  # by a writer that died before its manifest
    monkeypatch.setattr(commits, "MOST_TRIES", 3)
    with pytest.raises(RuntimeError, match="other writers"):
        folder.commit(frame(spark, [2]), "two")
    monkeypatch.setattr(RecordFolder._free_stale, "__defaults__", (-1,))
    assert folder.commit(frame(spark, [2]), "two") and ids(folder) == [1, 2]


def test_writers_at_the_same_time(spark, tmp_path):
    made, failed = [], []

    def write(n):
        try:
            made.append(RecordFolder(spark, str(tmp_path / "f")).commit(frame(spark, [10 * n, 10 * n + 1]), f"w{n}"))
        except Exception as e:  # shown below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    folder = RecordFolder(spark, str(tmp_path / "f"))
    assert not failed and made == [True] * 6
    assert sorted(folder.commits()) == [f"w{n}" for n in range(6)] and ids(folder) == sorted(x for n in range(6) for x in (10 * n, 10 * n + 1))


@pytest.mark.parametrize("n, parts", [(0, 3), (1, 1), (1, 4), (7, 1), (500, 6)])
def test_arrays_of_many_tasks(spark, tmp_path, n, parts):
    lines = spark.range(n).select(F.to_json(F.struct(F.col("id"), F.lit("a\nb").alias("t"))).alias("value"))
    write_array_parts(lines, str(tmp_path / "out"), parts)
    files = sorted((tmp_path / "out").glob("part-*.txt"))
    got = json.loads("".join(f.read_text() for f in files))
    assert sorted(r["id"] for r in got) == list(range(n))
    assert n < 100 or sum(f.stat().st_size > 0 for f in files) > 2


def test_a_run_becomes_an_array_by_many_tasks(spark, tmp_path):
    path, target = str(tmp_path / "records"), tmp_path / "array"
    sinks.append_records(frame(spark, range(0, 400, 2)), path)
    sinks.append_records(sinks.unfinished(frame(spark, range(400)), path), path)
    sinks.write_json_array(spark, path, str(target))
    files = sorted(target.glob("part-*.txt"))
    assert len(files) > 1 and max(f.stat().st_size for f in files) < 0.6 * sum(f.stat().st_size for f in files)
    assert sorted(r["id"] for r in json.loads("".join(f.read_text() for f in files))) == list(range(400))
    assert Counter(sinks.read_json_array(spark, str(target), SCHEMA).collect()) == Counter(frame(spark, range(400)).collect())
    (target / "part-99999.txt").write_text(",{broken\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        sinks.read_json_array(spark, str(target), SCHEMA).collect()


def test_no_records_are_an_empty_array(spark, tmp_path):
    (tmp_path / "records").mkdir()
    sinks.write_json_array(spark, str(tmp_path / "records"), str(tmp_path / "array"))
    assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "array").glob("part-*.txt")))) == []
    assert sinks.read_json_array(spark, str(tmp_path / "array"), SCHEMA).count() == 0
