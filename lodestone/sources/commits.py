"""Records that several writers add to one folder: parts of files, made visible by a manifest that is swapped in whole.

A commit has an id of its own. Its records are written to a part of that name first, which nobody reads yet; then the next
manifest lists it as well. Manifests are numbered, and a file system creates a name only once, so of two writers that want the
same number one starts again from the other's manifest. A commit that is repeated with its id changes nothing. What is killed
on the way leaves a part without a manifest, which the next commit of that id writes over.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Times that a writer meets another one's manifest before it gives up.
MOST_TRIES = 100


class RecordFolder:
    """Records in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # The file system.

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        fs, path = self._fs(), self._path("manifests")
        if not fs.exists(path):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(path))
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"([0-9]{12})\.json", n)))

    def _read(self, version: int) -> list[str]:
        lines = self.spark.read.text(f"{self.folder}/manifests/{version:012d}.json", wholetext=True).first()
        return json.loads(lines["value"])["commits"]

    def _swap(self, version: int, commits: list[str]) -> bool:
        """Whether this writer's manifest of that number is the one that counts: it is written aside, and renamed if the name is free."""
        fs = self._fs()
        aside, name = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{version:012d}.json")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps({"commits": commits}).encode()))
        out.close()
        try:
            # a plain rename would take the place of a file on some systems
            if fs.exists(name):
                return False
            lock = self._path(f"manifests/.taken-{version:012d}")
            if not fs.createNewFile(lock):
                return False
            return fs.rename(aside, name)
        finally:
            fs.delete(aside, False)

    # Records.

    def commits(self) -> list[str]:
        """The ids that count, in the order of their commits."""
        versions = self._versions()
        return self._read(versions[-1]) if versions else []

    def commit(self, records: DataFrame, commit_id: str) -> bool:
        """Adds the records as a whole; False, and nothing changes, if this id is there already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", commit_id):
            raise ValueError(f"no name for a commit: {commit_id}")
        if commit_id in self.commits():
            return False
        records.write.mode("overwrite").json(f"{self.folder}/parts/{commit_id}")
        for _ in range(MOST_TRIES):
            versions = self._versions()
            before = self._read(versions[-1]) if versions else []
            if commit_id in before:
                return False
            if self._swap((versions[-1] if versions else 0) + 1, [*before, commit_id]):
                return True
            self._free_stale((versions[-1] if versions else 0) + 1)
        raise RuntimeError("other writers commit all the time")

    def _free_stale(self, version: int, seconds: int = 60) -> None:
        """A number whose writer died between its mark and its manifest is free again after a while."""
        fs, lock = self._fs(), self._path(f"manifests/.taken-{version:012d}")
        if fs.exists(lock) and not fs.exists(self._path(f"manifests/{version:012d}.json")):
            now = self.spark._jvm.System.currentTimeMillis()
            if now - fs.getFileStatus(lock).getModificationTime() > 1000 * seconds:
                fs.delete(lock, False)

    def lines(self) -> DataFrame:
        """(value): the committed records as JSON lines."""
        parts = [f"{self.folder}/parts/{c}" for c in self.commits()]
        return self.spark.read.text(parts).filter(F.trim("value") != "") if parts else self.spark.createDataFrame([], "value string")

    def records(self, schema: str) -> DataFrame:
        parts = [f"{self.folder}/parts/{c}" for c in self.commits()]
        return self.spark.read.schema(schema).json(parts) if parts else self.spark.createDataFrame([], schema)

    def unfinished(self, records: DataFrame, key: str = "id") -> DataFrame:
        """Those of records whose key no commit has, for a run that is taken up again."""
        kind = records.schema[key].dataType.simpleString()
        return records.join(self.records(f"`{key}` {kind}").filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def write_array_parts(lines: DataFrame, target: str, parts: int | None = None) -> None:
    """JSON lines (value) as files whose contents, in the order of their names, are one valid JSON array. Each task writes its own
    file, so no task holds all; a first pass counts lines. lines are cut by their hash, so both passes deal them alike."""
    n = parts or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.select("value", F.pmod(F.xxhash64("value"), F.lit(n)).cast("int").alias("part"))
    met = sorted(r["part"] for r in dealt.select("part").distinct().collect())  # n at most
    first = met[0] if met else 0
    ends = lines.sparkSession.createDataFrame([(0, -1, "["), (n - 1, n, "]")], "part int, rank int, line string")
    rows = dealt.select("part", F.lit(0).alias("rank"), F.col("value").alias("line")).unionAll(ends)

    def written(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        body, head, tail = not met or key[0].as_py() != first, False, False
        for batch in batches:
            out = []
            for rank, line in zip(batch.column("rank").to_pylist(), batch.column("line").to_pylist()):
                if rank:
                    head, tail = head or rank < 0, tail or rank > 0
                else:
                    out.append(f",{line}" if body else line)
                    body = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array([0] * len(out), pa.int32()), pa.array(out, pa.string())], names=["part", "rank", "value"])
        marks = [(-1, "[")] * head + [(1, "]")] * tail
        if marks:
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(marks), pa.int32()), pa.array([m[0] for m in marks], pa.int32()), pa.array([m[1] for m in marks], pa.string())], names=["part", "rank", "value"])

    text = rows.groupBy("part").applyInArrow(written, "part int, rank int, value string")
    text.repartitionByRange(n, "part").sortWithinPartitions("part", "rank").select("value").write.mode("overwrite").text(target)
