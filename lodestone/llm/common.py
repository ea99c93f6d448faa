"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rows that are turned into Python objects at a time.
SLICE_ROWS = 256
SLICE_BYTES = 500_000
#: Ranges of the first order column in which gapless() counts.
MOST_RANGES = 256
LEAST = -(1 << 63)
#: Rows of one value that join_few() leaves to one task in any case.
FAIR_ROWS = 500


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where that is unset on one machine, as in tests, one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more, which it does when the driver collects
    garbage. Long iterations call it after each checkpoint."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What a Python worker keeps between tasks, by operator.
_KEPT: dict[str, dict] = {}


def give_back_memory() -> None:
    """Lets free memory of this process go back to the system, now and when arrays of 1 MB and more are freed: else the heap's
    gaps between small objects keep what one stage of a pipeline used while the next one runs in the same worker."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # such arrays get memory of their own
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def worker_for(operator: str) -> dict:
    """Makes a Python worker ready for an operator's tasks; returns what it keeps for them between tasks.

    What other operators kept is dropped and free memory goes back to the system, as a pipeline's stages share the workers.
    """
    if operator not in _KEPT:
        _KEPT.clear()
        gc.collect()
    give_back_memory()
    return _KEPT.setdefault(operator, {})


def rewritten(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder as Parquet and read again. The files stay for as long as the folder does."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files that rewritten() made for df, once nothing reads them any more."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8_slices(batch, column: str = "text"):
    """(first row, list of bytes or None) for slices of an Arrow batch's string column, of at most SLICE_ROWS rows and,
    if of more than one row, SLICE_BYTES; no text is decoded."""
    texts = batch.column(column)
    texts = texts.cast(pa.large_binary()) if pa.types.is_large_string(texts.type) else texts.cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        n = int(np.searchsorted(ends[at : at + SLICE_ROWS], before + SLICE_BYTES, "right"))
        n = max(1, n)
        yield at, texts.slice(at, n).to_pylist()
        at += n


def with_texts(batch: pa.RecordBatch, texts: dict[int, str]) -> pa.RecordBatch:
    """batch with other texts in some rows, and the numbers of their characters in n_chars, if it has such a column of whole numbers."""
    if not texts:
        return batch
    for name, new in (("text", texts), ("n_chars", {i: len(t) for i, t in texts.items()})):
        at = batch.schema.get_field_index(name)
        if at < 0 or name == "n_chars" and not pa.types.is_integer(batch.schema.field(at).type):
            continue
        rows = np.zeros(batch.num_rows, bool)
        rows[list(new)] = True
        column = pc.replace_with_mask(batch.column(at), pa.array(rows), pa.array([new[i] for i in sorted(new)], batch.schema.field(at).type))
        batch = batch.set_column(at, batch.schema.field(at), column)
    return batch


def splits(df: DataFrame, order: list[str], n: int) -> tuple[list[int], dict[int, list[int]]]:
    """(cuts, of_hot): values of the first column of order that cut df's rows into n ranges of about equal size; and for
    values that fill several ranges alone, cuts of their rows by the second column. Both columns are long, null counts as least."""
    if n < 2:
        return [], {}
    key, second = (F.coalesce(F.col(c).cast("long"), F.lit(LEAST)) for c in order[:2])
    got = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 1000).alias("s")).first()["s"] or []
    times = Counter(got)
    hot = {v: k for v, k in times.items() if k > 1}
    parts = {}
    if hot:
        some = df.filter(key.isin(list(hot))).groupBy(key.alias("key")).agg(F.percentile_approx(second, [i / n for i in range(1, n)], 1000).alias("s"))
        for r in some.collect():  # at most n / 2 rows
            k = hot[r["key"]]
            parts[r["key"]] = sorted({r["s"][(n - 1) * i // (k + 1)] for i in range(1, k + 1)})
    return sorted(times), parts


def range_of(order: list[str], cuts: list[int], of_hot: dict[int, list[int]]) -> Column:
    """Number of the range among those that splits() made; ranges follow the order of their rows."""
    if not cuts:
        return F.lit(0)
    key, second = (F.coalesce(F.col(c).cast("long"), F.lit(LEAST)) for c in order[:2])
    below = lambda x, at: F.size(F.filter(F.array(*[F.lit(v) for v in at]), lambda s: s <= x)) if at else F.lit(0)
    within = F.lit(MOST_RANGES)  # a hot value is the least of its range
    for value, at in of_hot.items():
        within = F.when(key == F.lit(value), below(second, at)).otherwise(within)
    return below(key, cuts) * F.lit(MOST_RANGES + 1) + within


def gapless(df: DataFrame, group: str, order: list[str], out: str, n_ranges: int | None = None) -> DataFrame:
    """Adds out: the rank from 0 of each row within its group, in the order of the columns order (the first two are long).

    No group is numbered in one task: rows are cut into ranges of the first order column, and of the second where one
    value of the first fills more than a range; ranks are counted within (range, group), and the counts of the ranges
    before are added. df is read up to three times.
    """
    n = n_ranges or min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts, of_hot = splits(df, order, n)
    df = df.withColumn("_range", range_of(order, cuts, of_hot))
    counts = df.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(group, "_range").orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(within) - 1)
    # one row for each group and range
    joined = ranked.join(counts, (ranked[group] == counts["_group"]) & (ranked["_range"] == counts["_at"]))
    return joined.withColumn(out, (F.col("_rank") + F.col("_before")).cast("long")).drop("_range", "_group", "_at", "_before", "_rank", "_n")


def join_few(rows: DataFrame, few: DataFrame, on: list[str], spread: list[str]) -> DataFrame:
    """rows joined with few, which has one row for each value of the columns on, and n: how many of rows have it.

    A value with more than a fair share of the rows is dealt to several tasks by the columns spread. There are at most
    4 such values for each shuffle partition, so their list is broadcast. few is read three times.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = few.agg(F.sum("n").alias("n")).first()["n"] or 0
    share = max(FAIR_ROWS, total // (4 * parts))
    tasks = F.ceil(F.col("n") / F.lit(share)).cast("int")
    hot = few.filter(F.col("n") > share).select(*[F.col(c).alias(f"_{c}") for c in on], tasks.alias("_tasks"))
    dealt = rows.join(F.broadcast(hot), [F.col(c) == F.col(f"_{c}") for c in on], "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_tasks")).cast("int"), F.lit(0))).drop("_tasks", *[f"_{c}" for c in on])
    few = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(tasks, F.lit(1)) - 1)))
    return dealt.join(few, [*on, "_part"]).drop("_part", "n")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The bytes between words, \\x20 and \\x09 to \\x0D.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes that are hashed at a time.
HASH_BYTES = 1 << 18
#: Words of more bytes are digested one by one.
LONG_WORD = 256


def run_hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A hash of each run of n word hashes. Halves are joined by a mixer at each doubling, so no sum of products remains
    that words could be arranged to cancel."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, np.uint64(seed))
    done, width, parts = 0, 1, words  # parts: the hashes of runs of `width` words
    while True:
        if n & width:
            out = mix64(out * np.uint64(0x9FB21C651E98DF25) + parts[done : done + len(out)])
            done += width
        if done == n:
            return out
        parts = mix64(parts[: len(parts) - width] * np.uint64(0xD1342543DE82EF95) + parts[width:])
        width *= 2


def hash_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): 64-bit hashes of the words of all texts; those of text i are hashes[first[i] : first[i + 1]].

    Words are what bytes.split() yields, mixed eight bytes at a time. No word of usual length becomes an object; long
    texts are hashed piece by piece.
    """
    joined = b" ".join([t or b"" for t in texts])
    begin = np.cumsum([0, *[len(t or b"") + 1 for t in texts]])
    hashes, starts, at = [], [], 0
    while at < len(joined):
        end = min(len(joined), at + HASH_BYTES)
        if end < len(joined):  # not within a word
            last = max(joined.rfind(c, at, end) for c in _BLANKS)
            if last <= at:
                last = min((x for x in (joined.find(c, end) for c in _BLANKS) if x >= 0), default=len(joined) - 1)
            end = last + 1
        piece = joined[at:end] + bytes(8)
        space = SPACE[np.frombuffer(piece, np.uint8, end - at)]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
        hashes.append(_hash_spans(piece, edge[::2], edge[1::2]))
        starts.append(edge[::2] + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begin)


def _hash_spans(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], which ends eight bytes before data at least."""
    size = end - start
    out = mix64(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the number that starts at each byte
    todo = np.flatnonzero(size <= LONG_WORD)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    done = 0
    while len(todo):
        left = size[todo] - done
        part = eight[start[todo] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64))
        out[todo] = mix64((out[todo] ^ part) * np.uint64(0xD1342543DE82EF95))
        todo = todo[left > 8]
        done += 8
    return out


_BLANKS = [bytes([i]) for i in np.flatnonzero(SPACE)]


def digests(parts: Iterable[bytes]) -> np.ndarray:
    """128-bit cryptographic digests, as rows of two 64-bit integers."""
    return np.frombuffer(b"".join([hashlib.blake2b(p, digest_size=16).digest() for p in parts]), "<i8").reshape(-1, 2)
