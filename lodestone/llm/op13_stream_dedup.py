"""Exact deduplication as a stream with keyed state on disk that never expires.

A document's key is the digest of its text. The state (RocksDB, so on disk, and in the checkpoint folder for recovery) keeps for
each key how many rows have had it, the stable identifier of the row that stays so far, that with the largest doc_id, and
the locator of its content: the file and the place of the row in it. Each micro-batch first aggregates within its tasks, so
a text that fills a third of the rows reaches its key's state as one row from each task. The keys that a micro-batch touches
are written to a folder of its number, which a repeated micro-batch overwrites.

A key with several rows is only a hit. The holder's content is fetched by its locator and compared with every hit's full bytes;
copies of one text are dealt to several tasks for this. Rows that differ from their holder in spite of equal digests are
grouped by their texts. Rows whose digest a bit filter of all hits does not know are never shuffled with their texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, join_few, rewritten, shared_folder

#: Bits of the filter of hits, 8 MB; with more hits than fit, more rows pass it.
FILTER_BITS = 26
#: MB that the state's caches may use on an executor, whatever the number of keys.
STATE_MB = 256

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": str(STATE_MB),
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition of the state takes some MB of disk at once
}


def sha256(text: Column) -> Column:
    """The digest that keys use; the 32 bytes of SHA-256 over UTF-8."""
    return F.unhex(F.sha2(text, 256))


def _rows(docs: DataFrame) -> DataFrame:
    own = docs.metadataColumn("_metadata")  # of the file, whatever columns the table has
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), own["file_path"].alias("file"), own["row_index"].alias("row"))


def located(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text, file, row) of the Parquet files at path."""
    return _rows(spark.read.parquet(path))


def located_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """The same as a stream, which takes up files that arrive later as well."""
    folder, _, name = path.rpartition("/")
    # written as a pattern, a path may be a single file
    return _rows(spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(f"{folder}/{{{name}}}"))


def absorb(stream: DataFrame, folder: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Takes what the stream (doc_id, text, file, row) has now into the state in folder, which must be shared. Called again, it goes
    on with what has arrived since; after a failure, with the micro-batch that failed."""
    spark = stream.sparkSession
    keyed = stream.select(digest(F.col("text")).alias("digest"), "doc_id", "file", "row")
    state = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("holder"))

    def put(touched: DataFrame, batch: int) -> None:
        touched.write.mode("overwrite").parquet(f"{folder}/touched/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in _STATE}
    try:
        for k, v in _STATE.items():
            spark.conf.set(k, v)
        query = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    query.awaitTermination()


def holders(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, n, holder: struct<doc_id, file, row>) for each key: what its latest micro-batch left, as n only grows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/touched")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # the stream had nothing
        return spark.createDataFrame([], "digest binary, n long, holder struct<doc_id: long, file: string, row: long>")
    touched = spark.read.parquet(f"{folder}/touched").groupBy("digest").agg(F.max(F.struct("n", "holder")).alias("s"))
    return touched.select("digest", "s.n", "s.holder")


def _slot(*key: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*key), 64 - FILTER_BITS)


def maybe_among(rows: DataFrame, few: DataFrame, key: list[str], out: str) -> DataFrame:
    """rows with the boolean out: false if surely no row of few has the same key, by a bit for each slot of its hash."""
    slots = few.select(_slot(*key).alias("_slot"))
    bits = slots.groupBy(F.shiftright("_slot", 15).alias("_part")).agg(F.expr("bitmap_construct_agg(_slot & 32767)").alias("_bits"))
    rows = rows.withColumn("_of", _slot(*key))
    met = rows.join(F.broadcast(bits), F.shiftright("_of", 15) == F.col("_part"), "left")  # at most 2^FILTER_BITS bits
    at = F.col("_of").bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.pmod(F.expr("shiftright(_byte, cast(_of & 7 as int))"), F.lit(2)) == 1
    return met.withColumn("_byte", byte).withColumn(out, F.coalesce(is_set, F.lit(False))).drop("_of", "_part", "_bits", "_byte")


def classes(docs: DataFrame, folder: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept) for each row of docs (doc_id, text, file, row), all of which absorb() has seen.

    Null texts are equal to empty ones; a null doc_id is smaller than all others. Of rows that share text and doc_id, the one
    with the last locator stays. docs is read three times, its texts are shuffled for hits only.
    """
    spark = docs.sparkSession
    hits = rewritten(holders(spark, folder).filter("n > 1"), "op13-hits")
    keyed = docs.withColumn("digest", digest(F.col("text")))
    flagged = maybe_among(keyed, hits, ["digest"], "hit")
    alone = flagged.filter(~F.col("hit")).select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    # a row for each hit: the content at the holder's locator
    at = hits.select(F.col("digest"), "n", F.col("holder.doc_id").alias("keep_id"), F.col("holder.file").alias("file"), F.col("holder.row").alias("row"))
    held = maybe_among(keyed, at, ["file", "row"], "held").filter("held").select("file", "row", F.col("text").alias("content"))
    contents = at.join(held, ["file", "row"]).select("digest", "n", "keep_id", F.col("file").alias("held_file"), F.col("row").alias("held_row"), "content")
    contents = rewritten(contents.withColumn("group_size", F.col("n")), "op13-contents")
    met = join_few(flagged.filter("hit").drop("hit"), contents, ["digest"], ["file", "row"])
    same = F.col("text") == F.col("content")
    met = met.select("doc_id", "digest", "keep_id", "group_size", "file", "row", "held_file", "held_row", F.when(~same, F.col("text")).alias("odd"))
    met = rewritten(met, "op13-met")
    kept = (F.col("file") == F.col("held_file")) & (F.col("row") == F.col("held_row"))
    odd = met.filter("odd IS NOT NULL").select("doc_id", "digest", "file", "row", "odd")
    there = {c: F.col(c) for c in ("doc_id", "digest", "keep_id", "group_size")}
    # rows that the bit filter lets through without being hits
    missed = flagged.filter("hit").select("doc_id", "digest", "file", "row").join(hits.select("digest"), "digest", "left_anti")
    missed = missed.select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    equal = met.filter("odd IS NULL")
    if odd.isEmpty():
        return alone.union(missed).union(equal.select(*there.values(), kept.alias("kept")))
    # equal digests of different texts
    fewer = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
    equal = equal.join(fewer, "digest", "left").withColumn("group_size", F.col("group_size") - F.coalesce("less", F.lit(0)))
    others = odd.groupBy("digest", "odd").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("holder"))
    others = cut(others.withColumn("group_size", F.col("n")))
    parted = join_few(odd, others, ["digest", "odd"], ["file", "row"])
    last = (F.col("file") == F.col("holder.file")) & (F.col("row") == F.col("holder.row"))
    parted = parted.select("doc_id", "digest", F.col("holder.doc_id").alias("keep_id"), "group_size", last.alias("kept"))
    return alone.union(missed).union(equal.select(*there.values(), kept.alias("kept"))).union(parted)


def op13_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, keep_id, group_size, kept, text_sha256. The state starts empty and is deleted at the end."""
    path, folder = f"{sf_dir}/documents.parquet", f"{shared_folder(spark)}/op13-{uuid.uuid4().hex}"
    absorb(located_stream(spark, path), folder)
    found = cut(classes(located(spark, path), folder))
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: DuckDB SQL for op13_stream_dedup.
ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, last_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER w = count(*) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
