"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame expressions only.

A stable integer key and the number of shards decide the shard; there is no ring table. Appending a shard
moves about 1 / (n + 1) of the rows, all into the new shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import gapless, read

#: The generator's multiplier, a fixed value of the published algorithm.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF
#: Jumps tried before the rare rest goes on up to the number of shards.
USUAL_JUMPS = 48


def _and(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask))


def next_state(k: Column) -> Column:
    """k * MULTIPLIER + 1 modulo 2^64, from products that fit into 63 bits, as ANSI mode refuses overflow."""
    cl, ch = F.lit(MULTIPLIER & LOW), F.lit(MULTIPLIER >> 32)
    kl, kh = _and(k, LOW), F.shiftrightunsigned(k, 32)
    p0, p1 = _and(kl, 0xFFFF) * cl, F.shiftright(kl, 16) * cl
    low = _and(p0, LOW) + F.shiftleft(_and(p1, 0xFFFF), 16) + F.lit(1)
    cross = _and(kh, 0xFFFF) * cl + F.shiftleft(_and(F.shiftright(kh, 16) * cl, 0xFFFF), 16) + kl * ch
    high = F.shiftright(p0, 32) + F.shiftright(p1, 16) + F.shiftright(low, 32) + _and(cross, LOW)
    return F.shiftleft(_and(high, LOW), 32).bitwiseOR(_and(low, LOW))


def jump_hash(key: Column, n_shards: int) -> Column:
    """Shard 0 .. n_shards - 1 of a long key."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")

    def step(s: Column, _: Column) -> Column:
        k = next_state(s["k"])
        to = ((s["j"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / (F.shiftrightunsigned(s["k2"], 33) + F.lit(1)).cast("double"))).cast("long")
        return F.when(s["j"] >= F.lit(n_shards), s).otherwise(F.struct(s["k2"].alias("k"), next_state(s["k2"]).alias("k2"), s["j"].alias("b"), to.alias("j")))

    start = F.struct(key.alias("k"), next_state(key).alias("k2"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(n_shards, USUAL_JUMPS) + 1)), start, step)
    if n_shards > USUAL_JUMPS:  # each jump goes up by one at least
        state = F.when(state["j"] >= F.lit(n_shards), state).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(n_shards)), state, step))
    return state["b"].cast("int")


def assign_shards(df: DataFrame, key: str, n_shards: int, out: str = "shard") -> DataFrame:
    """df with its shard. A null key counts as 0. One narrow expression; nothing is shuffled."""
    return df.withColumn(out, jump_hash(F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")), n_shards))


def write_shards(df: DataFrame, key: str, n_shards: int, path: str) -> None:
    """Writes df as Parquet with one folder shard=<number> for each shard; every task adds its own files, so nothing is shuffled."""
    assign_shards(df, key, n_shards).write.partitionBy("shard").parquet(path)


def op3_jump_shards(spark: SparkSession, sf_dir: str, n_shards: int = 8) -> DataFrame:
    """All documents in shards 0 to n_shards - 1 under the law `key`.

    Null text: no bytes (size 1, crc of nothing, 0). Null doc_id: key 0. Repeated rows get slots of their own.
    Other columns of the table are not read. The slot is the rank by doc_id, then crc, within the shard.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))
    slim = docs.select(
        "doc_id",
        (F.octet_length("_t").cast("long") + F.lit(1)).alias("size"),
        F.crc32(F.col("_t").cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    slim = assign_shards(assign_shards(slim, "doc_id", n_shards), "doc_id", n_shards + 1, "grown_shard")
    return gapless(slim, "shard", ["doc_id", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: DuckDB SQL for op3_jump_shards; the crc table comes from its polynomial.
ORACLE = """
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::UBIGINT], range(8)::UBIGINT[]),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS v FROM range(256) r(i))),
texts AS (SELECT coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM (SELECT DISTINCT text FROM documents)),
bytes AS (SELECT text, list_transform(regexp_extract_all(h, '..'), lambda p: ((instr('0123456789ABCDEF', p[1]) - 1) * 16 + instr('0123456789ABCDEF', p[2]) - 1)::UBIGINT) AS b FROM texts),
crcs AS (SELECT text, xor(list_reduce(list_concat([4294967295::UBIGINT], b), lambda c, x: xor(c // 256, t[(1 + xor(c % 256, x))::BIGINT])), 4294967295::UBIGINT)::BIGINT AS crc FROM bytes, tab),
jump AS (
  SELECT DISTINCT coalesce(doc_id, 0) AS key, n, coalesce(doc_id, 0)::UBIGINT::UHUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM documents, (VALUES (8), (9)) s(n)
  UNION ALL
  SELECT key, n, k1, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k1 // 8589934592::UHUGEINT) + 1)::DOUBLE))::BIGINT
  FROM (SELECT *, (k * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT AS k1 FROM jump WHERE j < n) s),
shards AS (SELECT key, n, b::INTEGER AS shard FROM jump WHERE j >= n),
rows AS (SELECT d.doc_id, octet_length(encode(coalesce(d.text, ''))) + 1 AS size, crc AS text_crc32, 'key' AS law, a.shard, g.shard AS grown_shard
  FROM documents d JOIN crcs ON crcs.text = coalesce(d.text, '') JOIN shards a ON a.key = coalesce(d.doc_id, 0) AND a.n = 8 JOIN shards g ON g.key = coalesce(d.doc_id, 0) AND g.n = 9)
SELECT doc_id, size::BIGINT AS size, text_crc32, law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32) - 1 AS slot, grown_shard FROM rows
"""
