"""Target-distribution importance resampling over hashed word n-grams, by a vectorised byte automaton (after Xie et al., 2023).

A text's words are runs of letters, digits and bytes beyond ASCII, A to Z in lower case; its features are all runs of 1 to 3
words, joined by one space. A feature's bucket is its CRC-32 modulo BUCKETS. From the counts of all buckets in the corpus and
in the target texts, each bucket has a gain, the logarithm of the ratio of its smoothed shares; a document's weight is the sum
of the gains of its features. Documents are drawn without replacement by the largest weights plus Gumbel noise.

The bytes of Arrow's string buffer are classified by a table of 256 entries, the differences of the classes are the word
boundaries, and the CRCs of all runs of a piece advance at once, one byte a step, through the CRC's own table. No word
becomes a Python object. A piece is some hundred KB of the buffer, whatever the length of its texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import cut, gapless, read, worker_for

BUCKETS = 10_000
MOST_WORDS = 3
LEAST_WORDS = 20
#: Share of the documents with LEAST_WORDS words that is drawn, in hundredths.
PERCENT = 5
SEED = 42
#: Bytes that are classified at a time; more only where three words are longer.
PIECE = 1 << 18
#: Words of more bytes go through zlib one by one, so that no step advances a few long words alone.
LONG_WORD = 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Whether a byte, in lower case, belongs to a word: 0 to 9, a to z, and all that UTF-8 uses beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def crc_table() -> np.ndarray:
    """The 256 steps of CRC-32, from its polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


CRC = crc_table()


def advanced(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The states of CRC registers after data[start : start + size], all of them one byte a step."""
    order = np.argsort(-size, kind="stable")
    out, at = state[order], start[order]
    n_long = int((size > LONG_WORD).sum())
    for i in range(n_long):
        j = order[i]
        out[i] = zlib.crc32(data[start[j] : start[j] + size[j]], int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    longer = len(size) - np.cumsum(np.bincount(np.minimum(size, LONG_WORD + 1), minlength=LONG_WORD + 2))  # than 0, 1, ... bytes
    for step in range(LONG_WORD):
        live = slice(n_long, int(longer[step]))
        if live.start >= live.stop:
            break
        now = out[live]
        out[live] = CRC[(now ^ data[at[live] + step]) & np.uint32(255)] ^ (now >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def word_runs(column: pa.Array, most: int = MOST_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, rows, crcs) for runs of n = 1 to most words, piece by piece: the row of the text that holds each run, and its CRC-32."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    if data is None or not len(column):
        return
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)
    at, size, stop = int(ends[0]), PIECE, int(ends[-1])
    while at < stop:
        end = min(stop, at + size)
        piece = LOWER[data[at:end]]
        word = WORD[piece]
        edge = np.diff(np.concatenate([[False], word, [False]]).view(np.int8))  # 1: a word begins, -1: one has ended
        new = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, end)] - at  # texts that begin within the piece
        new = np.unique(new[word[new] & word[new - 1]])  # with a word, right behind another text's
        start, close = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
        if len(new):
            start, close = np.sort(np.concatenate([start, new])), np.sort(np.concatenate([close, new]))
        whole = len(start)
        if end < stop:  # the last word may go on, and the `most - 1` before it lack their followers
            whole -= int(whole > 0 and close[-1] == end - at)
            own = max(0, whole - most + 1)
            if not own and len(start):
                size *= 2
                continue
        else:
            own = whole
        row = np.searchsorted(ends, at + start[:whole], "right") - 1
        length = close[:whole] - start[:whole]
        state, first = np.full(own, 0xFFFFFFFF, np.uint32), np.arange(own)
        for n in range(1, most + 1):
            last = first + n - 1
            there = last < whole
            there[there] = row[last[there]] == row[first[there]]
            state, first, last = state[there], first[there], last[there]
            if n > 1:
                state = CRC[(state ^ np.uint32(0x20)) & np.uint32(255)] ^ (state >> np.uint32(8))
            state = advanced(state, piece, start[last], length[last])
            yield n, row[first], state ^ np.uint32(0xFFFFFFFF)
        at, size = (at + int(start[own]) if own < len(start) else end), PIECE


def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts. A partition counts for itself, so `buckets` rows of it are shuffled at most,
    and as many reach the driver."""

    def count(batches):
        worker_for("op11")
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, crc in word_runs(batch.column(0)):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    counted = texts.select(F.col(column).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """For each bucket, floor(1000 * ln of the ratio of its smoothed shares), from its counts."""
    t_all, c_all, buckets = int(target.sum()), int(corpus.sum()), len(target)
    ratio = ((float(t) + 1.0) * float(c_all + buckets) / ((float(c) + 1.0) * float(t_all + buckets)) for t, c in zip(target.tolist(), corpus.tolist()))
    return np.array([math.floor(1000.0 * math.log(x)) for x in ratio], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, keep: list[str], column: str = "text", out: tuple[str, str, str] = ("n_words", "n_features", "weight")) -> DataFrame:
    """The columns keep of docs, with numbers of words and features and the sum of the features' gains."""
    table = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket
    free = "_" * (1 + max(map(len, [*keep, *out])))

    def weigh(batches):
        worker_for("op11")
        value = table.value
        for batch in batches:
            texts, n = batch.column(free), batch.num_rows
            words, features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for of, row, crc in word_runs(texts):
                if len(row):
                    low = int(row[0])  # rows are in order
                    times = np.bincount(row - low)
                    features[low : low + len(times)] += times
                    if of == 1:
                        words[low : low + len(times)] += times
                    # sums of a piece's whole numbers are far below 2^53
                    weight[low : low + len(times)] += np.bincount(row - low, value[crc % np.uint32(len(value))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *map(pa.array, (words, features, weight))], names=[*keep, *out])

    rows = docs.select(*keep, F.col(column).cast("string").alias(free))
    fields = [T.StructField(c, rows.schema[c].dataType) for c in keep] + [T.StructField(c, T.LongType()) for c in out]
    return rows.mapInArrow(weigh, T.StructType(fields))


def scored(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for each row of docs (doc_id, text).

    Of the N rows with least_words words at least, the floor(percent * N / 100) of the highest scores have a rank, from 1;
    ties go to the smaller doc_id. Null texts are empty; a null doc_id is hashed as empty and comes before all others. Rows
    that share a doc_id are drawn one by one.
    """
    gain = gains(bucket_counts(target, buckets=buckets), bucket_counts(docs, buckets=buckets))
    doc_id = F.col("doc_id").cast("long")
    rows = weighed(docs.select(doc_id.alias("doc_id"), "text"), gain, ["doc_id"])
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    rows = cut(rows.withColumn("score", F.col("weight") + noise))
    able = rows.filter(F.col("n_words") >= least_words)
    draw = able.count() * percent // 100
    able = gapless(able.withColumns({"_all": F.lit(0), "_less": -F.col("score")}), "_all", ["_less", "doc_id"], "_place")
    able = able.withColumn("rank", F.when(F.col("_place") < draw, F.col("_place") + 1)).drop("_all", "_less", "_place")
    return able.unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, **how: int) -> DataFrame:
    """The rows of docs that scored() draws, with all their columns. doc_id tells rows apart; rows that share one go together
    as soon as one of them is drawn."""
    drawn = scored(docs, target, **how).filter("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(drawn, docs["doc_id"].cast("long").eqNullSafe(drawn["_drawn"]), "left_semi")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, n_features, weight, score, rank, with the texts of benchmark as the target."""
    docs, target = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return scored(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: DuckDB SQL for op11_importance_resampling; the crc table comes from its polynomial.
ORACLE = rf"""
WITH tab AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::UBIGINT], range(8)::UBIGINT[]),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS v FROM range(256) r(i))),
d AS MATERIALIZED (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS w FROM documents),
texts AS (SELECT uid, w FROM d UNION ALL SELECT NULL, {_WORDS} FROM benchmark),
p AS (SELECT uid, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
f AS MATERIALIZED (SELECT uid, f, count(*) AS n FROM (SELECT uid, w[i] AS f FROM p
  UNION ALL SELECT uid, w[i] || ' ' || w[i + 1] FROM p WHERE i + 1 <= len(w)
  UNION ALL SELECT uid, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM p WHERE i + 2 <= len(w)) GROUP BY ALL),
crc AS MATERIALIZED (SELECT f, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(regexp_extract_all(hex(f), '..'), lambda x: ('0x' || x)::UBIGINT)),
  lambda c, x: xor(c // 256, t[(1 + xor(c % 256, x))::BIGINT])), 4294967295::UBIGINT) % 10000 AS b FROM (SELECT DISTINCT f FROM f), tab),
c AS (SELECT b, coalesce(sum(n) FILTER (WHERE uid IS NOT NULL), 0) AS s, coalesce(sum(n) FILTER (WHERE uid IS NULL), 0) AS t FROM f JOIN crc USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + 10000)::DOUBLE)))::BIGINT AS gain FROM c),
weight AS (SELECT uid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN crc USING (f) JOIN g USING (b) WHERE uid IS NOT NULL GROUP BY uid),
h AS (SELECT uid, doc_id, len(w) AS n_words, ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d),
s AS (SELECT uid, doc_id, n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM h LEFT JOIN weight USING (uid)),
r AS (SELECT uid, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 5 * count(*) // 100 FROM r) THEN rank END::BIGINT AS rank FROM s LEFT JOIN r USING (uid)
"""
