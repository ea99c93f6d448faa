"""Exact substring deduplication behind a count-min prefilter.

A window is W consecutive words of one document. Every word is hashed; each window has an anchor, the least hash of
the runs of A words within it, so equal windows have equal anchors while few runs are anchors. Neighbouring windows
with one anchor make a stretch.

Pass 1: each partition counts its stretches' anchors in a count-min sketch; the partitions' sketches are merged by
range of slots. As an anchor is met in at least as many documents as any window around it, the sketch overestimates
window counts.
Pass 2: stretches whose estimate is at least 2 are grouped exactly, by the 128-bit hash of all their words, with the
least doc_id of each: a whole stretch that an earlier document has too is repeated.
Pass 3: where an anchor's stretches differ, their windows are grouped exactly one by one.
No window that occurs in two documents is lost; an estimate too high only costs time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, digests, hash_words, join_few, mix64, read, with_texts, run_hashes, utf8_slices, worker_for

WINDOW = 50
ANCHOR = 25
#: The sketch has ROWS rows of at most 2^MAX_BITS slots, so at most 32 MB are broadcast, one bit a slot.
ROWS = 2
MIN_BITS, MAX_BITS = 16, 27
#: Ranges of slots in which the partitions' sketches are merged.
RANGES = 64
#: Bits of the filter of anchors whose stretches differ.
ANCHOR_BITS = 26
#: Bytes of a long text that are looked at together.
PART = 1 << 18

_BLANK, _WORD = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\x20\x09-\x0D]+")


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values; none, if there are fewer than n."""
    if len(x) < n:
        return x[:0]
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    rest = n - width
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(words: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The anchor of each window."""
    return sliding_min(run_hashes(words, anchor, 0x9E3779B97F4A7C15), window - anchor + 1)


def slots(a: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix64(a + np.uint64(0x632BE59BD9B4E019 * (i + 1) % (1 << 64))) >> np.uint64(64 - bits)).astype(np.int64) for i in range(ROWS)]


class Stretches:
    """The stretches of a slice of texts: document (place in the slice), first window, number of windows, anchor."""

    def __init__(self, texts: list[bytes | None], window: int, anchor: int, base: int = 0):
        self.texts, self.window = texts, window
        self.base = base  # words of the document before a text that is a part of it
        self.words, self.first = hash_words(texts)
        a = anchors(self.words, window, anchor)
        of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.first))
        n = len(a)
        inside = of[:n] == of[window - 1 :] if n else np.zeros(0, bool)  # not across two texts
        begins = inside.copy()
        if n:  # else of[: n - 1] is not empty
            begins[1:] &= ~inside[:-1] | (a[1:] != a[:-1]) | (of[1:n] != of[: n - 1])
        self.start = np.flatnonzero(begins)
        ends = np.flatnonzero(inside & np.append(begins[1:] | ~inside[1:], True)) if n else self.start
        self.size = ends - self.start + 1
        self.anchor, self.of = a[self.start], of[self.start]

    def keep(self, which: np.ndarray) -> None:
        self.start, self.size, self.anchor, self.of = self.start[which], self.size[which], self.anchor[which], self.of[which]

    def place(self) -> np.ndarray:
        """Number of the first window within its document."""
        return self.start - self.first[self.of] + self.base

    def _digests(self, of: np.ndarray, place: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        def parts():  # one at a time
            own, split = None, []
            for i, a, n in zip(of.tolist(), (place - self.base).tolist(), n_words.tolist()):  # texts in order
                if i != own:
                    own, split = i, self.texts[i].split()
                yield b" ".join(split[a : a + n])

        return digests(parts())

    def keys(self) -> np.ndarray:
        """128-bit digests of all words of each stretch."""
        return self._digests(self.of, self.place(), self.size + self.window - 1)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The stretches' windows one by one: text, place in it, 128-bit digest of the words."""
        of = np.repeat(self.of, self.size)
        place = np.repeat(self.place() - np.cumsum(self.size) + self.size, self.size) + np.arange(self.size.sum())
        return of, place, self._digests(of, place, np.full(len(of), self.window))


def text_parts(text: bytes, overlap: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(words before, words, bytes) of the parts of a text, some hundred KB each, with `overlap` words of the next part behind."""
    at, before = 0, 0
    while at < len(text):
        blank = _BLANK.search(text, at + PART) if at + PART < len(text) else None
        end = blank.start() if blank else len(text)
        own = len(text[at:end].split())
        last = end
        for word in islice(_WORD.finditer(text, end), overlap):
            last = word.end()
        yield before, own, text[at:last]
        at, before = end, before + own


def stretches_of(texts: list[bytes | None], window: int, anchor: int) -> Iterator[Stretches]:
    """The stretches of a slice of texts; those of a long text part by part, each window once. A stretch that ends with its part may
    go on in the next one: then its windows are compared one by one."""
    if len(texts) > 1 or len(texts[0] or b"") <= 2 * PART:
        yield Stretches(texts, window, anchor)
    else:
        for before, _, part in text_parts(texts[0], window - 1):
            yield Stretches([part], window, anchor, before)


def sketch(docs: DataFrame, bits: int, window: int, anchor: int) -> DataFrame:
    """Merged count-min sketch of the anchors of stretches, as one row (row, part, bits) for each range of slots, the bits of
    slots with a count of 2 or more."""
    ranges = min(RANGES, (1 << bits) >> 3)  # whole bytes
    wide = (1 << bits) // ranges

    def count(batches):
        worker_for("op6")
        seen: list[list[np.ndarray]] = [[] for _ in range(ROWS)]
        held = 0

        def flush():
            for row in range(ROWS):
                if not seen[row]:
                    continue
                found, n = np.unique(np.concatenate(seen[row]), return_counts=True)
                seen[row].clear()
                n = np.minimum(n, 2).astype(np.uint8)
                at = np.searchsorted(found, np.arange(ranges + 1) * wide)
                parts = [i for i in range(ranges) if at[i] < at[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row] * len(parts), pa.int32()),
                        pa.array(parts, pa.int32()),
                        pa.array([(found[at[i] : at[i + 1]] - i * wide).astype("<u4").tobytes() for i in parts], pa.binary()),
                        pa.array([n[at[i] : at[i + 1]].tobytes() for i in parts], pa.binary()),
                    ],
                    names=["row", "part", "slots", "counts"],
                )

        for batch in batches:
            for _, texts in utf8_slices(batch):
                for part in stretches_of(texts, window, anchor):
                    for row, s in enumerate(slots(part.anchor, bits)):
                        seen[row].append(s)
                    held += len(part.anchor)
                if held > 4_000_000:
                    yield from flush()
                    held = 0
        yield from flush()

    def merge(key: tuple[pa.Scalar, ...], groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_for("op6")
        total = np.zeros(wide, np.uint8)
        for batch in groups:
            for s, n in zip(batch.column("slots").to_pylist(), batch.column("counts").to_pylist()):
                s = np.frombuffer(s, "<u4")
                total[s] = np.minimum(total[s] + np.frombuffer(n, np.uint8), 2)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary())], names=["row", "part", "bits"])

    parts = docs.filter("doc_id IS NOT NULL").select("text").mapInArrow(count, "row int, part int, slots binary, counts binary")
    return parts.groupBy("row", "part").applyInArrow(merge, "row int, part int, bits binary")


def sketch_bits_for(docs: DataFrame, window: int, anchor: int) -> int:
    """Enough bits for about eight slots a stretch, from the size of the texts."""
    characters = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    expected = max(1, characters // 6 * 2 // (window - anchor + 1))
    return min(MAX_BITS, max(MIN_BITS, int(expected * 8).bit_length()))


def repeated(docs: DataFrame, sketch_bits: int | None = None, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_hash, start, size): windows start .. start + size - 1 of the text of doc_id with this xxhash64, each of
    which a document with a smaller doc_id has too."""
    spark = docs.sparkSession
    docs = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    bits = sketch_bits or sketch_bits_for(docs, window, anchor)
    ranges = min(RANGES, (1 << bits) >> 3)  # whole bytes
    table = np.zeros((ROWS, ranges, (1 << bits) // ranges // 8), np.uint8)
    for r in sketch(docs, bits, window, anchor).collect():  # at most ROWS * 2^MAX_BITS bits
        table[r["row"], r["part"]] = np.frombuffer(r["bits"], np.uint8)
    often = spark.sparkContext.broadcast(table.reshape(ROWS, -1))

    def candidates(texts) -> Iterator[Stretches]:
        bitmap = often.value
        for found in stretches_of(texts, window, anchor):
            keep = np.ones(len(found.anchor), bool)
            for row, s in enumerate(slots(found.anchor, bits)):
                keep &= (bitmap[row][s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
            found.keep(keep)
            if len(found.start):
                yield found

    def find(batches):
        worker_for("op6")
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_numpy(), batch.column("text_hash").to_numpy()
            for at, texts in utf8_slices(batch):
                for found in candidates(texts):
                    k1, k2 = found.keys().T
                    columns = (ids[at + found.of], hashes[at + found.of], found.place().astype(np.int32), found.size.astype(np.int32), found.anchor.view(np.int64), k1, k2)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "text_hash", "start", "size", "anchor", "k1", "k2"])

    stretches = docs.mapInArrow(find, "doc_id long, text_hash long, start int, size int, anchor long, k1 long, k2 long")
    whole = cut(stretches.groupBy("anchor", "k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")))
    copied = whole.filter("first < last").select("k1", "k2", "first", "n")
    by_stretch = join_few(stretches.select("doc_id", "text_hash", "start", "size", "k1", "k2"), copied, ["k1", "k2"], ["doc_id", "start"]).filter("doc_id > first").select("doc_id", "text_hash", "start", "size")
    several = whole.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.shiftrightunsigned("anchor", 64 - ANCHOR_BITS).alias("slot"))
    parts = several.select(F.shiftright("slot", 15).alias("part"), F.col("slot").bitwiseAND(F.lit(32767)).alias("bit")).groupBy("part").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    table = np.zeros(((1 << ANCHOR_BITS) >> 15, 4096), np.uint8)
    for r in parts.collect():  # at most 2^ANCHOR_BITS bits
        table[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    differ = spark.sparkContext.broadcast(table.reshape(-1))

    def expand(batches):
        worker_for("op6")
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_numpy(), batch.column("text_hash").to_numpy()
            for at, texts in utf8_slices(batch):
                for found in candidates(texts):
                    s = (found.anchor >> np.uint64(64 - ANCHOR_BITS)).astype(np.int64)
                    found.keep((differ.value[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1)
                    if not len(found.start):
                        continue
                    of, place, keys = found.windows()
                    k1, k2 = keys.T
                    columns = (ids[at + of], hashes[at + of], place.astype(np.int32), k1, k2)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "text_hash", "start", "k1", "k2"])

    windows = docs.mapInArrow(expand, "doc_id long, text_hash long, start int, k1 long, k2 long")
    first = windows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
    first = cut(first.filter("first < last").select("k1", "k2", "first", "n"))
    by_window = join_few(windows, first, ["k1", "k2"], ["doc_id", "start"]).filter("doc_id > first").select("doc_id", "text_hash", "start", F.lit(1).alias("size"))
    return by_stretch.union(by_window)


def with_repeats(docs: DataFrame, out: str, sketch_bits: int | None = None, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs (doc_id, text and others) with the repeated windows of each row as out: an array of (start, size), null if there is none."""
    found = repeated(docs.select("doc_id", "text"), sketch_bits, window, anchor)
    spans = F.collect_set(F.struct("start", "size")).alias(out)  # a set, as rows that repeat a document repeat its spans
    own, same = f"{out}_id", f"{out}_hash"  # no longer than the document
    removed = found.groupBy(F.col("doc_id").alias(own), F.col("text_hash").alias(same)).agg(spans)
    return docs.join(removed, (docs["doc_id"].cast("long") == F.col(own)) & (F.xxhash64(docs["text"]) == F.col(same)), "left").drop(own, same)


def removed_words(column: pa.Array, window: int) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    """For each row of with_repeats() the disjoint ranges of words, first and end, that its windows cover; None, if there is none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    starts, counts = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
    at = 0
    for n in sizes.tolist():
        if not n:
            yield None
            continue
        start, count = starts[at : at + n], counts[at : at + n]
        at += n
        order = np.argsort(start, kind="stable")
        first, end = start[order], np.maximum.accumulate((start + count)[order] + window - 1)
        apart = first[1:] > end[:-1]
        yield first[np.append(True, apart)], end[np.append(apart, True)]


def kept_words(text: bytes, ranges: tuple[np.ndarray, np.ndarray] | None) -> Iterator[tuple[int, list[bytes]]]:
    """(number of words, words that stay) of the parts of a text."""
    for before, n, part in text_parts(text):
        words = part.split()
        if ranges is not None:
            first, end = ranges
            some = slice(int(np.searchsorted(end, before, "right")), int(np.searchsorted(first, before + n)))
            gone = np.zeros(n + 1, np.int32)
            np.add.at(gone, np.maximum(first[some] - before, 0), 1)
            np.add.at(gone, np.minimum(end[some] - before, n), -1)
            words = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist()) if not g]
        yield n, words


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text and any others) with repeated windows cut out of the text.

    Texts that lose no word stay as they are, others get their kept words joined by one space, and their number of characters
    in n_chars, if there is such a column. Null texts stay null, rows without doc_id stay as they are. Rows that repeat a doc_id
    count as one document, whose texts are cut one by one.
    """
    free = "_" * (1 + max(len(c) for c in docs.columns))  # no column has this name

    def apply(batches):
        worker_for("op6")
        for batch in batches:
            for at, texts in utf8_slices(batch):
                part, ranges = batch.slice(at, len(texts)), list(removed_words(batch.column(free).slice(at, len(texts)), window))
                yield with_texts(part.drop_columns([free]), {i: b" ".join(w for _, some in kept_words(texts[i], r) for w in some).decode() for i, r in enumerate(ranges) if r is not None})

    return with_repeats(docs, free, window=window).mapInArrow(apply, docs.schema)


def op6_count_min_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: doc_id, n_words, n_removed, kept_sha256. Null text: no words. Rows that share a doc_id, with equal or
    different texts, are never repeats of each other; each is judged against smaller doc_ids. Rows without doc_id keep all."""

    def tell(batches):
        worker_for("op6")
        for batch in batches:
            for at, texts in utf8_slices(batch):
                rows = []
                for text, ranges in zip(texts, removed_words(batch.column("removed").slice(at, len(texts)), WINDOW)):
                    digest, total, left = hashlib.sha256(), 0, 0
                    for n, words in kept_words(text or b"", ranges):
                        if words:
                            digest.update(b" " * (left > 0) + b" ".join(words))
                        total, left = total + n, left + len(words)
                    rows.append((total, total - left, digest.hexdigest()))
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_repeats(docs, "removed").mapInArrow(tell, "doc_id long, n_words long, n_removed long, kept_sha256 string")


#: DuckDB SQL for op6_count_min_windows: every window of every document, grouped as text.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT uid, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
win AS (SELECT uid, doc_id, i, CASE WHEN i + 49 <= len(w) THEN sha256(array_to_string(list_slice(w, i, i + 49), ' ')) END AS h FROM p),
first AS (SELECT h, min(doc_id) AS m FROM win WHERE h IS NOT NULL GROUP BY h),
hit AS (SELECT uid, win.i, coalesce(m < win.doc_id, false)::INT AS b FROM win LEFT JOIN first ON win.h = first.h),
cov AS (SELECT uid, i, max(b) OVER (PARTITION BY uid ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM hit),
k AS (SELECT uid, count(*) AS n_words, sum(gone)::BIGINT AS n_removed,
      coalesce(string_agg(d.w[i], ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM cov JOIN d USING (uid) GROUP BY uid)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (uid)
"""
