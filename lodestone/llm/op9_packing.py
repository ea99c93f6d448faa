"""Packing of token pieces into sequences: shortest-pack-first over the length histogram (Krell et al., 2021).

The histogram has one count for each length up to the sequence length, whatever the corpus. Lengths are placed from
the longest to the shortest, each time into the packs that are shortest so far; packs of one pattern are handled as
one range of sequence numbers. What comes out are intervals of ranks within a length, each with its sequences and
offset; documents find their place by a join on length and rank.
"""

from __future__ import annotations

import heapq
import os
import zlib
from array import array

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, gapless, read, utf8_slices, worker_for

SEQUENCE = 4096
END_ID = 2
#: Intervals up to this many rows (40 bytes each) are broadcast.
BROADCAST_INTERVALS = 100_000


class WordIds(dict):
    """Packed little-endian ids of words in lower case, remembered up to a bounded number of words.

    The tokenizer's pieces never hold white space, so a text's ids are its words' ids in a row. Two generations are
    kept: a word that is met again while it is in the old one moves to the new one.
    """

    def __init__(self, tokenizer_file: str, most: int = 350_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.old = Tokenizer.from_file(tokenizer_file), most, {}
        self.model = self.tokenizer.model
        self.marks = {x: self.encode(x) for x in (b",", b".")}

    def encode(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def ids(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():  # ASCII letters are one pre-token
            return array("I", [x.id for x in self.model.tokenize(word.decode())]).tobytes()
        if word[-1:] in self.marks and word[-2:-1].isalpha():  # a letter and a mark never share a pre-token
            return self[word[:-1]] + self.marks[word[-1:]]
        return self.encode(word)

    def __missing__(self, word: bytes) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.ids(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


def words_for(tokenizer_file: str | None) -> WordIds:
    """The words that this Python worker remembers."""
    kept, file = worker_for("op9"), tokenizer_file or default_tokenizer()
    if file not in kept:
        kept[file] = WordIds(file)
    return kept[file]


def text_ids(text: bytes | None, words: WordIds) -> bytes:
    """Packed ids of a UTF-8 text, then END_ID."""
    text = text or b""
    if b"<|" in text or b"\xcc" in text or b"\xcd" in text:
        # perhaps a special token, which only counts in lower case, or combining marks, which compose before letters change case
        ids = words.encode(text)
    else:  # the tokenizer puts all in lower case; ASCII first makes no difference
        ids = b"".join(map(words.__getitem__, text.lower().split()))
    return ids + END_ID.to_bytes(4, "little")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, tokenizer_file: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of at most `sequence` ids of each document (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens.

    Null or empty text: the end id alone. Repeated rows get pieces of their own. Very long texts get many pieces.
    """

    def tokenize(batches):
        import pyarrow as pa

        words = words_for(tokenizer_file)
        for batch in batches:
            for at, texts in utf8_slices(batch):
                ids = batch.column("doc_id").slice(at, len(texts)).to_pylist()
                rows = []
                for doc_id, text in zip(ids, texts):
                    packed = text_ids(text, words)
                    total = len(packed) // 4
                    for start in range(0, total, sequence):
                        part = packed[4 * start : 4 * (start + sequence)]
                        rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(tokenize, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_histogram(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, first rank, end rank, first sequence, offset): pieces of that length and rank r lie in
    sequence `first sequence + r - first rank`, at offset. Sequences are numbered from 0 without gaps."""
    intervals: list[tuple[int, int, int, int, int]] = []
    packs: list[tuple[int, int, int]] = []  # (-room, first sequence, number)
    opened = 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        if not 0 < length <= sequence:
            raise ValueError(f"length {length} is not within 1 to {sequence}")
        rank, left = 0, counts[length]
        while left and packs and -packs[0][0] >= length:
            room, first, number = heapq.heappop(packs)
            room, n = -room, min(left, number)
            intervals.append((length, rank, rank + n, first, sequence - room))
            if room > length:
                heapq.heappush(packs, (length - room, first, n))
            if number > n:
                heapq.heappush(packs, (-room, first + n, number - n))
            rank, left = rank + n, left - n
        if left:
            intervals.append((length, rank, rank + left, opened, 0))
            if length < sequence:
                heapq.heappush(packs, (length - sequence, opened, left))
            opened += left
    return intervals


def pack(pieces: DataFrame, order: list[str], sequence: int = SEQUENCE) -> DataFrame:
    """pieces (with a long column length, 1 to sequence) with sequence_id and offset. pieces is read more than once.

    order: columns that order the pieces of a length, the first a long. An empty input gives an empty result.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length at most
    intervals = pack_histogram(counts, sequence)
    made = spark.createDataFrame(intervals, "_length long, _from long, _to long, _first long, offset long")
    made = F.broadcast(made) if len(intervals) <= BROADCAST_INTERVALS else made
    ranked = gapless(pieces, "length", order, "_rank_in")
    on = (F.col("length") == F.col("_length")) & (F.col("_rank_in") >= F.col("_from")) & (F.col("_rank_in") < F.col("_to"))
    placed = ranked.join(made, on).withColumn("sequence_id", F.col("_first") + F.col("_rank_in") - F.col("_from"))
    return placed.drop("_length", "_from", "_to", "_first", "_rank_in")


def pack_documents(docs: DataFrame, tokenizer_file: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = cut(token_pieces(docs, tokenizer_file, sequence))
    return pack(pieces, ["doc_id", "start", "ids_crc32"], sequence).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(docs: DataFrame, placed: DataFrame, tokenizer_file: str | None = None, sequence: int = SEQUENCE, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, filled up with pad_id. placed: what pack_documents gave for docs, whose
    doc_id must be unique here. Texts meet the places of their pieces, then pieces meet in their sequence."""
    import pyarrow as pa

    places = placed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("places")).withColumnRenamed("doc_id", "_id")  # no longer than the document

    def fill(batches):
        words = words_for(tokenizer_file)
        for batch in batches:
            for at, texts in utf8_slices(batch):
                rows = []
                for text, own in zip(texts, batch.column("places").slice(at, len(texts)).to_pylist()):
                    packed = text_ids(text, words)
                    rows += [(p["sequence_id"], p["offset"], packed[4 * p["start"] : 4 * (p["start"] + p["length"])]) for p in own]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["sequence_id", "offset", "packed"])

    def join(batches):
        for batch in batches:
            rows = [b"".join(p["packed"] for p in sorted(own, key=lambda p: p["offset"])) for own in batch.column("parts").to_pylist()]
            ids = [array("I", r.ljust(4 * sequence, b"\0") if pad_id == 0 else r + array("I", [pad_id] * (sequence - len(r) // 4)).tobytes()).tolist() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    met = docs.select("doc_id", "text").join(places, F.col("doc_id") == F.col("_id")).select("text", "places")
    parts = met.mapInArrow(fill, "sequence_id long, offset long, packed binary").groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "packed")).alias("parts"))  # one sequence
    return parts.mapInArrow(join, "sequence_id long, ids array<int>")


def op9_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"))
