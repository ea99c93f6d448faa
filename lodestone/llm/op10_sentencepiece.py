"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

A text is cut into marked words (blanks, then other characters), which no piece crosses, and these where no piece holds
the two characters side by side. The distinct parts of a slice that are not remembered are sorted, which walks their
trie depth first: each one keeps the forward states of the prefix that it shares with the one before, and only the
rest is computed.

For a unigram model the forward state is the best score of a prefix. For a merge (BPE) model, pieces are the states of
a lattice in which a step from piece a to piece b is allowed (score 0) if merging the characters of ab ends in exactly
a, b, and forbidden (minus infinity) otherwise. Each prefix then has one path of finite score, the merge encoding of
that prefix, and the result equals the library's.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import compress, repeat
from operator import not_

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read, utf8_slices, worker_for

MARK = "▁"
#: Marked words of more bytes are not remembered.
LONG_WORD = 64
UNK_PENALTY = 10.0
#: Pairs of pieces that are remembered.
MOST_PAIRS = 400_000
#: In front of a word: no blank was there. No UTF-8 text holds this byte.
NO_MARK = b"\xff"
NOTHING: dict = {}
#: Marks and letters, or one other character.
RUNS = re.compile(f"{MARK}*[^\\W\\d_]+|[\\W\\d_]")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model's pieces, and what encoding and decoding need of them."""

    def __init__(self, model_file: str, most: int = 600_000):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("the model's normalizer is not the identity")
        self.prefix = spec.add_dummy_prefix
        self.merges = model.trainer_spec.model_type == 2
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes = [0] * 256
        self.text: list[bytes] = []  # what each id decodes to
        self.unk, self.fallback = 0, False
        for i, p in enumerate(model.pieces):
            if p.type == 6:  # a byte
                value = int(p.piece[3:5], 16)
                self.bytes[value], self.fallback = i, True
                self.text.append(bytes([value]))
            elif p.type in (2, 3):  # unknown, control
                self.unk = i if p.type == 2 else self.unk
                self.text.append(" ⁇ ".encode() if p.type == 2 else b"")
            else:
                self.text.append(p.piece.replace(MARK, " ").encode())
                if p.type in (1, 4):
                    self.ids[p.piece], self.scores[p.piece] = i, p.score
        self.unk_score = min(self.scores.values()) - UNK_PENALTY
        self.ends: dict = {}  # the pieces read backwards as a trie; None leads to the piece that ends there
        for p in self.ids:
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[None] = p
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}  # characters that a piece holds side by side
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces cross words")
        self.lines = self.fallback and not any("\n" in p for p in self.ids)  # then nothing merges across a line end
        self.words = re.compile(b" *[^ \n]+| +|\n" if self.lines else b" *[^ ]+| +")
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.most = most
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: again and again the two neighbours with the best joint piece, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.scores.get(parts[i] + parts[i + 1], -np.inf), -i))
            both = parts[best] + parts[best + 1]
            if both not in self.scores:
                break
            parts[best : best + 2] = [both]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Whether piece b may come after piece a (nothing, at the start): merging ab ends in a, b. Remembered in pairs."""
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        if not a:
            got = len(b) == 1 or self.merged(b) == [b]
        elif a[-1] + b[0] not in self.inside:
            got = self.follows("", b)
        else:
            got = a + b not in self.scores and self.merged(a + b) == [a, b]
        self.pairs[a, b] = got
        return got

    def encode_words(self, words: list[str]) -> list[list[str]]:
        """Pieces of each of the sorted distinct marked words."""
        out, last = [], ""
        scores, ends = [0.0], [""]  # forward states: for each prefix its score, and the piece that ends it
        step = self._steps_by_merges if self.merges else self._steps_by_scores
        for word in words:
            shared = len(os.path.commonprefix((last, word)))
            del scores[shared + 1 :], ends[shared + 1 :]
            step(word, shared, scores, ends)
            pieces, at = [], len(word)
            while at:
                pieces.append(ends[at])
                at -= len(ends[at])
            out.append(pieces[::-1])
            last = word
        return out

    def _steps_by_merges(self, word: str, shared: int, scores: list, ends: list) -> None:
        """The states of the prefixes longer than `shared`: the one piece that may end there; all scores are 0."""
        trie, pairs = self.ends, self.pairs
        for end in range(shared + 1, len(word) + 1):
            start = end - 1
            node = trie.get(word[start], NOTHING)
            piece = node.get(None, word[start])  # a character without a piece of its own stands as it is
            while True:
                if piece is not None:
                    fits = pairs.get((ends[start], piece))
                    if fits is None:
                        fits = self.follows(ends[start], piece)
                    if fits:
                        break
                start -= 1
                node = node.get(word[start]) if start >= 0 else None
                if node is None:
                    raise AssertionError(f"no piece ends at {end} of {word!r}")
                piece = node.get(None)
            scores.append(0.0)
            ends.append(piece)

    def _steps_by_scores(self, word: str, shared: int, scores: list, ends: list) -> None:
        """The same for a unigram model: the best score, and the last piece on the way to it."""
        for end in range(shared + 1, len(word) + 1):
            start = end - 1
            node = self.ends.get(word[start], NOTHING)
            best, last = scores[start] + self.scores.get(word[start], self.unk_score), word[start]
            while start and (node := node.get(word[start - 1])) is not None:
                start -= 1
                piece = node.get(None)
                if piece is not None and scores[start] + self.scores[piece] > best:
                    best, last = scores[start] + self.scores[piece], piece
            scores.append(best)
            ends.append(last)

    def packed(self, pieces: list[str]) -> bytes:
        ids = array("i")
        for i, p in enumerate(pieces):
            if p in self.ids:
                ids.append(self.ids[p])
            elif self.fallback:
                ids.extend(self.bytes[b] for b in p.encode())
            elif not i or pieces[i - 1] in self.ids:  # unknown characters in a row are one
                ids.append(self.unk)
        return ids.tobytes()

    def split(self, text: bytes) -> list[bytes]:
        """The words of a text, each without the blank in front; NO_MARK in front of a word stands for no blank, and a word
        after several blanks keeps the others."""
        if b"\xe2\x96\x81" in text:  # the mark itself, which the model takes for a blank
            text = text.replace(b"\xe2\x96\x81", b" ")
        if not text:
            return []
        plain = text.replace(b"\n", b" \n " + NO_MARK) if self.lines else text
        if self.prefix and b"  " not in plain and plain[0] != 32 and plain[-1] != 32:
            return plain.split(b" ")
        words = self.words.findall(b" " + text if self.prefix else text)
        return [w[1:] if w[:1] == b" " else w if w == b"\n" else NO_MARK + w for w in words]

    def marked(self, word: bytes) -> str:
        """What split() gave, with marks."""
        if word[:1] == NO_MARK:
            return word[1:].decode().replace(" ", MARK)
        return "\n" if word == b"\n" and self.lines else MARK + word.decode().replace(" ", MARK)

    def cut(self, word: str) -> list[str]:
        """Parts of a marked word that no piece crosses: at ends of runs of letters, where no piece holds both characters."""
        if not self.fallback:  # unknown characters in a row are one piece
            return [word] if word else []
        runs = RUNS.findall(word)
        if len(runs) < 2:
            return runs
        parts = runs[:1]
        for run in runs[1:]:
            if parts[-1][-1] + run[0] in self.inside:
                parts[-1] += run
            else:
                parts.append(run)
        return parts

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Packed ids (32 bits) of each text."""
        split = [self.split(t or b"") for t in texts]
        found = [list(map(self.known.get, words, repeat(b""))) for words in split]
        holes = [list(compress(range(len(got)), map(not_, got))) for got in found]
        missing = {words[i] for words, places in zip(split, holes) for i in places}
        made = {w: self.old[w] for w in missing if w in self.old}
        cut = {w: self.cut(self.marked(w)) for w in missing if w not in made}
        new = sorted({p for parts in cut.values() for p in parts if p not in self.parts})
        parts = dict(zip(new, map(self.packed, self.encode_words(new))))
        for w, own in cut.items():
            made[w] = b"".join([parts[p] if p in parts else self.parts[p] for p in own])
        for words, got, places in zip(split, found, holes):
            for i in places:
                got[i] = made[words[i]]
        out = [b"".join(got) for got in found]
        if len(self.known) > self.most:
            self.old, self.known = self.known, {}
        if len(self.parts) > self.most:
            self.parts = {}
        self.known.update((w, p) for w, p in made.items() if len(w) <= LONG_WORD)
        self.parts.update((w, p) for w, p in parts.items() if len(w) <= LONG_WORD)
        return out

    def decode(self, ids) -> bytes:
        """UTF-8 text of ids."""
        text = b"".join(map(self.text.__getitem__, ids))
        return text[1:] if self.prefix and text[:1] == b" " else text


def pieces_of(model_file: str | None) -> Pieces:
    """The model of a file, with the words that this Python worker remembers."""
    kept, file = worker_for("op10"), model_file or default_model()
    if file not in kept:
        kept[file] = Pieces(file)
    return kept[file]


def encode_texts(docs: DataFrame, keep: list[str], model_file: str | None = None) -> DataFrame:
    """The columns keep of docs (which has a column text) with ids (array<int>) and round_trip: whether decoding the
    ids gives the text again. Null text: as empty, no ids. A text that holds the mark itself comes back with blanks."""
    from pyspark.sql import types as T

    docs = docs.select(*dict.fromkeys([*keep, "text"]))

    def encode(batches):
        import pyarrow as pa

        pieces = pieces_of(model_file)
        for batch in batches:
            for at, texts in utf8_slices(batch):
                packed = pieces.encode(texts)
                ends = np.cumsum([0, *[len(p) // 4 for p in packed]]).astype(np.int32)
                same = [pieces.decode(array("i", p)) == (t or b"") for p, t in zip(packed, texts)]
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], ids, pa.array(same)], names=[*keep, "ids", "round_trip"])

    fields = [docs.schema[c] for c in keep]
    return docs.mapInArrow(encode, T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]))


def decode_ids(encoded: DataFrame, keep: list[str], model_file: str | None = None) -> DataFrame:
    """The columns keep of encoded (which has ids) with text. Null ids: null. Bytes that are no UTF-8 are replaced."""
    from pyspark.sql import types as T

    encoded = encoded.select(*dict.fromkeys([*keep, "ids"]))

    def decode(batches):
        import pyarrow as pa

        pieces = pieces_of(model_file)
        for batch in batches:
            texts = [None if ids is None else pieces.decode(ids).decode(errors="replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "text"])

    fields = [encoded.schema[c] for c in keep]
    return encoded.mapInArrow(decode, T.StructType([*fields, T.StructField("text", T.StringType())]))


def op10_shared_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_ids, ids, round_trip."""
    out = encode_texts(read(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")
