"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A text's letters in lower case make words, each with one blank before and behind; n-grams are the 1 to 3 characters in
a row within a word. A language's profile is its most frequent n-grams by rank; a document's most frequent n-grams are
compared with each profile by the sum of out-of-place distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .common import read, utf8_slices, worker_for

#: n-grams in a profile, and at most so many of a document's.
PROFILE = 400
#: A fit refuses more labels than this, which bounds what is broadcast (PROFILE rows each).
MOST_LANGUAGES = 2048
#: n-grams that a task holds before it adds up equal ones.
HELD = 1_000_000
#: Characters of a text that are looked at together.
BLOCK = 1 << 16
#: Least score of a text that keep_identified() keeps without a label that agrees. Running text of a language that was learnt
#: reaches 0.41 and more (the least of 10,000 documents, a heading in capitals included), other scripts reach nothing.
LEAST_SCORE = 0.35
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def gram_parts(text: bytes | None) -> Iterator[np.ndarray]:
    """Keys of a text's n-grams with repeats: their code points in 21 bits each; BLOCK characters at a time, so that memory
    does not follow the text's length. Without letters, none."""
    lower, tail = (text or b"").decode().lower(), np.array([32], np.int64)  # tail: the last two characters before a block
    met = False
    for at in range(0, len(lower) + 1, BLOCK):
        code = np.frombuffer(lower[at : at + BLOCK].encode("utf-32-le"), np.uint32)
        letter = is_letter()[code]
        met = met or bool(letter.any())
        code = np.where(letter, code, 32).astype(np.int64)
        if at + BLOCK > len(lower):
            code = np.append(code, 32)
        code = code[(code != 32) | (np.append(tail[-1:], code[:-1]) != 32)]  # one blank between words
        run = np.concatenate([tail, code])
        if met and len(code):
            pairs = run[len(tail) - 1 : -1] << 21 | code
            triples = (run[:-2] << 42 | run[1:-1] << 21 | run[2:])[run[1:-1] != 32]
            yield np.concatenate([code[code != 32], pairs, triples])
        tail = run[-2:]


def grams(text: bytes | None) -> np.ndarray:
    """All of gram_parts()."""
    return np.concatenate([np.zeros(0, np.int64), *gram_parts(text)])


def gram_table(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct n-grams, and how often each occurs."""
    waiting: list[np.ndarray] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for part in gram_parts(text):
        waiting.append(part)
        if len(waiting) * BLOCK >= HELD:
            held, waiting = [added_up(np.concatenate([*(k for k, _ in held), *waiting]), np.concatenate([*(n for _, n in held), *(np.ones(len(w), np.int64) for w in waiting)]))], []
    if not held:
        return added_up(np.concatenate([np.zeros(0, np.int64), *waiting]))
    return added_up(np.concatenate([*(k for k, _ in held), *waiting]), np.concatenate([*(n for _, n in held), *(np.ones(len(w), np.int64) for w in waiting)]))


def has_letter(text: bytes | None) -> bool:
    return next(gram_parts(text), None) is not None


def added_up(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and how often each occurs or the sum of its counts."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, counts, len(found)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent keys first, ties to the smaller key."""
    if len(keys) > most:  # drop what cannot be among them
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))][:most]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of docs (text, lang), one row for each language and n-gram."""

    def count(batches):
        import pyarrow as pa

        worker_for("op8")
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush():
            for lang, parts in held.items():
                keys, n = added_up(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        waiting: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for at, texts in utf8_slices(batch):
                for lang, text in zip(batch.column("lang").slice(at, len(texts)).to_pylist(), texts):
                    for own in gram_parts(text):
                        waiting.setdefault(lang, []).append(own)
                        size += len(own)
                        if size <= HELD:
                            continue
                        for key, parts in waiting.items():
                            held.setdefault(key, []).append(added_up(np.concatenate(parts)))
                        waiting.clear()
                        size = 0
                        if sum(len(p[0]) for parts in held.values() for p in parts) > HELD:
                            yield from flush()
        for lang, parts in waiting.items():
            held.setdefault(lang, []).append(added_up(np.concatenate(parts)))
        yield from flush()

    counted = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit_profiles(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles of all languages in docs (text, lang), from every row. Rows without lang, text or letters add nothing."""
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = gram_counts(docs).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= size)
    rows = top.select("lang", "gram", "rank").limit(MOST_LANGUAGES * size + 1).collect()
    if len(rows) > MOST_LANGUAGES * size:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    made: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        made.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(keys, np.int64) for lang, keys in made.items()}


class Profiles:
    """Profiles by n-gram, for all languages at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.keys = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.int64)]))
        self.rank = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int32)
        for i, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.keys, profiles[lang]), i] = np.arange(len(profiles[lang]))

    def predict(self, text: bytes | None) -> tuple[str, float]:
        """(language, 1 - distance / greatest distance); (`und`, 0) without letters or without profiles. Ties go to the first name."""
        own, times = gram_table(text)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(own, times, self.size)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        at = np.where(self.keys[at] == own, at, len(self.keys))
        rank = self.rank[at]
        far = np.where(rank >= 0, np.abs(rank - np.arange(len(own))[:, None]), self.size).sum(axis=0)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.size * len(own)))


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[str], size: int = PROFILE, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns keep of docs (which has a column text) with lang_pred and score, from the text alone."""
    table = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, size))
    docs = docs.select(*dict.fromkeys([*keep, "text"]))

    def predict(batches):
        import pyarrow as pa

        worker_for("op8")
        for batch in batches:
            got = [table.value.predict(text) for _, texts in utf8_slices(batch) for text in texts]
            columns = [pa.array([x[i] for x in got], t) for i, t in ((0, pa.string()), (1, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns], names=[*keep, *out])

    fields = [docs.schema[c] for c in keep]
    return docs.mapInArrow(predict, T.StructType([*fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())]))


def held_out(mod: int) -> Column:
    """Whether crc32(doc_id as text) modulo mod is 0; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == 0


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs without the texts whose language cannot be told; a null lang is filled with the prediction.

    Profiles come from the labelled rows of docs itself. A text stays if its prediction agrees with its label or scores
    least_score at least; so null texts, texts without a letter, and texts in none of the labels' languages go, unless their
    label says so too. Where no row has a label (or docs has no column lang), nothing can be predicted, and all texts with a letter stay.
    """
    if "lang" not in docs.columns:
        return with_letters(docs)
    profiles = fit_profiles(docs)
    if not profiles:
        return with_letters(docs)
    free = "_" * (1 + max(len(c) for c in docs.columns))  # no column has this name
    found = identify(docs, profiles, docs.columns, out=(f"{free}lang", f"{free}score"))
    told = F.col(f"{free}lang")
    keep = (told != UNKNOWN) & (F.coalesce(told == F.col("lang"), F.lit(False)) | (F.col(f"{free}score") >= least_score))
    return found.filter(keep).withColumn("lang", F.coalesce("lang", told)).select(*docs.columns)


def with_letters(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text has a letter."""

    def keep(batches):
        import pyarrow as pa

        worker_for("op8")
        for batch in batches:
            yield batch.filter(pa.array([has_letter(text) for _, texts in utf8_slices(batch) for text in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op8_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Learns from documents that are not held out."""
    docs = read(spark, sf_dir, "documents")
    profiles = fit_profiles(docs.filter(~held_out(5)))
    rows = docs.select("doc_id", held_out(5).alias("held_out"), "text")
    return identify(rows, profiles, ["doc_id", "held_out"])


#: DuckDB SQL for op8_rank_order; the crc table comes from its polynomial.
ORACLE = r"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::UBIGINT], range(8)::UBIGINT[]),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS v FROM range(256) r(i))),
h AS (SELECT doc_id, lang, text, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(regexp_extract_all(coalesce(doc_id::VARCHAR, ''), '.'), lambda c: ascii(c)::UBIGINT)),
  lambda c, x: xor(c // 256, t[(1 + xor(c % 256, x))::BIGINT])), 4294967295::UBIGINT) % 5 = 0 AS held_out FROM documents, tab),
w AS (SELECT doc_id, ' ' || unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) || ' ' AS w FROM h),
c AS (SELECT doc_id, w, length(w) AS k, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT doc_id, g, sum(n) AS n FROM (
  SELECT doc_id, unnest(list_transform(range(2, k), lambda i: w[i])) AS g, n FROM c
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, k), lambda i: w[i:i + 1])), n FROM c
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, k - 1), lambda i: w[i:i + 2])), n FROM c) GROUP BY ALL),
own AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(g), g) AS r FROM g QUALIFY r <= 400),
learnt AS (SELECT lang, g, sum(n) AS n FROM g JOIN h USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
prof AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) AS r FROM learnt QUALIFY r <= 400),
far AS (SELECT doc_id, l.lang, sum(coalesce(abs(own.r - prof.r), 400)) AS d, count(*) AS k FROM own CROSS JOIN (SELECT DISTINCT lang FROM prof) l LEFT JOIN prof ON prof.lang = l.lang AND prof.g = own.g GROUP BY ALL),
best AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY d, lang) = 1)
SELECT h.doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1 - d / (400 * k), 0)::DOUBLE AS score FROM h LEFT JOIN best USING (doc_id)
"""
