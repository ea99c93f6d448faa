"""Operators 11 to 13 against brute force: resampling, centroid clustering, deduplication as a stream."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestone.llm import op11_resampling as op11, op12_elkan as op12, op13_stream_dedup as op13

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lower)
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def found_runs(column):
    got = defaultdict(list)
    for n, rows, crcs in op11.word_runs(column):
        assert (np.diff(rows) >= 0).all()
        for r, c in zip(rows.tolist(), crcs.tolist()):
            got[r].append((n, c))
    return got


# 11: importance resampling


@pytest.mark.parametrize("piece", [3, 17, 1 << 18])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abZ09 é你@`[{/:\x00\x7f", max_size=40), st.integers(0, 300).map(lambda n: "x" * n + " y")), max_size=7), st.booleans())
def test_op11_runs_equal_the_definition(piece, texts, sliced):
    column = pa.array(["left out", *texts], pa.string()).slice(1) if sliced else pa.array(texts, pa.large_string())
    before, op11.PIECE = op11.PIECE, piece
    try:
        got = found_runs(column)
    finally:
        op11.PIECE = before
    for i, text in enumerate(texts):
        assert sorted(c for _, c in got[i]) == sorted(features(text)[1])


def test_op11_long_texts_take_little_memory():
    """A text of 20 MB is read in pieces."""
    import tracemalloc

    column = pa.array(["some words é " * 1_500_000])
    tracemalloc.start()
    total = sum(len(c) for _, _, c in op11.word_runs(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 3 * 4_500_000 - 3 and peak < 40_000_000


def brute_resampling(docs, target):
    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(c % 10_000 for _, _, f in own for c in f), Counter(c % 10_000 for x in target for c in features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in s}
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[c % 10_000] for c in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = Counter((r[:4], at) for at, r in enumerate(able[: 5 * len(able) // 100], 1))
    return rows, drawn, 5 * len(able) // 100


def test_op11_equals_brute_force(spark, edge_dir, edge_rows):
    target = [r["text"] for r in spark.read.parquet(f"{edge_dir}/benchmark.parquet").collect()]
    rows, drawn, n = brute_resampling([(r[0], r[1]) for r in edge_rows], target)
    got = op11.op11_importance_resampling(spark, edge_dir).collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(r[:4] for r in rows)
    assert Counter(((r["doc_id"], r["n_features"], r["weight"], r["score"]), r["rank"]) for r in got if r["rank"]) == drawn and n > 0


def test_op11_draws_what_resembles_the_target(spark):
    rng = random.Random(3)
    words = {k: [f"{k}{i}" for i in range(50)] for k in "ab"}
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words["a" if i % 10 == 0 else "b"]) for _ in range(30)), i) for i in range(400)], "doc_id long, text string, extra int")
    target = spark.createDataFrame([(" ".join(words["a"] * 5),)], "text string")
    got = op11.resample(docs, target)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == 20 and all(r["doc_id"] % 10 == 0 for r in rows)


# 12: centroid clustering


def brute_clusters(vectors, k=8, rounds=10):
    """(clusters, distances, centroids) in Python's whole numbers."""
    order = sorted(range(len(vectors)), key=lambda i: (hashlib.sha256(f"3:{vectors[i][0]}".encode()).hexdigest(), vectors[i]))
    at = [list(vectors[i][1]) for i in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    for r in range(rounds + 1):
        own = [min(range(len(at)), key=lambda c: (far(x, at[c]), c)) for _, x in vectors]
        if r < rounds:
            for c in range(len(at)):
                mine = [x for (_, x), o in zip(vectors, own) if o == c]
                at[c] = [sum(col) // len(mine) for col in zip(*mine)] if mine else at[c]
    return own, [far(x, at[o]) for (_, x), o in zip(vectors, own)], at


def clustered(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, vec array<long>").repartition(3)
    found, at = op12.elkan(df)
    return sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), at.tolist()


@pytest.mark.parametrize("kind", ["random", "grid", "copies", "few", "large"])
def test_op12_equals_brute_force(spark, kind):
    rng = random.Random(kind)
    make = {
        "random": lambda: [rng.randrange(-2000, 2000) for _ in range(16)],
        "grid": lambda: [rng.randrange(-1, 2) for _ in range(4)],  # most distances tie
        "copies": lambda: [rng.choice([0, 5])] * 8,
        "few": lambda: [rng.randrange(100) for _ in range(3)],
        "large": lambda: [rng.randrange(-(1 << 30), 1 << 30) for _ in range(3)],
    }[kind]
    vectors = [(i, make()) for i in range(5 if kind == "few" else 120)]
    own, far, at = brute_clusters(vectors)
    got, centroids = clustered(spark, vectors)
    assert got == sorted((i, o, d) for (i, _), o, d in zip(vectors, own, far)) and centroids == at


def test_op12_distances_beyond_64_bits(spark):
    from pyspark.errors import PythonException

    near = [(i, [(1 << 60) + i, -(1 << 60)]) for i in range(20)]
    assert clustered(spark, near)[0] == sorted((i, o, d) for (i, _), o, d in zip(near, *brute_clusters(near)[:2]))
    with pytest.raises(PythonException, match="64 bits"):
        clustered(spark, [(i, [i * (1 << 56), -i]) for i in range(60)])


def test_op12_bounds_skip_most_distances():
    rng = np.random.default_rng(1)
    x = np.rint(np.repeat(rng.normal(0, 5000, (8, 32)), 200, axis=0) + rng.normal(0, 300, (1600, 32))).astype(np.int64)
    now, own = op12.Centroids(x[::200].copy()), np.zeros(len(x), int)
    upper, lower, spent = np.full(len(x), np.inf, np.float32), np.zeros((len(x), 8), np.float32), []
    for _ in range(6):
        own, upper, lower, n = now.assign(x, own, upper, lower)
        true = np.stack([op12.distances(x, c) for c in now.at], axis=1)
        assert (own == true.argmin(axis=1)).all()  # argmin takes the first of equal ones
        assert (upper.astype(float) ** 2 >= true[np.arange(len(x)), own]).all() and (lower.astype(float) ** 2 <= true).all()
        spent.append(n)
        at = np.stack([x[own == c].sum(axis=0) // max(1, (own == c).sum()) for c in range(8)])
        now = op12.Centroids(at, now.at)
    assert spent[0] > 8 * 200 and sum(spent[2:]) < len(x) / 10


def test_op12_query_on_mixed_rows(spark, tmp_path):
    """Null vectors, other lengths, null and non-finite components take no part; repeated ids do."""
    rng = random.Random(4)
    rows = [(i % 90 if i else None, [rng.gauss(0, 1) for _ in range(64)], "x") for i in range(100)]
    bad = [(200, None, "x"), (201, [], "x"), (202, [1.0] * 63, "x"), (203, [None] + [1.0] * 63, "x"), (204, [float("nan")] * 64, "x"), (205, [float("inf")] * 64, "x")]
    spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, cluster string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12.op12_elkan_bounds(spark, str(tmp_path)).collect()
    vectors = [("" if i is None else i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows]
    own, far, at = brute_clusters(vectors)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    inertia = Counter()
    for o, d in zip(own, far):
        inertia[o] += d
    want = Counter((None if i == "" else i, o, d, inertia[o], sum(far), digest[o]) for (i, _), o, d in zip(vectors, own, far))
    assert Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got) == want


# 13: deduplication as a stream


def brute_classes(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    return {t: (max(ids, key=lambda i: (i is not None, i or 0)), len(ids)) for t, ids in by.items()}


def check_classes(got, rows):
    """got: (doc_id, text, keep_id, group_size, kept) for each of rows (doc_id, text)."""
    want = brute_classes(rows)
    assert Counter((r[0], r[1] or "") for r in got) == Counter((i, t or "") for i, t in rows)
    assert all((r[2], r[3]) == want[r[1] or ""] for r in got)
    stay = [r for r in got if r[4]]
    assert Counter(r[1] or "" for r in stay) == Counter(want.keys()) and all(r[0] == r[2] for r in stay)


def with_text(spark, docs, found):
    """Joins what classes() says of each row with its text, by the digest of the text."""
    texts = {hashlib.sha256((r["text"] or "").encode()).digest(): r["text"] for r in docs.collect()}
    return [(r["doc_id"], texts[bytes(r["digest"])], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect()]


def test_op13_equals_brute_force(spark, edge_dir, edge_rows):
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): t for _, t, *_ in edge_rows}
    got = [(r["doc_id"], texts[r["text_sha256"]], r["keep_id"], r["group_size"], r["kept"]) for r in op13.op13_stream_dedup(spark, edge_dir).collect()]
    check_classes(got, [(r[0], r[1]) for r in edge_rows])


def test_op13_rows_that_share_an_id(spark, twin_dir, twin_rows):
    texts = {hashlib.sha256((t or "").encode()).hexdigest(): t for _, t, *_ in twin_rows}
    got = [(r["doc_id"], texts[r["text_sha256"]], r["keep_id"], r["group_size"], r["kept"]) for r in op13.op13_stream_dedup(spark, twin_dir).collect()]
    check_classes(got, [(r[0], r[1]) for r in twin_rows])


def test_op13_state_outlives_the_query(spark, tmp_path):
    """Files that arrive later meet the keys of earlier ones; several micro-batches; the largest doc_id stays, wherever it came."""
    rng = random.Random(8)
    path, folder = f"{tmp_path}/docs", f"{tmp_path}/kept"
    rows = []
    for arrival in range(3):
        new = [(rng.randrange(10_000), rng.choice(["a", "b", "c", None, ""] + [f"text {rng.randrange(60)}"] * 8)) for _ in range(80)]
        rows += new
        spark.createDataFrame(new, "doc_id long, text string").repartition(3).write.mode("append").parquet(path)
        op13.absorb(op13.located_stream(spark, path, files_a_batch=2), folder)
        docs = op13.located(spark, path)
        check_classes(with_text(spark, docs, op13.classes(docs, folder)), rows)
    op13.absorb(op13.located_stream(spark, path), folder)  # nothing new: nothing is counted twice
    docs = op13.located(spark, path)
    check_classes(with_text(spark, docs, op13.classes(docs, folder)), rows)


def test_op13_a_failed_micro_batch_is_repeated(spark, tmp_path, monkeypatch):
    path, folder = f"{tmp_path}/docs", f"{tmp_path}/kept"
    rows = [(i, f"t{i % 7}") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(path)
    writer = type(spark.range(1).write)
    real, calls = writer.parquet, []

    def fails_once(self, to, *a, **b):
        real(self, to, *a, **b)
        calls.append(to)
        if len(calls) == 1:
            raise RuntimeError("lost after the files were written")

    monkeypatch.setattr(writer, "parquet", fails_once)
    with pytest.raises(Exception, match="lost after"):
        op13.absorb(op13.located_stream(spark, path), folder)
    op13.absorb(op13.located_stream(spark, path), folder)
    monkeypatch.undo()
    assert calls[0] == calls[1]  # the same folder, written over
    docs = op13.located(spark, path)
    check_classes(with_text(spark, docs, op13.classes(docs, folder)), rows)


def test_op13_equal_digests_of_different_texts(spark, tmp_path):
    """With digests of 2 bits, nearly every hit is false; the comparison of full bytes tells the texts apart."""
    path, folder = f"{tmp_path}/docs", f"{tmp_path}/kept"
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *[f"text {k}" for k in range(20)]])) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    weak = lambda text: F.unhex(F.lpad(F.hex(F.pmod(F.crc32(text), F.lit(4))), 2, "0"))
    op13.absorb(op13.located_stream(spark, path), folder, weak)
    docs = op13.located(spark, path)
    got = {r["doc_id"]: r for r in op13.classes(docs, folder, weak).collect()}
    assert len({bytes(r["digest"]) for r in got.values()}) == 4
    check_classes([(i, t, got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) for i, t in rows], rows)


def test_op13_filter_loses_nothing(spark):
    rows = spark.range(2000).withColumn("k", F.sha2(F.col("id").cast("string"), 256))
    few = rows.filter("id % 7 = 0")
    got = op13.maybe_among(rows, few, ["k"], "met").collect()
    assert len(got) == 2000 and all(r["met"] == (r["id"] % 7 == 0) for r in got)  # 2,000 keys in 2^26 slots do not meet
