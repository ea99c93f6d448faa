import random

import pytest

DOCUMENTS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
#: Names that operators use inside; a table may have columns of these names.
CLASHING = "start, size, id, keys, score, shard, slot, anchor, bucket, rep, root, word, uid, ids, lang_pred, held_out, length, offset, file, row, digest, hit, n_words, weight, cluster, class_id, h1, h2, first, n, rank, vec, removed, similarity, spans, _id, _range, _rank, _t"


def make_text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    rng = random.Random(5)
    base = make_text(rng, 120)
    passage = make_text(rng, 70)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [
        (0, base, "en"), (1, base, "en"), (2, near, "en"), (3, None, "en"), (4, "", "de"), (5, "  \t\n ", None), (6, "one", "en"),
        (7, make_text(rng, 30) + " " + passage + " " + make_text(rng, 30), "de"), (8, make_text(rng, 40) + "\n" + passage, "de"),
        (9, make_text(rng, 30_000, 5000), "en"), (10, "12345 !!! 67.8", "en"), (11, "É à la ñ ß 你好 世界", "fr"), (12, "mail a.b@c.de, or +1 (988) 555-2485, host 10.0.0.1, card 4111 1111 1111 1111 end", "en"),
        (12, "mail a.b@c.de, or +1 (988) 555-2485, host 10.0.0.1, card 4111 1111 1111 1111 end", "en"), (13, "ΔΕ  x y " * 30, None), (None, "no id here", "en"), (14, "two words", "en"), (15, "two words", "en"),
        (16, "x" * 5000, "en"), (17, "<|endoftext|> <|ENDOFTEXT|> ▁ mark", "en"), (18, "J\u030c E\u0301 H\u0331 marks", "en"),
    ]
    rows += [(100 + i, make_text(rng, rng.randrange(1, 150)), rng.choice(["en", "de"])) for i in range(60)]
    return [(i, t, lang, f"s{i}", len(t) if t is not None else None) for i, t, lang in rows]


@pytest.fixture(scope="session")
def edge_dir(spark, edge_rows, tmp_path_factory):
    from pyspark.sql import functions as F

    folder = str(tmp_path_factory.mktemp("edge"))
    docs = spark.createDataFrame(edge_rows, DOCUMENTS)
    docs.withColumns({c.strip(): F.lit("clash") for c in CLASHING.split(",")}).write.parquet(f"{folder}/documents.parquet")
    target = [(0, "One TWO words w1 w2 w3 É"), (1, None), (2, ""), (3, edge_rows[0][1]), (3, edge_rows[0][1])]
    spark.createDataFrame(target, "item_id LONG, text STRING").withColumns({c.strip(): F.lit("clash") for c in CLASHING.split(",")}).write.parquet(f"{folder}/benchmark.parquet")
    rng = random.Random(6)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(0, 120)]
    vectors += [(200, vectors[3][1]), (250, vectors[50][1]), (250, vectors[50][1]), (300, [0.0] * 8), (350, None), (400, []), (450, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (600, [1.0, 2.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame(vectors, "vec_id LONG, embedding ARRAY<DOUBLE>")
    table.withColumns({c.strip(): F.lit("clash") for c in CLASHING.split(",")}).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "vec_id LONG, embedding ARRAY<FLOAT>, label INT").write.parquet(f"{folder}/embeddings.parquet")
    spark.createDataFrame([], "item_id LONG, text STRING").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def thue_morse(n):
    return [bin(i).count("1") % 2 for i in range(n)]


@pytest.fixture(scope="session")
def twin_rows():
    """Rows that share a doc_id, with equal and different texts; and texts that differ where sums of products modulo 2^64 do not."""
    rng = random.Random(9)
    passage, base = make_text(rng, 60), make_text(rng, 150)
    near = " ".join(["other", *base.split()[1:]])
    letters = ["".join("ab"[x ^ flip] for x in thue_morse(1024)) for flip in (0, 1)]
    words = [" ".join("ab"[x ^ flip] for x in thue_morse(1024)) for flip in (0, 1)]
    sides = make_text(rng, 30), make_text(rng, 30)
    rows = [
        (1, passage), (2, make_text(rng, 10) + " " + passage), (2, make_text(rng, 200)), (2, passage + " " + make_text(rng, 90)), (2, "short"), (2, None),
        (3, base), (3, base), (3, near), (4, near), (4, make_text(rng, 100)), (5, f"{sides[0]} {letters[0]} {sides[1]}"), (6, f"{sides[0]} {letters[1]} {sides[1]}"),
        (7, words[0]), (8, words[1]), (None, passage), (None, passage), (9, passage + " " + make_text(rng, 80)), (9, passage + " " + make_text(rng, 80)),
    ]
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def twin_dir(spark, twin_rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("twins"))
    spark.createDataFrame(twin_rows, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder
