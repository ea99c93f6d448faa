"""Near-duplicate classes with DartMinHash signatures (Christiani, 2020) and banded joining.

A document is a weighted set: its runs of five words, weighted by how often they occur. An element of weight w owns the
region [0, w) x time. The region is cut into strips whose widths double, and hashed darts arrive in a strip at the rate
of its width; a dart has a place in the strip, a rank (its time of arrival) and a coordinate, and counts if its place is
below w. The earliest dart of each coordinate is the signature, so coordinates agree with probability equal to the
weighted Jaccard similarity, for any real weights. Only the darts below a rank limit, about k ln k + 2 k for a document,
are thrown, twice as many at most are tried: the cost grows with the number of elements, not with their weights.

Bands of coordinates propose pairs. Equal word sequences are merged first. In each bucket every member is compared with
the bucket's most central member, then with drawn members of other components. What is left in different components
of one bucket goes through an exact prefix join over rare elements, so no link that could join two components is lost
and no group is expanded into all its pairs. Every proposed pair is checked by its exact similarity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, digests, free_shuffles, hash_words, join_few, mix64, read, remove, rewritten, run_hashes, utf8_slices, worker_for
from .components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 36, 7
#: Weights up to this one have a single strip; smaller ones are right too, at the price of darts that miss.
UNIT = 1.0
#: Strips that expect fewer darts get them in rounds, others in a row, so many at a time.
FEW_DARTS, CELLS = 16.0, 1 << 18
#: Bits of the filter of documents that occur in a proposed pair; it holds 8 MB whatever the corpus.
FILTER_BITS = 26
#: Drawn members of other components that each member of a bucket meets.
DRAWS = 3
#: Ratio of the total weights within a size class of the prefix join, and members of a rare element that a task pairs with all.
SIZE_RATIO, MEETING = 1.1, 1024

_STRIP, _DART, _BAND, _PLACE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x94D049BB133111EB)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Sorted keys of elements, and their positive weights.
Weighted = tuple[np.ndarray, np.ndarray]


def shingles(words: np.ndarray, shingle: int = SHINGLE) -> Weighted:
    """A document's elements from its word hashes, weighted by number. A text of fewer words is one shingle; one of none has none."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0)
    keys, n = np.unique(run_hashes(words, min(shingle, len(words)), 0x9E3779B97F4A7C15), return_counts=True)
    return keys, n.astype(np.float64)


def strips(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element, key, width, part of it within the region) of the strips [0, UNIT), [UNIT, 2 UNIT), [2 UNIT, 4 UNIT), ..."""
    n = np.ones(len(keys), np.int64)
    heavy = weights > UNIT
    n[heavy] += np.ceil(np.log2(weights[heavy] / UNIT)).astype(np.int64)
    of = np.repeat(np.arange(len(keys)), n)
    level = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    low = np.where(level > 0, UNIT * 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, UNIT)
    return of, mix64(keys[of] + _STRIP * level.astype(np.uint64)), width, (weights[of] - low) / width


def _darts(keys: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number-th dart of each strip: the wait since the one before at unit rate, and its hash."""
    x = mix64(keys + _DART * (number + np.uint64(1)))
    return -np.log(((x >> np.uint64(24)).astype(np.float64) + 0.5) * 2.0**-40), x


def _keep(table: np.ndarray, row: np.ndarray, rank: np.ndarray, x: np.ndarray, part: np.ndarray, k: int) -> None:
    """Keeps the earliest dart of each row and coordinate, of those whose place is within their region."""
    partial = np.flatnonzero(part < 1)
    if len(partial):
        inside = np.ones(len(x), bool)
        inside[partial] = (mix64(x[partial] ^ _PLACE) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < part[partial]
        row, rank, x = row[inside], rank[inside], x[inside]
    coordinate = ((x & np.uint64(0xFFFFFF)) * np.uint64(k) >> np.uint64(24)).astype(np.int64)
    packed = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (mix64(x) >> np.uint64(32))
    np.minimum.at(table, row * k + coordinate, packed)


def _throw(documents: list[Weighted], k: int, darts: float) -> np.ndarray:
    """The earliest dart of each document and coordinate, of those below the rank limit."""
    table = np.full(len(documents) * k, _EMPTY, np.uint64)
    size = np.array([len(keys) for keys, _ in documents])
    total = np.array([w.sum() for _, w in documents])
    of, keys, width, part = strips(np.concatenate([d[0] for d in documents]), np.concatenate([d[1] for d in documents]))
    row = np.repeat(np.arange(len(documents)), size)[of]
    limit = (darts / total)[row]
    expected = width * limit
    many = expected >= FEW_DARTS
    level = np.ceil(np.log2(expected + 6 * expected**0.5 + 12)).astype(int)
    for e in np.unique(level[many]).tolist():  # ranks are added up one dart after the other, here and below, so they are equal to the bit
        some, number = np.flatnonzero(many & (level == e)), np.arange(1 << e, dtype=np.uint64)
        for at in range(0, len(some), max(1, CELLS >> e)):
            own = some[at : at + max(1, CELLS >> e)]
            wait, x = _darts(keys[own][:, None], number[None, :])
            rank = np.cumsum(wait / width[own][:, None], axis=1)
            i, j = np.nonzero(rank < limit[own][:, None])
            _keep(table, row[own][i], rank[i, j], x[i, j], part[own][i], k)
    few = ~many
    keys, row, width, limit, part = keys[few], row[few], width[few], limit[few], part[few]
    rank, number = np.zeros(len(keys)), 0
    while len(keys):
        wait, x = _darts(keys, np.array([number], np.uint64))
        rank = rank + wait / width
        on = rank < limit
        keys, row, width, limit, part, rank = keys[on], row[on], width[on], limit[on], part[on], rank[on]
        _keep(table, row, rank, x[on], part, k)
        number += 1
    return table.reshape(-1, k)


def signatures(documents: list[Weighted], k: int) -> np.ndarray:
    """k coordinates for each weighted set (none of them empty): rank and hash of the earliest dart."""
    out = np.full((len(documents), k), _EMPTY, np.uint64)
    todo, darts = np.arange(len(documents)), k * np.log(k) + 2 * k
    while len(todo):  # again with twice the darts where a coordinate has none
        out[todo] = _throw([documents[d] for d in todo], k, darts)
        todo = todo[(out[todo] == _EMPTY).any(axis=1)]
        darts *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key of each band of each signature."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _BAND, parts.shape[:2])
    for r in range(rows):
        key = mix64(key ^ parts[:, :, r]) * _STRIP
    return key


def jaccard(a: Weighted, b: Weighted) -> float:
    """Weighted Jaccard similarity: the sum of the lesser weights over that of the greater ones."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return both / (a[1].sum() + b[1].sum() - both)


def packed(document: Weighted) -> bytes:
    """Keys and weights; weights of 1 take no room."""
    keys, weights = document
    other = np.flatnonzero(weights != 1)
    return np.array([len(other)], np.uint64).tobytes() + other.astype(np.uint64).tobytes() + weights[other].tobytes() + keys.tobytes()


def unpacked(data: bytes) -> Weighted:
    parts = np.frombuffer(data, np.uint64)
    n = int(parts[0])
    keys = parts[1 + 2 * n :]
    weights = np.ones(len(keys))
    weights[parts[1 : 1 + n].astype(np.int64)] = parts[1 + n : 1 + 2 * n].view(np.float64)
    return keys, weights


def _whole(texts: list[bytes]) -> np.ndarray:
    return digests(b" ".join(t.split()) for t in texts)


def signature_table(docs: DataFrame, bands: int, rows: int, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, h1, h2, bands) for each row of docs: xxhash64 of the text, 128-bit digest of the word sequence and keys
    of the bands, these null without doc_id or words."""

    def sign(batches):
        import pyarrow as pa

        worker_for("op2")
        for batch in batches:
            for at, texts in utf8_slices(batch):
                ids = batch.column("doc_id").slice(at, len(texts))
                words, first = hash_words(texts)
                there = np.flatnonzero((np.diff(first) > 0) & ids.is_valid().to_numpy(zero_copy_only=False))
                place = np.full(len(texts), -1)
                place[there] = np.arange(len(there))
                take = pa.array(place, mask=place < 0)
                if len(there):
                    keys = band_keys(signatures([shingles(words[first[i] : first[i + 1]], shingle) for i in there], bands * rows), bands, rows)
                    one, two = _whole([texts[i] for i in there]).T
                else:
                    keys, one, two = (np.zeros(0, np.int64) for _ in range(3))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64)))
                columns = [ids.cast(pa.int64()), batch.column("text_hash").slice(at, len(texts)), pa.array(one).take(take), pa.array(two).take(take), lists.take(take)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "h1", "h2", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(sign, "doc_id long, text_hash long, h1 long, h2 long, bands array<long>")


def element_table(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(id, keys): packed elements of the texts in nodes (id, first_id, h1, h2). A filter of fixed size lets few others be read."""
    spark, size = docs.sparkSession, 1 << FILTER_BITS
    slot = F.pmod(F.xxhash64("first_id"), F.lit(size))
    made = nodes.select(F.shiftright(slot, 15).alias("part"), (slot.bitwiseAND(F.lit(32767))).alias("bit")).groupBy("part").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    table = np.zeros((size >> 15, 4096), np.uint8)
    for r in made.collect():  # at most 2^FILTER_BITS bits
        table[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    wanted = spark.sparkContext.broadcast(table.reshape(-1))

    def pack(batches):
        import pyarrow as pa

        worker_for("op2")
        for batch in batches:
            for at, texts in utf8_slices(batch):
                s = batch.column("slot").slice(at, len(texts)).to_numpy()
                there = np.flatnonzero((wanted.value[s >> 3] >> (s & 7).astype(np.uint8)) & 1).tolist()
                there = [i for i in there if texts[i]]
                if there:
                    ids = batch.column("first_id").slice(at, len(texts)).take(pa.array(there))
                    words, first = hash_words([texts[i] for i in there])
                    one, two = _whole([texts[i] for i in there]).T
                    keys = [packed(shingles(words[first[j] : first[j + 1]], shingle)) for j in range(len(there))]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(one), pa.array(two), pa.array(keys, pa.binary())], names=["first_id", "h1", "h2", "keys"])

    source = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("first_id"), "text").withColumn("slot", slot)
    found = source.mapInArrow(pack, "first_id long, h1 long, h2 long, keys binary")
    same = ["first_id", "h1", "h2"]
    return found.join(nodes, same).dropDuplicates(same).select("id", "keys")


def verified(pairs: DataFrame, keys: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose exact similarity is enough, with it."""

    def compare(batches):
        import pyarrow as pa

        worker_for("op2")
        for batch in batches:
            a, b, left, right = (batch.column(c) for c in ("a", "b", "left", "right"))
            last, own = None, None
            out = []
            for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist())):
                if x != last:
                    last, own = x, unpacked(left[i].as_py())
                s = jaccard(own, unpacked(right[i].as_py()))
                if s >= similarity:
                    out.append((x, y, s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "similarity"])

    both = pairs.join(keys.select(F.col("id").alias("b"), F.col("keys").alias("right")), "b").join(keys.select(F.col("id").alias("a"), F.col("keys").alias("left")), "a")
    return both.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long, similarity double")


def _with_roots(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, rep, root) of the buckets that hold more than one component."""
    placed = shared.join(roots, shared["rep"] == roots["id"], "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
    placed = cut(placed)
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select("bucket", "n")
    return join_few(placed, mixed, ["bucket"], ["rep"])


def _drawn_pairs(placed: DataFrame, draws: int) -> DataFrame:
    """Each member of a mixed bucket with `draws` drawn members, if they are of another component: no more pairs than rows times draws."""
    pick = lambda i: F.min(F.struct(F.xxhash64("bucket", "rep", F.lit(i)).alias("h"), "rep", "root"))
    drawn = placed.groupBy("bucket").agg(F.array(*[pick(i) for i in range(draws)]).alias("hubs"), F.count(F.lit(1)).alias("n"))
    met = join_few(placed, drawn, ["bucket"], ["rep"]).select("rep", "root", F.explode("hubs").alias("hub")).filter(F.col("root") != F.col("hub")["root"])
    return met.select(F.least("rep", F.col("hub")["rep"]).alias("a"), F.greatest("rep", F.col("hub")["rep"]).alias("b")).distinct()


def _prefix_pairs(placed: DataFrame, keys: DataFrame, similarity: float) -> DataFrame:
    """Every pair of different components that may be similar enough, among the texts of mixed buckets: a prefix join.

    Two sets of total weights n and m that are similar enough share o = similarity / (1 + similarity) * (n + m) at least.
    With elements in one order, rare ones first, the first element that they share has at most n - o and m - o of their
    weights before it. Sets are kept apart by size class, and each gives for each class of partners only the elements
    that this class's least m allows. Members of an element's largest component are only compared with the others, and
    the others are dealt to tasks MEETING at a time.
    """
    roots = placed.select(F.col("rep").alias("id"), "root").distinct()

    def unpack(batches):
        import pyarrow as pa

        worker_for("op2")
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [unpacked(k) for k in part.column("keys").to_pylist()]
                size = np.array([len(k) for k, _ in sets])
                columns = [pa.array(np.repeat(part.column(c).to_numpy(), size)) for c in ("id", "root")]
                columns += [pa.array(np.repeat(np.array([w.sum() for _, w in sets]), size)), pa.array(np.concatenate([k for k, _ in sets]).view(np.int64)), pa.array(np.concatenate([w for _, w in sets]))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "root", "n", "region", "weight"])

    rows = keys.join(roots, "id").select("id", "root", "keys").mapInArrow(unpack, "id long, root long, n double, region long, weight double")
    often = rows.groupBy("region").agg(F.count(F.lit(1)).alias("f"))
    before = F.coalesce(F.sum("weight").over(Window.partitionBy("id").orderBy("f", "region").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ordered = rows.join(often, "region").withColumn("before", before)
    room = lambda n, least: n - (n + least) * F.lit(similarity / (1 + similarity)) * F.lit(1 - 1e-12)
    kind = lambda n: F.floor(F.log(n) / F.lit(float(np.log(SIZE_RATIO)))).cast("int")
    prefix = ordered.filter(F.col("f") > 1).filter(F.col("before") <= room(F.col("n"), F.col("n") * F.lit(similarity))).withColumn("own", kind(F.col("n")))
    # a class more on either side, as logarithms are rounded
    prefix = prefix.withColumn("met", F.explode(F.sequence(kind(F.col("n") * F.lit(similarity)) - 1, kind(F.col("n") / F.lit(similarity)) + 1)))
    least = F.greatest(F.col("n") * F.lit(similarity), F.pow(F.lit(SIZE_RATIO), F.col("met")) * F.lit(1 - 1e-9))
    prefix = prefix.filter(F.col("before") <= room(F.col("n"), least)).select("region", F.least("own", "met").alias("low"), F.greatest("own", "met").alias("high"), "own", "id", "root", "n", "before")
    prefix = cut(prefix)
    place = ["region", "low", "high"]
    sizes = prefix.groupBy(*place, "root").agg(F.count(F.lit(1)).alias("k"))
    sizes = sizes.groupBy(*place).agg(F.max(F.struct("k", "root"))["root"].alias("major"), F.sum("k").alias("all"), F.max("k").alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    sizes = sizes.select(*place, "major", F.ceil((F.col("all") - F.col("most")) / F.lit(MEETING)).cast("int").alias("parts"))
    told = prefix.join(sizes, place)
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    x = told.filter("root <> major").select(*place, part.alias("part"), F.col("id").alias("p"), F.col("own").alias("p_own"), F.col("root").alias("p_root"), F.col("n").alias("p_n"), F.col("before").alias("p_before"))
    told = told.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("major", "parts")
    both = told.join(x, [*place, "part"]).filter((F.col("root") != F.col("p_root")) & (F.col("own") + F.col("p_own") == F.col("low") + F.col("high")))
    both = both.filter((F.col("before") <= room(F.col("n"), F.col("p_n"))) & (F.col("p_before") <= room(F.col("p_n"), F.col("n"))))
    return both.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()


def _nodes(known: DataFrame) -> DataFrame:
    """(h1, h2, first_id, n, id) for each distinct word sequence: its least doc_id, its rows and an id of its own, which is that doc_id
    unless several sequences have it."""
    least = cut(known.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    shared = least.groupBy("first_id").agg(F.min(F.struct("h1", "h2")).alias("of"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    if shared.isEmpty():
        return least.withColumn("id", F.col("first_id"))
    told = least.join(shared.select("first_id", "of"), "first_id", "left")
    other = F.col("of").isNotNull() & (F.col("of") != F.struct("h1", "h2"))
    return cut(told.withColumn("id", F.when(other, F.xxhash64("first_id", "h1", "h2")).otherwise(F.col("first_id"))).select("h1", "h2", "first_id", "n", "id"))


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """(doc_id, text_hash, class_id) for each row of docs (doc_id, text); class_id: the least doc_id of its group.

    Groups are the components of pairs whose weighted Jaccard similarity over shingles is enough. Null texts and texts
    without words are groups of their own, as are rows without doc_id (class_id null). Rows that share a doc_id are
    judged one by one, each by its own text.
    """
    signed = cut(signature_table(docs, bands, rows, shingle))
    known = signed.filter("h1 IS NOT NULL")
    nodes = _nodes(known.select("doc_id", "h1", "h2"))
    same = ["doc_id", "h1", "h2"]  # of copies the least doc_id only, so no group of copies meets in one task
    reps = known.join(nodes.select(F.col("first_id").alias("doc_id"), "h1", "h2", F.col("id").alias("rep")), same).dropDuplicates(same)
    members = reps.select("rep", F.explode("bands").alias("bucket"))
    sizes = cut(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = cut(join_few(members, sizes.withColumn("size", F.col("n")), ["bucket"], ["rep"]))  # of buckets with more than one text
    proposed = nodes.join(shared.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "first_id", "h1", "h2")
    keys = rewritten(element_table(docs, proposed, shingle), "elements")
    # the first hub of a bucket is its most central member: of texts that come from one source, the source is in most buckets
    central = shared.groupBy("rep").agg(F.sum("size").alias("central")).withColumnRenamed("rep", "of")
    weighed = shared.join(central, F.col("rep") == F.col("of")).select("bucket", F.struct("central", "rep").alias("m"))
    hubs = weighed.groupBy("bucket").agg(F.max("m")["rep"].alias("hub"), F.count(F.lit(1)).alias("n"))
    met = join_few(shared, cut(hubs), ["bucket"], ["rep"]).filter("rep <> hub")
    star = met.select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    links = cut(verified(star, keys, similarity).select("a", "b"))
    free_shuffles(docs.sparkSession)
    roots = cut(connected_components(links))
    placed = cut(_with_roots(shared, roots))
    links = cut(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(verified(_drawn_pairs(placed, DRAWS), keys, similarity).select("a", "b")))
    roots = cut(connected_components(links))
    placed = cut(_with_roots(placed.select("bucket", "rep"), roots))
    free_shuffles(docs.sparkSession)
    links = cut(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(verified(_prefix_pairs(placed, keys, similarity), keys, similarity).select("a", "b")))
    remove(docs.sparkSession, keys)
    roots = connected_components(links)
    rooted = nodes.join(roots.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").withColumn("root", F.coalesce("root", "id"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))  # the root itself, unless texts share a doc_id
    classes = cut(rooted.join(least, "root").select("h1", "h2", "class_id", "n"))
    found = join_few(known.select("doc_id", "text_hash", "h1", "h2"), classes, ["h1", "h2"], ["doc_id"]).select("doc_id", "text_hash", "class_id")
    return found.union(signed.filter("h1 IS NULL").select("doc_id", "text_hash", F.col("doc_id").alias("class_id")))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group: that with the least doc_id; of several rows with it, that whose text has the least xxhash64,
    then the least row. Rows without doc_id stay."""
    found = cut(near_duplicate_classes(docs, similarity).filter("doc_id IS NOT NULL"))
    own = found.filter("doc_id = class_id").groupBy("doc_id").agg(F.min("text_hash").alias("least"), F.count(F.lit(1)).alias("n"))
    several = cut(own.filter("n > 1").select(F.col("doc_id").alias("of"), "least"))
    gone = found.filter("doc_id <> class_id").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))  # whatever columns docs has
    kept = rows.join(gone, ["id", "hash"], "left_anti")
    if several.isEmpty():
        return kept.select("row.*")
    again = kept.join(several, F.col("id") == F.col("of"), "left")
    one = again.filter(F.col("hash") == F.col("least")).groupBy("of").agg(F.min("row").alias("row")).select("row.*")
    return again.filter(F.col("of").isNull()).select("row.*").union(one)


def op2_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, class_id, duplicate (another document of its group stays)."""
    return near_duplicate_classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id").withColumn("duplicate", F.coalesce(F.col("doc_id") != F.col("class_id"), F.lit(False)))


#: DuckDB SQL for op2_dartminhash: every pair of documents that share a shingle, then everything that links reach.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d) GROUP BY ALL),
n AS (SELECT doc_id, sum(c) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS m FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE m >= 0.8 * (x.n + y.n - m)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT id AS doc_id, min(root) AS class_id, min(root) <> id AS duplicate FROM r GROUP BY id
"""
