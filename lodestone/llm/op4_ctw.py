"""Language-model scoring by context-tree weighting (Willems, Shtarkov and Tjalkens, 1995).

A text is the bytes of its words in lower case, a blank behind each, then a line end. Each byte is eight binary
decisions; each decision has a context tree over the bytes before, of depth DEPTH. A node holds how often its
decision went either way in the training texts, and predicts by the Krichevsky-Trofimov estimate; context-tree
weighting mixes the estimates of all depths with the weights that the counts give. A context that training has not met
is an empty subtree, which predicts 1/2. The code length of a text is the sum over its decisions.

Counts of all (DEPTH + 1)-grams of the training texts are added up by Spark; a node at any depth is a sum over them.
Every node counts. Up to MOST_GRAMS grams, the executors get the whole tree; beyond, they get the probabilities of the
grams that occur most, and what texts hold of others is joined with the tree, which stays in the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read, utf8_slices, worker_for
from .op8_language import held_out

DEPTH = 5
#: Grams whose probabilities (and, if these are all, whose nodes) the executors hold: with nodes and table, up to about 450 MB in a worker; 100 MB for the test tables.
MOST_GRAMS = 1 << 21
#: Words whose counts the executors hold; rows of other words are joined with their counts.
MOST_WORDS = 1 << 18
#: n-grams and bytes that a task handles at a time.
HELD = 500_000
PIECE = 1 << 18
END = b"\n"
SMOOTHING = 0.1


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII white-space characters


def stream(words: list[bytes]) -> bytes:
    return b" ".join([*words, END])


def rolled(codes: np.ndarray, depth: int) -> np.ndarray:
    """The runs of depth + 1 bytes as numbers, the last byte lowest."""
    key = codes[: len(codes) - depth].astype(np.uint64)
    for i in range(1, depth + 1):
        key = (key << np.uint64(8)) | codes[i : len(codes) - depth + i]
    return key


def pieces(streams: list[bytes], depth: int):
    """(number of the stream, bytes with `depth` bytes of context in front), each of at most PIECE bytes."""
    for i, s in enumerate(streams):
        s = END * depth + s
        for at in range(0, len(s) - depth, PIECE):
            yield i, s[at : at + PIECE + depth]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    all_keys = np.concatenate(keys)
    if counts is None:
        found, n = np.unique(all_keys, return_counts=True)
        return found, n.astype(np.int64)
    found, at = np.unique(all_keys, return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def gram_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, n) of all runs of depth + 1 bytes in the streams of docs (text)."""

    def count(batches):
        import pyarrow as pa

        worker_for("op4")
        waiting, size, held = [], 0, []
        for batch in batches:
            for _, texts in utf8_slices(batch):
                for _, piece in pieces([stream(words_of(t)) for t in texts], depth):
                    waiting.append(rolled(np.frombuffer(piece, np.uint8), depth))
                    size += len(waiting[-1])
                    if size > HELD:
                        held.append(_summed(waiting))
                        waiting, size = [], 0
                        if sum(len(k) for k, _ in held) > 3 * HELD:
                            held = [_summed([k for k, _ in held], [n for _, n in held])]
                            if len(held[0][0]) > 2 * HELD:
                                yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["gram", "n"])
                                held = []
        if waiting:
            held.append(_summed(waiting))
        if held:
            keys, n = _summed([k for k, _ in held], [n for _, n in held])
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000].view(np.int64)), pa.array(n[at : at + 100_000])], names=["gram", "n"])

    return docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (n) from the least power of two on that leaves at most `most` of them; all, if they are few enough."""
    sizes = {r["b"]: r["k"] for r in counts.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()}  # 63 at most
    total, least = sum(sizes.values()), 0
    while total > most:
        total -= sizes.get(least, 0)
        least += 1
    return counts.filter(F.col("n") >= (1 << least))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after a shift to 10 and more."""
    shift = np.zeros_like(x)
    for _ in range(10):
        small = x < 10
        shift = shift + np.where(small, np.log(np.maximum(x, 1e-300)), 0)
        x = np.where(small, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a sequence with these counts: Stirling's formula with the large terms
    of the three gamma functions taken together, so that it is as exact for counts of 10^12 as for small ones."""
    zeros, ones = zeros.astype(float), ones.astype(float)
    n = zeros + ones + 1
    share = lambda x, y: x * np.where(x > y, np.log1p(-(y + 0.5) / n), np.log((x + 0.5) / n))
    large = share(zeros, ones) + share(ones, zeros) - 0.5 * np.log(n) + 0.5 * math.log(2 * math.pi)
    return large + stirling_rest(zeros + 0.5) + stirling_rest(ones + 0.5) - stirling_rest(n) - math.log(math.pi)


def stirling_rest(x: np.ndarray) -> np.ndarray:
    """What log gamma is more than the first terms of Stirling's series."""
    some = np.maximum(x, 10)
    series = 1 / (12 * some) - 1 / (360 * some**3) + 1 / (1260 * some**5)
    few = np.minimum(x, 10)
    return np.where(x < 10, log_gamma(few) - ((few - 0.5) * np.log(few) - few + 0.5 * math.log(2 * math.pi)), series)


def shares(kt: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weights of a node's own estimate and of its children, which add up to 1."""
    return np.exp(-np.logaddexp(0, below - kt)), np.exp(-np.logaddexp(0, kt - below))


def log10_of(odds: np.ndarray, one: np.ndarray) -> np.ndarray:
    """log10 of the probability of a decision, from the logarithm of the odds of its going one way: exact for both, however
    close to 1 one of them is."""
    out = np.empty(len(odds))
    for at in range(0, len(odds), PIECE):  # little at a time besides the result
        part = slice(at, at + PIECE)
        out[part] = -np.logaddexp(0, np.where(one[part], -odds[part], odds[part]).astype(float)) / math.log(10)
    return out


def weighted_levels(grams: list[tuple[np.ndarray, np.ndarray]], bit: int, lowest: int = 0) -> list[dict]:
    """A bit's nodes at each depth from `lowest`, sorted: counts, estimates, weighted probabilities, weights and the places of
    their parents. grams: for each depth from `lowest`, sorted (depth + 1)-grams and their counts."""
    levels = []
    for keys, n in grams:
        node = (keys >> np.uint64(8) << np.uint64(8)) | (np.uint64(1 << bit) | ((keys & np.uint64(255)) >> np.uint64(8 - bit)))
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        one = (keys >> np.uint64(7 - bit)) & np.uint64(1) == 1
        total, ones = (np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64) for x in (n, np.where(one, n, 0)))
        levels.append({"key": node[first], "first": first, "one": one, "n1": ones, "n0": total - ones})
    for i in range(len(levels) - 1, -1, -1):  # weights, from the leaves
        v = levels[i]
        v["kt"] = log_kt(v["n0"], v["n1"])
        if i == len(levels) - 1:
            v["weight"], v["rest"], v["log_p"] = np.ones(len(v["key"])), np.zeros(len(v["key"])), v["kt"]
            continue
        c = levels[i + 1]
        suffix = c["key"] & np.uint64((1 << (8 * (lowest + i + 1))) - 1)  # the oldest byte goes
        at = np.searchsorted(v["key"], suffix) if len(v["key"]) else np.zeros(0, np.int64)
        c["parent"] = at
        below = np.bincount(at, c["log_p"], len(v["key"]))  # every decision of a node is one of a child's
        v["log_p"] = np.logaddexp(v["kt"], below) - math.log(2)
        v["weight"], v["rest"] = shares(v["kt"], below)
    return levels


def mixtures(v: dict, above: tuple[np.ndarray, ...]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Predictions of a level's nodes, as logarithms of the odds of a one, for contexts that go on with no node below (an empty
    subtree predicts 1/2; leaves have none, their weight is 1), and what their children mix from: what both ways have so
    far, and the share that is left. above: the same of their parents."""
    n = v["n0"] + v["n1"] + 1.0
    zero, one, left = above
    zero, one = (x + left * v["weight"] * (k + 0.5) / n for x, k in ((zero, v["n0"]), (one, v["n1"])))
    left = left * v["rest"]
    return (np.log(one + left / 2) - np.log(zero + left / 2)).astype(np.float32), (zero, one, left)


def at_root(n: int) -> tuple[np.ndarray, ...]:
    return np.zeros(n), np.zeros(n), np.ones(n)


class Top:
    """The nodes of depths 0 and 1 of all bits: at most 255 and 2^16. From the nodes of depth 1, sorted: counts, and the sum of
    the logarithms of the weighted probabilities of their children."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        root = np.unique(keys & np.uint64(255))
        parent = np.searchsorted(root, keys & np.uint64(255))
        levels = [{"n0": np.bincount(parent, n0, len(root)), "n1": np.bincount(parent, n1, len(root))}, {"n0": n0, "n1": n1}]
        for v in levels[::-1]:
            kt = log_kt(v["n0"], v["n1"])
            log_p = np.logaddexp(kt, below) - math.log(2)
            v["weight"], v["rest"] = shares(kt, below)
            below = np.bincount(parent, log_p, len(root)) if v is levels[1] else None
        stop0, mixed = mixtures(levels[0], at_root(len(root)))
        stop1, self.mixed = mixtures(levels[1], tuple(x[parent] for x in mixed))
        self.keys, self.nodes = keys, [(root, stop0), (keys, stop1)]


class Model:
    """Predictions of the weighted trees. grams: for each depth from 0, sorted (depth + 1)-grams and their counts; with a top,
    for each depth from 2, those of some contexts of two bytes."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], top: Top | None = None):
        lowest = 2 if top else 0
        self.depth = lowest + len(grams) - 1
        #: For each bit and depth the nodes, sorted, and their predictions as logarithms of odds.
        self.nodes: list[list[tuple[np.ndarray, np.ndarray]]] = []
        known = np.zeros(len(grams[-1][0]))  # log10 of the probability of each gram of the greatest length
        for bit in range(8):
            levels = weighted_levels(grams, bit, lowest)
            mixed: tuple[np.ndarray, ...] = ()
            self.nodes.append(list(top.nodes) if top else [])
            for d, v in enumerate(levels):  # mixtures, from the root
                if d:
                    mixed = tuple(x[v["parent"]] for x in mixed)
                elif top:
                    at = np.searchsorted(top.keys, v["key"] & np.uint64(65535))
                    mixed = tuple(x[at] for x in top.mixed)
                else:
                    mixed = at_root(len(v["key"]))
                stop, mixed = mixtures(v, mixed)
                self.nodes[bit].append((v["key"], stop))
                del v["weight"], v["rest"], v["kt"], v["log_p"], v["n0"], v["n1"]
            v = levels[-1]
            if len(known):
                odds = np.repeat(self.nodes[bit][-1][1], np.diff(np.append(v["first"], len(known))))
                known += log10_of(odds, v["one"])
            del levels, v, mixed
        self.grams, self.known = grams[-1][0], known.astype(np.float32)

    def built(self) -> "Model":
        """With a table of the known grams: open addressing, found by 8 * (depth + 1) bits of which a slot holds the rest."""
        if hasattr(self, "slots"):
            return self
        self.bits = max(4, (2 * len(self.grams)).bit_length())
        self.slots = np.full((1 << self.bits) + 64, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(len(self.slots), np.float32)
        todo, at = np.arange(len(self.grams)), self._slot(self.grams)
        while len(todo):
            if at.max() >= len(self.slots):
                raise RuntimeError("the table of n-grams is too full")
            free = self.slots[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.slots[at[free]] = self.grams[todo[free]]  # of several for one slot, the last stays
            there = self.slots[at] == self.grams[todo]
            self.values[at[there]] = self.known[todo[there]]
            todo, at = todo[~there], at[~there] + 1
        return self

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the bytes before it."""
        self.built()
        out = np.zeros(len(keys), np.float64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        empty = np.uint64(0xFFFFFFFFFFFFFFFF)
        unknown = []
        wanted = keys
        while len(todo):
            found = self.slots[at]
            hit = found == wanted
            out[todo[hit]] = self.values[at[hit]]
            gone = found == empty
            if gone.any():
                unknown.append(todo[gone])
            on = ~(hit | gone)
            todo, at, wanted = todo[on], at[on] + 1, wanted[on]
        if unknown:
            unknown = np.concatenate(unknown)
            out[unknown] = self.by_nodes(keys[unknown])
        return out

    def by_nodes(self, keys: np.ndarray) -> np.ndarray:
        """The same, decision by decision, each from the deepest node that training has met, with 1/2 for the empty subtree below."""
        total = np.zeros(len(keys))
        for bit in range(8):
            node = (keys >> np.uint64(8) << np.uint64(8)) | (np.uint64(1 << bit) | ((keys & np.uint64(255)) >> np.uint64(8 - bit)))
            odds = np.zeros(len(keys), np.float32)
            todo = np.arange(len(keys))
            for d in range(self.depth, -1, -1):
                own, stop = self.nodes[bit][d]
                if not len(own) or not len(todo):
                    continue
                want = node[todo] & np.uint64((1 << (8 * (d + 1))) - 1)
                at = np.minimum(np.searchsorted(own, want), len(own) - 1)
                there = own[at] == want
                odds[todo[there]] = stop[at[there]]
                todo = todo[~there]
            one = (keys >> np.uint64(7 - bit)) & np.uint64(1) == 1
            total += log10_of(odds, one)
        return total

    def score(self, streams: list[bytes], missed: list | None = None) -> np.ndarray:
        """log10 of the probability of each stream. missed gets (streams, grams) that the model leaves open; they add nothing."""
        out = np.zeros(len(streams))
        waiting, size = [], 0

        def flush():
            keys = np.concatenate([k for _, k in waiting])
            value = self.log10(keys)
            open_ = np.isnan(value)
            if missed is not None and open_.any():
                missed.append((np.repeat([i for i, _ in waiting], [len(k) for _, k in waiting])[open_], keys[open_]))
                value[open_] = 0
            starts = np.cumsum([0, *[len(k) for _, k in waiting[:-1]]])
            np.add.at(out, [i for i, _ in waiting], np.add.reduceat(value, starts))
            waiting.clear()

        for i, piece in pieces(streams, self.depth):
            waiting.append((i, rolled(np.frombuffer(piece, np.uint8), self.depth)))
            size += len(piece)
            if size > PIECE:
                flush()
                size = 0
        if waiting:
            flush()
        return out


class Frequent(Model):
    """Known probabilities of some grams, from all nodes; others are left open."""

    def __init__(self, grams: np.ndarray, known: np.ndarray, depth: int):
        self.grams, self.known, self.depth = grams, known.astype(np.float32), depth

    def by_nodes(self, keys: np.ndarray) -> np.ndarray:
        return np.full(len(keys), np.nan)


def levels_of(keys: np.ndarray, n: np.ndarray, depth: int, lowest: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth from `lowest`, sorted (depth + 1)-grams and their counts, from distinct ones of the greatest length."""
    order = np.argsort(keys)
    return [*(_summed([keys & np.uint64((1 << (8 * (d + 1))) - 1)], [n]) for d in range(lowest, depth)), (keys[order], n[order])]


def as_keys(table, column: str = "gram") -> np.ndarray:
    return table[column].to_numpy().view(np.uint64) if len(table) else np.zeros(0, np.uint64)  # an absent group has no columns


def as_counts(table) -> np.ndarray:
    return table["n"].to_numpy() if len(table) else np.zeros(0, np.int64)


class Spread:
    """The whole tree of any number of grams. They stay in the shared folder, and are met by the two bytes of context next to
    the byte, dealt to units of about HELD / 4 grams: a task holds one unit's subtrees, from depth 2; only the top is
    broadcast. counts: (gram, n), of n_grams rows."""

    def __init__(self, counts: DataFrame, depth: int, n_grams: int):
        import pyarrow as pa

        def sums(table):
            worker_for("op4")
            found = []
            grams = levels_of(as_keys(table), as_counts(table), depth, 2)
            for bit in range(8):
                v = weighted_levels(grams, bit, 2)[0]
                node, at = np.unique(v["key"] & np.uint64(65535), return_inverse=True)
                found.append((node.view(np.int64), *(np.bincount(at, v[c], len(node)) for c in ("n0", "n1", "log_p"))))
            return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], names=["node", "n0", "n1", "below"])

        self.depth, self.units = depth, n_grams // (HELD // 4) + 4
        self.counts = self._met(counts)
        parts = self.counts.groupBy("unit").applyInArrow(sums, "node long, n0 double, n1 double, below double")
        top = parts.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")]).toArrow()  # at most 2^16 rows
        keys = top["node"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.top = counts.sparkSession.sparkContext.broadcast(Top(keys[order], *(top[c].to_numpy()[order] for c in ("n0", "n1", "below"))))

    def _met(self, grams: DataFrame) -> DataFrame:
        return grams.withColumn("unit", F.pmod(F.xxhash64(F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(65535))), F.lit(self.units)))

    def log10(self, grams: DataFrame) -> DataFrame:
        """(gram, key, log10) of distinct grams (gram); key: the gram as it stands among the words of score_documents()."""
        import pyarrow as pa

        depth, top = self.depth, self.top

        def predict(learnt, wanted):
            worker_for("op4")
            keys = as_keys(wanted, "wanted")
            if len(keys):
                model = Model(levels_of(as_keys(learnt), as_counts(learnt), depth, 2), top.value)
                value = np.concatenate([model.by_nodes(keys[at : at + HELD]) for at in range(0, len(keys), HELD)])
            else:
                value = np.zeros(0)
            return pa.table([pa.array(keys.view(np.int64)), pa.array(gram_words(keys), pa.binary()), pa.array(value)], names=["gram", "key", "log10"])

        met = self._met(grams.select("gram")).select(F.col("gram").alias("wanted"), F.col("unit").alias("unit")).groupBy("unit")  # columns of its own
        return self.counts.groupBy("unit").cogroup(met).applyInArrow(predict, "gram long, key binary, log10 double")


def gram_words(keys: np.ndarray) -> list[bytes]:
    """Names of grams that no word has, for no word holds a blank."""
    return [b" g" + x.to_bytes(8, "big") for x in keys.tolist()]


def missed_grams(docs: DataFrame, model) -> DataFrame:
    """Distinct grams (gram) of the streams of docs (text) that the model (a broadcast one) leaves open."""

    def find(batches):
        import pyarrow as pa

        worker_for("op4")
        trees, waiting, size = model.value.built(), [], 0

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(waiting)).view(np.int64))], names=["gram"])

        for batch in batches:
            for _, texts in utf8_slices(batch):
                missed: list = []
                trees.score([stream(words_of(t)) for t in texts], missed)
                waiting += [np.unique(keys) for _, keys in missed]
                size += sum(len(keys) for _, keys in missed)
                if size > 3 * HELD:
                    yield from flush()
                    waiting, size = [], 0
        if waiting:
            yield from flush()

    return docs.select("text").mapInArrow(find, "gram long").distinct()


def fit(docs: DataFrame, depth: int = DEPTH, most: int | None = None) -> tuple[Model, Spread | None]:
    """The model of all texts of docs (text). Without any row every decision has probability one half.

    With more than `most` grams, the tree that has the rest too, and of the model only the most frequent grams' probabilities in it.
    """
    from .common import cut

    most = most or MOST_GRAMS
    counts = cut(gram_counts(docs, depth))
    n_grams = counts.count()
    if depth < 2 or n_grams <= most:  # 2^16 grams below depth 2
        table = counts.select("gram", "n").toArrow()
        return Model(levels_of(as_keys(table), as_counts(table), depth)), None
    tree = Spread(counts, depth, n_grams)
    table = tree.log10(most_frequent(counts, most)).select("gram", "log10").toArrow()  # at most `most` rows
    return Frequent(as_keys(table), table["log10"].to_numpy(), depth), tree


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over the words of docs (text), lower case."""

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        worker_for("op4")
        held: Counter = Counter()

        def flush():
            words = list(held)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([held[w] for w in part], pa.int64())], names=["word", "n"])
            held.clear()

        for batch in batches:
            for _, texts in utf8_slices(batch):
                for text in texts:
                    held.update(words_of(text))
                if len(held) > 150_000:
                    yield from flush()
        yield from flush()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def score_documents(docs: DataFrame, train: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Each row of docs (doc_id, held_out, text) with its counts, its unigram score and its score by the weighted trees.

    train (text): what the models learn from. Null text: empty, the end alone. Repeated rows are scored apart.
    """
    from .common import cut

    spark = docs.sparkSession
    trees, tree = fit(train, depth)
    model = spark.sparkContext.broadcast(trees)
    del trees
    words = cut(word_counts(train))
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = train.count()
    n_train, distinct = (total["n"] or 0) + ends, total["v"] + (1 if ends else 0)
    below = n_train + SMOOTHING * (distinct + 1)
    frequent = most_frequent(words, MOST_WORDS)
    table = frequent.select("word", "n").toArrow()  # at most MOST_WORDS rows
    n = table["n"].to_numpy()
    least = int(n.min()) if len(n) else 0
    whole = len(n) == total["v"]  # then other words are unknown
    log_of = spark.sparkContext.broadcast(dict(zip(table["word"].to_pylist(), np.log10((n + SMOOTHING) / below).tolist())))
    del table, n
    end_log = math.log10((ends + SMOOTHING) / below)
    unseen_log = math.log10(SMOOTHING / below)

    def score(batches):
        from collections import Counter

        import pyarrow as pa
        from pyspark import TaskContext

        worker_for("op4")
        known, trees = log_of.value, model.value.built()
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, texts in utf8_slices(batch):
                split = [words_of(t) for t in texts]
                streams = [stream(w) for w in split]
                missed: list = []
                scores = trees.score(streams, missed)
                of, grams = (np.concatenate(x) for x in zip(*missed)) if missed else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                edges = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
                rows: list[tuple] = []
                ids = batch.column("doc_id").slice(at, len(texts)).to_pylist()
                held = batch.column("held_out").slice(at, len(texts)).to_pylist()
                for i, (doc_id, out, own, s, bits) in enumerate(zip(ids, held, split, streams, scores.tolist())):
                    logs = list(map(known.get, own))
                    tail = Counter(w for w, x in zip(own, logs) if x is None)
                    n_known, base = len(own) - tail.total() + (ends > 0), math.fsum(x for x in logs if x is not None) + end_log
                    if whole:
                        base += unseen_log * tail.total()
                    # the row of the document itself matches no word, for no word holds a blank
                    rows.append((uid, b" %d" % uid, None, doc_id, out, len(own) + 1, n_known, base, bits, len(s)))
                    if not whole:
                        rows.extend((uid, w, n, None, None, None, None, None, None, None) for w, n in tail.items())
                    if edges[i] < edges[i + 1]:
                        some, times = np.unique(grams[edges[i] : edges[i + 1]], return_counts=True)
                        rows.extend((uid, w, n, None, None, None, None, None, None, None) for w, n in zip(gram_words(some), times.tolist()))
                    uid += 1
                if rows:
                    kinds = (pa.int64(), pa.binary(), pa.int64(), batch.schema.field("doc_id").type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["uid", "word", "times", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "size"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "held_out", "text").mapInArrow(score, f"uid long, word binary, times long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double, size long")
    if not whole or tree:
        rare = words.filter(F.col("n") < least).select(F.col("word").alias("_word"), F.col("n").alias("_n"), F.lit(None).cast("double").alias("_log"))
        if tree:
            grams = tree.log10(missed_grams(docs, model))
            rare = rare.union(grams.select("key", F.lit(None).cast("long"), "log10"))
        joined = rows.join(rare, F.col("word") == F.col("_word"), "left")
        log = F.when(F.col("_log").isNull(), F.log10((F.coalesce("_n", F.lit(0)) + F.lit(SMOOTHING)) / F.lit(below)))
        first = [F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens", "size")]
        rows = joined.groupBy("uid").agg(
            *first,
            (F.max("n_known") + F.coalesce(F.sum(F.when(F.col("_n") > 0, F.col("times"))), F.lit(0))).alias("n_known"),
            (F.max("base_score") + F.coalesce(F.sum(F.col("times") * log), F.lit(0.0))).alias("base_score"),
            (F.max("score") + F.coalesce(F.sum(F.col("times") * F.col("_log")), F.lit(0.0))).alias("score"),
        )
    bits = -F.col("score") / F.lit(math.log10(2)) / F.col("size")
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; those that are not held out are learnt from."""
    docs = read(spark, sf_dir, "documents").select("doc_id", held_out(10).alias("held_out"), "text")
    return score_documents(docs, docs.filter("NOT held_out").select("text"))
