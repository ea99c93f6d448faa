"""Personal data by a semi-Markov conditional random field (Sarawagi and Cohen, 2004) over base patterns.

Base spans come from fixed patterns. The field looks at islands of tokens around digits, `@` and their spelled-out
forms. Candidate segments are runs of at most MAX_TOKENS tokens that some kind of data may be: an address has an at
and a dot, an ip four parts of at most 255, a card 16 to 19 digits that pass the check sum, a phone 7 to 15 digits.
Other labels have no weight, so no segment gets one. Whole-span features (shape, number of digits, separators,
neighbours) give each (segment, kind) a score, tokens outside have score 0, and dynamic programming over segment ends
chooses boundaries and kinds together. Spans it finds beside the base ones are added.

The weights are fitted here, by the likelihood's gradient (forward and backward sums over segmentations), on a bounded
sample of islands: their base spans are the labels, and for each island two more copies are learnt: a rewritten one,
in which its spans are written in another way (spaces around marks, spelled-out marks, no plus sign, other
separators), and a broken one, in which they are spoilt (a part of 256 and more, a wrong check digit, too few digits,
no domain) and so are no data any more.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import cut, read, utf8_slices, with_texts, worker_for

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS = 40
#: The fit reads so many islands at most, those with the least hashes, and for each kind at most so many that have it.
TRAINING_ISLANDS = 240
TRAINING_OF_KIND = 30
#: Tokens around a trigger that belong to its island, and characters of an island of the training sample.
AROUND, ISLAND_CHARS = 4, 600

# Base patterns of the contract.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start. Linear in the text."""
    found: list[tuple[str, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        number = digits(m.group())
        if 16 <= len(number) <= 19 and luhn(number):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(digits(m.group())) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


# The field.
_TOKEN = re.compile(r"\[\s?(?:at|dot)\s?\]|\(\s?(?:at|dot)\s?\)|[^\W_]+|[^\s]", re.ASCII)  # a bracketed at or dot is one mark
_TRIGGER = re.compile(r"[0-9@]|[\[(]\s*at\s*[\])]")
_SEPARATORS = frozenset(" ().-+/\u00a0")
_DOT, _AT_SIGN = r"(?:\.|[\[(]\s?dot\s?[\])])", r"(?:@|[\[(]\s?at\s?[\])])"
_DOT_MARK, _AT_MARK = re.compile(_DOT), re.compile(_AT_SIGN)
_BETWEEN = rf"(?:{_DOT}|\s{_DOT}\s)"  # a dot with a space behind only ends a sentence
_EMAIL_SHAPE = re.compile(rf"[A-Za-z0-9_%+-]+(?:{_BETWEEN}[A-Za-z0-9_%+-]+)*\s?{_AT_SIGN}\s?[A-Za-z0-9-]+(?:{_BETWEEN}[A-Za-z0-9-]+)+")
_ON_RIGHT, _ON_LEFT = re.compile(rf"{_BETWEEN}[A-Za-z0-9-]"), re.compile(rf"[A-Za-z0-9_%+-]{_BETWEEN}$")
_IP_SHAPE = re.compile(rf"[0-9]{{1,3}}(?:{_BETWEEN}[0-9]{{1,3}}){{3}}")
_GROUPS_OF_4 = re.compile(r"[0-9]{4}([ .-]{1,3}[0-9]{4}){3}")
_PHONE_SHAPE = re.compile(r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-]{1,2}[0-9]{3,4}")


def islands(text: str) -> list[tuple[int, int]]:
    """(start, end) of the stretches around triggers, cut at token ends; apart from each other. Every trigger has its own
    AROUND words on both sides. Linear in the text."""
    found: list[tuple[int, int]] = []
    word_end = -1  # of the last trigger's word
    for m in _TRIGGER.finditer(text):
        if m.end() < word_end:  # the words to the right are those of a trigger before
            continue
        start, end = m.start(), m.end()
        for i in range(AROUND):  # words to the right
            space = text.find(" ", end + 1, end + 60)
            end = space if space >= 0 else min(len(text), end + 60)
            if i == 0:
                word_end = space
        if found and start < found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]))
            continue
        for _ in range(AROUND):  # and to the left
            start = max(text.rfind(" ", max(0, start - 60), max(0, start - 1)) + 1, start - 60, 0)
        if found and start <= found[-1][1]:
            found[-1] = (found[-1][0], max(end, found[-1][1]))
        else:
            found.append((start, end))
    return found


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


FEATURES = (
    "any", "shape email", "shape ip", "shape phone", "groups of four", "digits 7-9", "digits 10-11", "digits 12-15", "digits 16-19",
    "only digits and separators", "letters and digits only", "plus in front",
    "glued left", "glued right", "odd first mark", "odd last mark", "spaces over 3", "long digits in one run", "goes on right", "goes on left",
)
_AT = {name: i for i, name in enumerate(FEATURES)}


def features(text: str, start: int, end: int) -> list[int]:
    """Numbers of the whole-span features that hold for a segment."""
    s = text[start:end]
    number = digits(s)
    n = len(number)
    on = ["any"]
    if _EMAIL_SHAPE.fullmatch(s):
        on.append("shape email")
    elif _IP_SHAPE.fullmatch(s):
        on.append("shape ip")
    elif _GROUPS_OF_4.fullmatch(s):
        on.append("groups of four")
    elif _PHONE_SHAPE.fullmatch(s):
        on.append("shape phone")
    if n >= 7:
        on.append("digits 7-9" if n < 10 else "digits 10-11" if n < 12 else "digits 12-15" if n < 16 else "digits 16-19" if n < 20 else "any")
    if all(c in _SEPARATORS or "0" <= c <= "9" for c in s):
        on.append("only digits and separators")
    elif s.isalnum():
        on.append("letters and digits only")
    if s[0] == "+":
        on.append("plus in front")
    before, after = text[start - 1 : start], text[end : end + 2]
    if before and (before.isalnum() or before in "@.+-_=\"'/"):
        on.append("glued left")
    if after and (after[0].isalnum() or after[0] in "@_=\"'/" or after[0] in ".-" and after[1:].isalnum()):
        on.append("glued right")
    if not (s[0].isalnum() or s[0] in "+("):
        on.append("odd first mark")
    if not s[-1].isalnum():
        on.append("odd last mark")
    if s.count(" ") > 3:
        on.append("spaces over 3")
    if n == len(s) and n > 4:
        on.append("long digits in one run")
    if _ON_RIGHT.match(text, end):
        on.append("goes on right")
    if _ON_LEFT.search(text, max(0, start - 9), start):
        on.append("goes on left")
    return list(dict.fromkeys(_AT[x] for x in on))


def kinds_of(s: str, numeric: bool, email: bool) -> list[int]:
    """Numbers of the kinds that a segment may be; numeric: of digits and separators only, email: with one at mark."""
    if email:
        return [KINDS.index("email")] if _EMAIL_SHAPE.fullmatch(s) else []
    if not numeric:
        return []
    number, out = digits(s), []
    n = len(number)
    if 4 <= n <= 12 and _IP_SHAPE.fullmatch(s) and all(int(p) <= 255 for p in re.findall("[0-9]+", s)):
        out.append(KINDS.index("ip"))
    if 16 <= n <= 19 and luhn(number) and all(c in _SEPARATORS or "0" <= c <= "9" for c in s):
        out.append(KINDS.index("card"))
    if 7 <= n <= 15 and all(c in _SEPARATORS or "0" <= c <= "9" for c in s):
        out.append(KINDS.index("phone"))
    return out


Segment = tuple[int, int, list[int], list[int]]


def candidates(text: str, span: tuple[int, int], most: int = MAX_TOKENS) -> tuple[list[tuple[int, int]], list[Segment]]:
    """Tokens of an island, and its candidate segments (first token, end token, features, kinds): runs of at most `most` tokens
    that some kind allows."""
    toks = tokens(text, *span)
    at_mark, word, numeric, local = [], [], [], []
    for a, b in toks:
        t = text[a:b]
        at, dot = bool(_AT_MARK.fullmatch(t)), bool(_DOT_MARK.fullmatch(t))
        at_mark.append(at)
        word.append(t.isalnum())
        numeric.append(dot or t in _SEPARATORS or t.isascii() and t.isdigit())
        local.append(at or dot or t in "_%+-" or t.isascii() and t.isalnum())
    out = []
    for i in range(len(toks)):
        first = text[toks[i][0]]
        if not (first.isalnum() or first in "+(") or toks[i][0] and text[toks[i][0] - 1].isalnum() and text[toks[i][0] - 1].isascii():
            continue
        number, address, ats = True, True, 0
        for j in range(i, min(len(toks), i + most)):
            gap = toks[j][0] - toks[j - 1][1] if j > i else 0
            number &= numeric[j]
            address &= local[j] and not (gap and word[j] and word[j - 1])
            ats += at_mark[j]
            if gap > 2 or ats > 1 or not (number or address):
                break
            if (number or ats) and text[toks[j][1] - 1].isalnum() and (kinds := kinds_of(text[toks[i][0] : toks[j][1]], number, address and ats == 1)):
                out.append((i, j + 1, features(text, toks[i][0], toks[j][1]), kinds))
    return toks, out


class Field:
    """Weights by kind and feature."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((len(KINDS), len(FEATURES))) if weights is None else weights

    def decode(self, text: str, span: tuple[int, int]) -> list[tuple[str, int, int]]:
        """The best segmentation's spans."""
        toks, segments = candidates(text, span)
        by_end: dict[int, list] = {}
        for i, j, on, kinds in segments:
            score, k = max((float(self.weights[k, on].sum()), -k) for k in kinds)
            if score > 0:  # else outside is as good
                by_end.setdefault(j, []).append((i, score, -k))
        best, back = [0.0] * (len(toks) + 1), [None] * (len(toks) + 1)
        for j in range(1, len(toks) + 1):
            best[j] = best[j - 1]
            for i, score, k in by_end.get(j, ()):
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, k)
        found, j = [], len(toks)
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                found.append((KINDS[k], toks[i][0], toks[j - 1][1]))
                j = i
        return found[::-1]


def fit(examples: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = 60, rate: float = 0.5, decay: float = 0.002) -> Field:
    """Weights by gradient ascent on the penalised mean log-likelihood of the examples' segmentations."""
    data = []
    for text, spans in examples:
        toks, segments = candidates(text, (0, len(text)))
        if not segments:
            continue
        f = np.zeros((len(segments), len(FEATURES)))
        barred = np.full((len(segments), len(KINDS)), -np.inf)
        for r, (_, _, on, kinds) in enumerate(segments):
            f[r, on] = 1
            barred[r, kinds] = 0
        place = {(toks[i][0], toks[j - 1][1]): r for r, (i, j, _, _) in enumerate(segments)}
        gold = np.zeros((len(segments), len(KINDS)))
        end = 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):  # spans that overlap the one before cannot both be labels
            if a >= end and (r := place.get((a, b))) is not None and barred[r, KINDS.index(kind)] == 0:
                gold[r, KINDS.index(kind)] = 1
                end = b
        data.append((len(toks), [(i, j) for i, j, _, _ in segments], f, barred, gold.T @ f))
    field = Field()
    if not data:
        return field
    speed = np.full_like(field.weights, 1e-8)
    for _ in range(rounds):
        gradient = -decay * len(data) * field.weights
        for n, ends, f, barred, gold in data:
            score = f @ field.weights.T + barred
            total = np.logaddexp.reduce(score, axis=1).tolist()
            forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
            by_end: dict[int, list[int]] = {}
            by_start: dict[int, list[int]] = {}
            for r, (i, j) in enumerate(ends):
                by_end.setdefault(j, []).append(r)
                by_start.setdefault(i, []).append(r)
            for j in range(1, n + 1):
                parts = [forward[j - 1], *(forward[ends[r][0]] + total[r] for r in by_end.get(j, ()))]
                top = max(parts)
                forward[j] = top + math.log(sum(math.exp(p - top) for p in parts)) if len(parts) > 1 else top
            for i in range(n - 1, -1, -1):
                parts = [backward[i + 1], *(backward[ends[r][1]] + total[r] for r in by_start.get(i, ()))]
                top = max(parts)
                backward[i] = top + math.log(sum(math.exp(p - top) for p in parts)) if len(parts) > 1 else top
            outer = np.array([forward[i] + backward[j] - forward[n] for i, j in ends])
            gradient += gold - np.exp(score + outer[:, None]).T @ f
        gradient /= len(data)
        speed += gradient**2
        field.weights = field.weights + rate * gradient / np.sqrt(speed)
    return field


#: Ways to write the marks of an address, and of an ip.
AT_FORMS = (" @ ", " (at) ", "[at]", " [at] ", "(at)")
DOT_FORMS = (".", ".", " (dot) ", "[dot]", " [dot] ", "(dot)")


def replaced(text: str, spans: list[tuple[str, int, int]], write) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with each span written as write(kind, span) says, and where they are; of spans that overlap, the first."""
    out, moved, at = "", [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            s = write(kind, text[a:b])
            out += text[at:a]
            moved.append((kind, len(out), len(out) + len(s)))
            out += s
            at = b
    return out + text[at:], moved


def rewritten(text: str, spans: list[tuple[str, int, int]], rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its spans written in another way, and where they are."""

    def write(kind: str, s: str) -> str:
        if kind == "email":
            return s.replace("@", rng.choice(AT_FORMS)).replace(".", rng.choice(DOT_FORMS))
        if kind == "phone":
            bare = s.replace("(", "").replace(")", "")
            return rng.choice([s.lstrip("+"), bare.replace(" ", "-"), bare.replace(" ", ".").replace("-", "."), bare.lstrip("+"), s])
        if kind == "card":
            d = digits(s)
            return rng.choice([" ", "-", ".", "  "]).join(d[i : i + 4] for i in range(0, len(d), 4))
        return s.replace(".", rng.choice([" . ", *DOT_FORMS]))

    return replaced(text, spans, write)


def broken(text: str, spans: list[tuple[str, int, int]], rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with its spans spoilt, and the base spans that it has then."""

    def write(kind: str, s: str) -> str:
        if kind == "email":
            return s[: s.index("@") + 1] if rng.random() < 0.5 else s.replace("@", " ")
        if kind == "phone":
            return digits(s)[:6]
        if kind == "card":
            return s[:-1] + str((int(s[-1]) + rng.randrange(1, 9)) % 10)
        return s[: s.rindex(".") + 1] + str(rng.randrange(256, 1000))

    out, _ = replaced(text, spans, write)
    return out, base_spans(out)


def sample_islands(docs: DataFrame, most: int = TRAINING_ISLANDS, most_of_kind: int = TRAINING_OF_KIND) -> list[str]:
    """The `most` islands of docs (text) with the least hashes among all distinct ones, and for each kind the `most_of_kind`
    with the least hashes among those with a base span of that kind. Neither copies nor partitions change them."""
    bound = {"": most, **dict.fromkeys(KINDS, most_of_kind)}

    def sample(batches):
        import pyarrow as pa

        worker_for("op7")
        kept: dict[str, dict[str, str]] = {kind: {} for kind in bound}
        for batch in batches:
            for _, texts in utf8_slices(batch):
                for raw in texts:
                    text = (raw or b"").decode()
                    for a, b in islands(text):
                        s = text[a : min(b, a + ISLAND_CHARS)]
                        h = hashlib.md5(s.encode()).hexdigest()
                        for kind in {"", *(k for k, _, _ in base_spans(s))}:
                            kept[kind][h] = s
                for kind, own in kept.items():
                    if len(own) > 20 * bound[kind]:
                        kept[kind] = dict(sorted(own.items())[: bound[kind]])
        rows = [(kind, h, s) for kind, own in kept.items() for h, s in sorted(own.items())[: bound[kind]]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["kind", "h", "island"])

    found = docs.select("text").mapInArrow(sample, "kind string, h string, island string")
    distinct = cut(found.groupBy("kind", "h").agg(F.min("island").alias("island")))  # copies first, then the bound
    rows = [r["island"] for kind, n in sorted(bound.items()) for r in distinct.filter(F.col("kind") == kind).orderBy("h").limit(n).select("h", "island").collect()]
    return list(dict.fromkeys(rows))


def fit_field(docs: DataFrame, most: int = TRAINING_ISLANDS) -> Field:
    """A field fitted on the sample_islands() of docs (text)."""
    texts = sample_islands(docs, most)
    rng, examples = random.Random(7), []
    for s in texts:
        spans = base_spans(s)
        examples.append((s, spans))
        if spans:
            examples += [rewritten(s, spans, rng), broken(s, spans, rng)]
    return fit(examples)


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field) -> list[tuple[str, int, int]]:
    """Base spans and those of the field that touch none of them, by kind, then start."""
    if "@" not in text and not _DIGIT.search(text) and not _TRIGGER.search(text):
        return base
    taken = sorted((a, b) for _, a, b in base)
    more = []
    for span in islands(text):
        for kind, a, b in field.decode(text, span):
            if all(b <= x or a >= y for x, y in taken):
                more.append((kind, a, b))
    return sorted([*base, *more], key=lambda s: (KINDS.index(s[0]), s[1])) if more else base


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; spans that overlap are replaced together, as the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])


def find_personal_data(docs: DataFrame, keep: list[str], field: Field) -> DataFrame:
    """The columns keep of docs (which has a column text) with personal_data: its spans by kind, then start, in code points, end
    exclusive; base: whether a base pattern found it. Null text: as empty, no spans."""
    weights = docs.sparkSession.sparkContext.broadcast(field.weights)
    docs = docs.select(*dict.fromkeys([*keep, "text"]))

    def find(batches):
        import pyarrow as pa

        worker_for("op7")
        model = Field(weights.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            found = []
            for _, texts in utf8_slices(batch):
                for raw in texts:
                    text = (raw or b"").decode()
                    base = base_spans(text)
                    own = set(base)
                    found.append([{"kind": k, "start": x, "end": y, "base": (k, x, y) in own} for k, x, y in added_spans(text, base, model)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(found, kind)], names=[*keep, "personal_data"])

    fields = [docs.schema[c] for c in keep]
    return docs.mapInArrow(find, T.StructType([*fields, T.StructField("personal_data", T.ArrayType(SPAN))]))


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs (text and any other columns) with personal data replaced by its kind, and n_chars, if there is such a column, by the
    new number of characters. Null texts stay null."""
    field = docs.sparkSession.sparkContext.broadcast(fit_field(docs).weights)

    def clean(batches):
        worker_for("op7")
        model = Field(field.value)
        for batch in batches:
            for at, part in utf8_slices(batch):
                new = {}
                for i, raw in enumerate(part):
                    text = (raw or b"").decode()
                    spans = added_spans(text, base_spans(text), model) if text else []
                    if spans:
                        new[i] = redact(text, spans)
                yield with_texts(batch.slice(at, len(part)), new)

    return docs.mapInArrow(clean, docs.schema)


def op7_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added). Null text: empty."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs, ["doc_id"], fit_field(docs))
    spans = F.col("personal_data")
    base = F.filter(spans, lambda x: x["base"])
    text = lambda some: F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda kind: F.filter(base, lambda x: x["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(spans).alias("spans"))
