"""Statements whose plan would not grow with the data, rewritten: NOT IN a subquery, ON conditions joined by OR, windows without
a partition.

Spark plans NOT IN as a null-aware anti join, which broadcasts the subquery whatever its size, a join condition with OR as a
nested loop, and a window without a partition in one task. A rewritten text is used only if Spark gives it the same schema as
the first one; else the first one stays. Where a statement only counts the pairs of a join with OR, no pair is made.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import joins, ranking
from .dialect import KEYWORDS, SET_OPERATORS, Token, _clause_span, _closing, _items, _levels, _next, _operand, _select_list, _split, _text, tokenize

_JOINS = ("JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "OUTER", "SEMI", "ANTI")


def _schema(spark: SparkSession, sql: str) -> list[tuple[str, str]] | None:
    try:
        return [(f.name, f.dataType.simpleString()) for f in spark.sql(sql).schema.fields]
    except PySparkException:
        return None


def rewritten(spark: SparkSession, sql: str) -> str:
    """sql with its NOT IN and OR joins rewritten, as far as that leaves its result the same."""
    for step in (_without_not_in, _without_or_joins):
        try:
            new = step(spark, sql)
        except (IndexError, ValueError):  # a form that is not known here
            continue
        if new != sql and (old := _schema(spark, sql)) is not None and _schema(spark, new) == old:
            sql = new
    return sql


def run(spark: SparkSession, sql: str) -> DataFrame:
    """The result of sql; what can be rewritten is."""
    try:
        counted = _without_pairs(spark, sql)
    except (IndexError, ValueError, PySparkException):
        counted = None
    if counted is not None:
        return counted
    text = rewritten(spark, sql)
    try:
        placed = _without_gathering(spark, text)
    except (IndexError, ValueError, PySparkException):
        placed = None
    return placed if placed is not None else spark.sql(text)


def _parts(sql: str) -> list[Token]:
    return [t for t in tokenize(sql) if not (t.kind == "space" and t.text[0] in "-/")]


# NOT IN


def _conjunct(tokens: list[Token], at: int, start: int, end: int) -> bool:
    """Whether the condition at a place of WHERE must be true for a row to stay: nothing but AND stands beside it."""
    return not any(t.is_word("OR") for i, t, depth in _levels(tokens[start:end]) if depth == 0) and not any(t.is_word("CASE") for t in tokens[start:at])


def _without_not_in(spark: SparkSession, sql: str) -> str:
    tokens = _parts(sql)
    n = 0
    span = _clause_span(tokens, "WHERE")
    if span is None or any(t.is_word(*SET_OPERATORS) for _, t, depth in _levels(tokens) if depth == 0):
        return sql
    i = span[0]
    while (span := _clause_span(tokens, "WHERE")) is not None and i < span[1]:
        following = _next(tokens, i)
        opening = _next(tokens, following) if following is not None else None
        inner = _next(tokens, opening) if opening is not None else None
        depth = next(d for j, _, d in _levels(tokens[span[0] :]) if j == i - span[0])
        if depth == 0 and tokens[i].is_word("NOT") and tokens[following].is_word("IN") and tokens[opening].text == "(" and tokens[inner].is_word("SELECT", "WITH") and _conjunct(tokens, i, *span):
            close = _closing(tokens, opening)
            query = _text(tokens[opening + 1 : close]).strip()
            a, b = _operand(tokens, i, -1)
            x, before = _text(tokens[a:b]).strip(), tokens[_next(tokens, a, -1)]
            alone = before.is_word("WHERE", "AND") and not any(t.text == "," for _, t, d in _levels(tokens[a:b]) if d == 1 and tokens[a].text == "(")
            if alone and len(_schema(spark, query) or ()) == 1:  # it refers to nothing outside
                n += 1
                source = f"({query}) AS _set{n}(_value{n})"
                new = (
                    f"(NOT EXISTS (SELECT 1 FROM {source} WHERE _value{n} = {x}) AND (SELECT count_if(_value{n} IS NULL) FROM {source}) = 0"
                    f" AND ({x} IS NOT NULL OR (SELECT count(*) FROM {source}) = 0))"
                )
                tokens[a : close + 1] = [Token("kept", new)]
                i = a
        i += 1
    return _text(tokens)


# ON with OR


def _alias_of(source: list[Token]) -> str | None:
    own = [t for t in source if t.kind != "space"]
    return own[-1].text.strip("`") if own and own[-1].kind in ("word", "tick") else None


def _or_branches(on: list[Token]) -> list[str]:
    """The parts of a condition between the ORs that no parenthesis encloses; a condition in parentheses is opened."""
    own = [t for t in on if t.kind != "space"]
    while own and own[0].text == "(" and _closing(own, 0) == len(own) - 1:
        on = on[on.index(own[0]) + 1 : len(on) - 1 - next(i for i, t in enumerate(reversed(on)) if t.text == ")")]
        own = own[1:-1]
    parts, last = [], 0
    for i, t, depth in _levels(on):
        if depth == 0 and t.is_word("OR"):
            parts.append(_text(on[last:i]).strip())
            last = i + 1
    return [*parts, _text(on[last:]).strip()]


@dataclass
class _Joins:
    """FROM, at the tokens start to end: tables or subqueries under different names, joined inside by ON. columns: those of each name."""

    start: int
    end: int
    sources: list[str]
    conditions: list[list[Token]]
    names: list[str]
    columns: dict[str, list[str]]


def _inner_joins(spark: SparkSession, tokens: list[Token]) -> _Joins | None:
    span = _clause_span(tokens, "FROM")
    if span is None or any(t.is_word(*SET_OPERATORS) for _, t, depth in _levels(tokens) if depth == 0):
        return None
    start, end = span
    body = tokens[start + 1 : end]
    marks = [i for i, t, depth in _levels(body) if depth == 0 and t.is_word("JOIN")]
    kinds = [t.upper for _, t, depth in _levels(body) if depth == 0 and t.is_word(*_JOINS)]
    if not marks or any(k not in ("JOIN", "INNER") for k in kinds) or any(t.text == "," for _, t, depth in _levels(body) if depth == 0):
        return None
    pieces = [body[a:b] for a, b in zip([0, *[m + 1 for m in marks]], [*marks, len(body)])]
    pieces = [[t for t in p if not t.is_word("INNER")] for p in pieces]
    sources, conditions = [pieces[0]], [[]]
    for p in pieces[1:]:
        on = next((i for i, t, depth in _levels(p) if depth == 0 and t.is_word("ON")), None)
        if on is None:
            return None
        sources.append(p[:on])
        conditions.append(p[on + 1 :])
    names = [_alias_of(s) for s in sources]
    if None in names or len(set(names)) < len(names):
        return None
    texts = [_text(s).strip() for s in sources]
    columns = {n: [c for c, _ in _schema(spark, f"SELECT * FROM {s}") or ()] for n, s in zip(names, texts)}
    return _Joins(start, end, texts, conditions, names, columns) if all(columns.values()) else None


def _without_or_joins(spark: SparkSession, sql: str) -> str:
    """FROM a JOIN b ON x OR y: the rows where x holds, and those where y holds and x does not, each by a join of its own. Both tables
    come out of the union as one struct each, under their names, so that a.c still means the same."""
    tokens = _parts(sql)
    found = _inner_joins(spark, tokens)
    if found is None:
        return sql
    done, known, wrapped = found.sources[0], [found.names[0]], 0
    for source, on, name in zip(found.sources[1:], found.conditions[1:], found.names[1:]):
        branches = _or_branches(on)
        known.append(name)
        own = {n: found.columns[n] for n in known}
        if len(branches) < 2:  # behind a union a column is found under its table's name only
            done += f" JOIN {source} ON {(_qualified(on, own) if wrapped else _text(on)).strip()}"
            continue
        wrapped += 1
        qualified = [_qualified(tokenize(b), own) for b in branches]
        structs = ", ".join(f"struct({n}.*) AS {n}" for n in known)
        parts = []
        for i, b in enumerate(qualified):
            rest = "".join(f" AND NOT coalesce(({x}), false)" for x in qualified[:i])
            parts.append(f"SELECT {structs} FROM {done} JOIN {source} ON ({b}){rest}")
        done = f"({' UNION ALL '.join(parts)}) AS _any{wrapped}"
    if not wrapped:
        return sql
    head, tail = _qualified(tokens[: found.start], found.columns), _qualified(tokens[found.end :], found.columns)
    return f"{head} FROM {done} {tail}"


# Counted pairs of ON with OR

#: Branches of a condition whose pairs are counted: each set of them is a count of its own.
MOST_BRANCHES = 4
_TURNED = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _comparisons(branch: str, left: str, right: str, columns: dict[str, list[str]]) -> set[tuple[str, str, str]] | None:
    """A branch that is nothing but comparisons of a column of left with one of right, joined by AND: (column, sign, column)."""
    tokens = [t for t in tokenize(_qualified(tokenize(branch), columns)) if t.kind != "space"]
    found = set()
    ends = [i for i, t, depth in _levels(tokens) if depth == 0 and t.is_word("AND")]
    for a, b in zip([0, *[i + 1 for i in ends]], [*ends, len(tokens)]):
        own = [t.text.strip("`") for t in tokens[a:b]]
        sign = "".join(own[3:-3])
        if len(own) < 7 or own[1] != "." or own[-2] != "." or sign not in _TURNED:
            return None
        x, y = (own[0], own[2]), (own[-3], own[-1])
        if x[0] == right:
            x, y, sign = y, x, _TURNED[sign]
        if x[0] != left or y[0] != right:
            return None
        found.add((x[1].lower(), sign, y[1].lower()))
    return found


def _without_pairs(spark: SparkSession, sql: str) -> DataFrame | None:
    """The result of SELECT .., count(*) FROM a JOIN b ON x OR y .. where nothing else asks for b: each row of a with the number of its
    partners, by inclusion and exclusion over the branches, and count(*) as the sum of these. None for other statements: other
    aggregates, branches that are more than comparisons of columns, several orders (<) at once."""
    tokens = _parts(sql)
    found = _inner_joins(spark, tokens) if any(t.is_word("OR") for t in tokens) else None
    if found is None:
        return None
    branches = _or_branches(found.conditions[1])
    if not 2 <= len(branches) <= MOST_BRANCHES:
        return None
    outside: list[list[Token]] = []
    counts = 0
    for part in (tokens[: found.start], tokens[found.end :]):
        part = list(part)
        for i in reversed([i for i, t in enumerate(part) if t.is_word("COUNT")]):
            words = [j for j in range(i, len(part)) if part[j].kind != "space"][:4]
            if [part[j].text for j in words[1:]] == ["(", "*", ")"]:
                part[i : words[-1] + 1] = [Token("kept", "coalesce(sum(_pairs), 0)")]
                counts += not outside
        outside.append(part)
    rest = [*outside[0], *(t for on in found.conditions[2:] for t in on), *outside[1]]
    plain = [t for t in rest if t.kind != "space"]
    if not counts or any(t.is_word("SELECT") for t in plain[1:]) or any(t.is_word("DISTINCT", "OVER", "WITH", "FILTER") or t.text in ("(", "*") for t in plain):
        return None
    asked = tokenize(_qualified(rest, found.columns))
    named = {t.text.strip("`").lower() for i, t in enumerate(asked) if (j := _next(asked, i)) is not None and asked[j].text == "."}
    sides = [(a, b) for a, b in ((0, 1), (1, 0)) if found.names[b].lower() not in named]
    if not sides:
        return None
    kept, other = sides[0]
    own = {n: found.columns[n] for n in found.names[:2]}
    pairs = [_comparisons(b, found.names[kept], found.names[other], own) for b in branches]
    left, right = (spark.sql(f"SELECT * FROM {found.sources[i]}") for i in (kept, other))
    kinds = [{f.name.lower(): f.dataType for f in df.schema.fields} for df in (left, right)]
    if None in pairs or any(len(k) < len(df.columns) for k, df in zip(kinds, (left, right))):
        return None
    parts = []
    for n in range(1, len(pairs) + 1):
        for some in combinations(pairs, n):
            every = sorted(set().union(*some))
            orders = [c for c in every if c[1] != "="]
            equal = [(x, y) for x, sign, y in every if sign == "="]
            if len(orders) > 1 or not equal or any(kinds[0][x] != kinds[1][y] for x, _, y in every) or orders and not joins.ordered(kinds[0][orders[0][0]]):
                return None
            counted = joins.partner_counts(left, right, equal, orders[0] if orders else None, "_pairs")
            parts.append(counted if n % 2 else counted.withColumn("_pairs", -F.col("_pairs")))
    view = f"_counted_{uuid.uuid4().hex}"
    reduce(DataFrame.unionAll, parts).createOrReplaceTempView(view)
    try:
        text = f"{_text(outside[0])} FROM {view} AS `{found.names[kept]}`" + "".join(f" JOIN {s} ON {_text(on).strip()}" for s, on in zip(found.sources[2:], found.conditions[2:]))
        out = spark.sql(f"{text} {_text(outside[1])}").toDF(*spark.sql(sql).columns)
        return out if [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == _schema(spark, sql) else None
    finally:
        spark.catalog.dropTempView(view)


def _qualified(tokens: list[Token], columns: dict[str, list[str]]) -> str:
    """Text in which columns of one table only, outside subqueries, are written with its name."""
    owner: dict[str, list[str]] = {}
    for table, names in columns.items():
        for c in names:
            owner.setdefault(c.lower(), []).append(table)
    out, hidden = [], 0
    for i, t, depth in _levels(tokens):
        before, after = _next(tokens, i, -1), _next(tokens, i)
        if t.text == "(" and after is not None and tokens[after].is_word("SELECT") and not hidden:
            hidden = _closing(tokens, i)
        name = t.text.strip("`").lower()
        alone = (before is None or tokens[before].text != "." and not tokens[before].is_word("AS")) and (after is None or tokens[after].text not in (".", "("))
        plain = t.kind in ("word", "tick") and not (t.kind == "word" and t.upper in KEYWORDS)
        if plain and alone and i >= hidden and len(owner.get(name, ())) == 1:
            word = before is not None and (tokens[before].text == ")" or tokens[before].kind in ("word", "tick", "number") and tokens[before].upper not in KEYWORDS)  # an alias without AS
            out.append(t.text if word else f"{owner[name][0]}.{t.text}")
        else:
            out.append(t.text)
    return "".join(out)


# Windows without a partition

_PLACES = {"ROW_NUMBER": {}, "RANK": {"ties": True}, "DENSE_RANK": {"dense": True}}
_TOTALS = ("SUM", "COUNT", "AVG", "MIN", "MAX")


@dataclass
class _Call:
    """name(argument) OVER (ORDER BY key ..) at the tokens start to end of a select item."""

    start: int
    end: int
    name: str
    argument: str
    key: str
    descending: bool = False
    nulls_first: bool = True


def _calls(item: list[Token]) -> list[_Call] | None:
    """The windows of a select item; None if one has a partition, a frame or several keys."""
    found = []
    for i, t in enumerate(item):
        if not t.is_word("OVER"):
            continue
        opening, before = _next(item, i), _next(item, i, -1)
        if opening is None or item[opening].text != "(" or before is None or item[before].text != ")":
            return None
        depth, start = 0, before
        while start >= 0:
            depth += (item[start].text == ")") - (item[start].text == "(")
            if depth == 0:
                break
            start -= 1
        name = _next(item, start, -1)
        close = _closing(item, opening)
        spec = item[opening + 1 : close]
        if name is None or any(t.is_word("PARTITION", "ROWS", "RANGE", "GROUPS") for t in spec):
            return None
        call = _Call(name, close + 1, item[name].upper, _text(item[start + 1 : before]).strip(), "")
        words = [t for t in spec if t.kind != "space"]
        if words:
            if len(words) < 3 or not (words[0].is_word("ORDER") and words[1].is_word("BY")) or len(_split(spec, ",")) > 1:
                return None
            nulls = None
            if words[-2].is_word("NULLS"):
                nulls, words = words[-1].is_word("FIRST"), words[:-2]
            call.descending = words[-1].is_word("DESC")
            call.nulls_first = nulls if nulls is not None else not call.descending
            if words[-1].is_word("ASC", "DESC"):
                words = words[:-1]
            call.key = " ".join(t.text for t in words[2:]).replace(" . ", ".")
        if not (call.key and call.name in _PLACES and not call.argument or call.key and call.name == "SUM" or not call.key and call.name in _TOTALS):
            return None
        found.append(call)
    return found


def _without_gathering(spark: SparkSession, sql: str) -> DataFrame | None:
    """The result of a SELECT whose windows have no partition: places and running sums by ranges of their key, aggregates OVER () as
    one row from a subquery. None for other statements, and for what is grouped, distinct or joined by set operators."""
    tokens = _parts(sql)
    first = next((t for t in tokens if t.kind != "space"), None)
    own = {t.upper for _, t, depth in _levels(tokens) if depth == 0 and t.kind == "word"}
    if first is None or not first.is_word("SELECT") or own & {"GROUP", "HAVING", "DISTINCT", "WINDOW", "QUALIFY", *SET_OPERATORS} or "OVER" not in own or "FROM" not in own:
        return None
    start, end = _select_list(tokens)
    tail = next((i for i, t, depth in _levels(tokens) if i > end and depth == 0 and t.is_word("ORDER", "LIMIT", "OFFSET")), len(tokens))
    source = _text(tokens[end:tail]).strip()
    names, base, wanted = spark.sql(sql).columns, [], []
    if len(names) != len(_split(tokens[start:end], ",")) or len({n.lower() for n in names}) < len(names):
        return None  # a star, or names that tell nothing apart
    for n, (item, _) in enumerate(_items(tokens)):
        calls = _calls(item)
        if calls is None:
            return None
        places = [c for c in calls if c.key]
        if not places:  # each aggregate of all rows is one row
            for c in reversed(calls):
                item = [*item[: c.start], Token("kept", f"(SELECT {c.name}({c.argument}) {source})"), *item[c.end :]]
            base.append(f"{_text(item).strip()} AS _c{n}")
            continue
        call = places[0]
        if len(calls) > 1 or any(t.kind != "space" for t in [*item[: call.start], *item[call.end :]]):
            return None
        base.append(f"{call.key} AS _c{n}" + (f", {call.argument} AS _v{n}" if call.argument else ""))
        wanted.append((n, call))
    rows = spark.sql(f"SELECT {', '.join(base)} {source}")
    for n, call in wanted:
        how = {"descending": call.descending, "nulls_first": call.nulls_first}
        rows = ranking.placed(rows, f"_c{n}", f"_w{n}", **_PLACES[call.name], **how) if call.name in _PLACES else ranking.running_sum(rows, f"_c{n}", f"_v{n}", f"_w{n}", **how)
    at = {n for n, _ in wanted}
    out = rows.selectExpr(*[f"{'_w' if n in at else '_c'}{n} AS `{name}`" for n, name in enumerate(names)])
    if tail == len(tokens):
        return out
    view = f"_placed_{uuid.uuid4().hex}"
    out.createOrReplaceTempView(view)
    try:
        return spark.sql(f"SELECT * FROM {view} {_text(tokens[tail:])}")  # an order by what is not selected is an error: then the first text stays
    finally:
        spark.catalog.dropTempView(view)
