"""Whether two query results are the same: multisets of rows under several ways to match columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.canonical import canonical, canonical_frame, loosely_equal, normalized
from ..functions.sqltext import normalize_sql_text
from ..sources.adapters import DatabaseConnectionError, QueryOutcome, SparkAdapter

#: Rows that the row-order mapping looks at, and the least score of a match. Fixed values.
MAPPING_ROWS, MAPPING_SCORE = 10, 0.8
AMBIGUOUS = "AMBIGUOUS_QUERY"


@dataclass
class Comparison:
    equal: bool
    reason: str = ""
    strategy: str = ""
    normalized: bool = False


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(the columns of a, n_a, n_b): rows that do not occur equally often; columns match by place. One grouping over both."""
    names = a.columns
    both = a.withColumn("_a", F.lit(1)).unionAll(b.toDF(*names).withColumn("_a", F.lit(0)))
    counts = both.groupBy(*names).agg(F.sum("_a").cast("long").alias("n_a"), F.sum(1 - F.col("_a")).cast("long").alias("n_b"))
    return counts.filter("n_a <> n_b")


def same_multiset(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows equally often, null equal to null, in any order."""
    return row_differences(a, b).isEmpty()


def same_set(a: DataFrame, b: DataFrame) -> bool:
    """The looser measure that ignores how often a row occurs."""
    x, y = canonical_frame(a), canonical_frame(b)
    return row_differences(x.distinct(), y.distinct()).isEmpty()


def column_signatures(df: DataFrame) -> list[tuple[str, int, int]]:
    """For each column of a canonical frame its multiset of values as hash sums, whatever the order of rows: one pass."""
    hashes = []
    for i, c in enumerate(df.columns):
        h = F.xxhash64(F.coalesce(normalized(F.col(c)), F.lit("\0null")))
        hashes += [F.sum(x.cast("decimal(20,0)")).alias(f"{k}{i}") for k, x in (("a", h), ("b", F.xxhash64(h)))]  # 30 digits for 10^10 rows
    row = df.agg(*hashes).first()
    return [(c, row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(df.columns)]


def map_columns(gold: DataFrame, pred: DataFrame) -> list[int] | None:
    """For each gold column the pred column with the same values, by signature; None if one has no partner."""
    x, y = column_signatures(gold), column_signatures(pred)
    used, mapping = set(), []
    for _, a, b in x:
        at = next((j for j, (_, c, d) in enumerate(y) if j not in used and (c, d) == (a, b)), None)
        if at is None:
            return None
        used.add(at)
        mapping.append(at)
    return mapping


def map_columns_in_order(gold: list[list], pred: list[list]) -> list[int] | None:
    """The mapping by the first rows as they come: greedy, the share of equal places decides; None if a column has no partner."""
    if not gold or not pred or len(gold[0]) != len(pred[0]):
        return None
    n = min(len(gold), len(pred), MAPPING_ROWS)
    text = lambda rows, j: [("<nil>" if r[j] is None else str(r[j])).strip() for r in rows[:n]]
    used, mapping = set(), []
    for i in range(len(gold[0])):
        own, best, score = text(gold, i), None, MAPPING_SCORE
        for j in range(len(pred[0])):
            if j in used:
                continue
            other = text(pred, j)
            s = sum(a == b for a, b in zip(own, other)) / n
            if s >= 1.0:
                best = j
                break
            if s > score:
                best, score = j, s
        if best is None:
            return None
        used.add(best)
        mapping.append(best)
    return mapping


def _settle(gold: DataFrame, pred: DataFrame, strategy: str, message: str) -> Comparison:
    if same_multiset(gold, pred):
        return Comparison(True, "", strategy)
    loose = [x.select(*[normalized(F.col(c)).alias(c) for c in x.columns]) for x in (gold, pred)]
    if same_multiset(*loose):
        return Comparison(True, "", strategy, True)
    counts = [x.distinct().count() for x in (gold, pred)]
    if counts[0] != counts[1]:
        return Comparison(False, f"data row count mismatch: gold={counts[0]}, pred={counts[1]}", strategy)
    return Comparison(False, message, strategy)


def compare_results(gold: DataFrame, pred: DataFrame, row_order: bool = False) -> Comparison:
    """Whether two results are equivalent. Both are cached while they are compared.

    Rows are counted, then columns; then columns are matched by the same names, by content (by signature, or by the
    first rows as they come if row_order), or by place. Two empty results are equivalent.
    """
    x, y = canonical_frame(gold).persist(), canonical_frame(pred).persist()
    try:
        n, m = x.count(), y.count()
        if not n and not m:
            return Comparison(True, "", "empty")
        if n != m:
            return Comparison(False, f"row count mismatch: gold={n}, pred={m}")
        names = [[c.lower() for c in df.columns] for df in (gold, pred)]
        if len(set(names[0])) != len(set(names[1])):
            return Comparison(False, f"column count mismatch: gold={len(set(names[0]))}, pred={len(set(names[1]))}")
        if len(x.columns) != len(y.columns):
            return Comparison(False, f"column count mismatch: gold={len(x.columns)}, pred={len(y.columns)}")
        if set(names[0]) == set(names[1]) and len(set(names[0])) == len(names[0]):
            order = [f"c{names[1].index(c)}" for c in names[0]]
            return _settle(x, y.select(*order).toDF(*x.columns), "exact_column_names", "data mismatch")
        if row_order:
            mapping = map_columns_in_order([list(r) for r in x.limit(MAPPING_ROWS).collect()], [list(r) for r in y.limit(MAPPING_ROWS).collect()])
        else:
            mapping = map_columns(x, y)
        if mapping is not None:
            return _settle(x, y.select(*[f"c{j}" for j in mapping]).toDF(*x.columns), "column_mapping", "column name mismatch and data mismatch")
        return _settle(x, y, "positional", "column name mismatch and positional data mismatch")
    finally:
        x.unpersist()
        y.unpersist()


# Ties at LIMIT 1.


def limit_one_compatible(gold_sql: str, gold: DataFrame, pred: DataFrame) -> tuple[bool, str]:
    """The lenient verdict: any single row is accepted, several rows if the first one equals the gold row."""
    import re

    if not re.search(r"(?i)\sLIMIT\s+1\b(?!\s*,)", gold_sql):
        return False, "gold SQL has no LIMIT 1"
    rows, own = canonical_frame(pred).limit(2).collect(), canonical_frame(gold).limit(1).collect()
    if not rows:
        return False, "pred SQL returned no row"
    if not own:
        return False, "gold SQL returned no row"
    if len(rows) == 1:
        return True, "pred SQL returned one row, which may be one of the tied values"
    equal = len(rows[0]) == len(own[0]) and all(_values_equal(a, b) for a, b in zip(rows[0], own[0]))
    return equal, "pred SQL returned tied values" if equal else "pred SQL returned several rows that do not match the gold row"


def limit_one_strict(ranked: DataFrame, order: list[Column], pred: DataFrame) -> DataFrame:
    """One row (correct): whether every pred row is among the rows of `ranked` (the gold query without LIMIT) that tie for the first
    place, and there is one. The first place's key is one row; ties are found by an equality filter, not by a sort of all rows."""
    keyed = ranked.select(*ranked.columns, F.struct(*order).alias("_key"))
    least = keyed.agg(F.min("_key").alias("_first"))
    tied = keyed.crossJoin(F.broadcast(least)).filter(F.col("_key").eqNullSafe(F.col("_first"))).select(*ranked.columns)  # one row
    a, b = canonical_frame(tied), canonical_frame(pred)
    missing = b.join(a.distinct(), [b[c].eqNullSafe(a[c]) for c in b.columns], "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("wrong")).crossJoin(b.agg(F.count(F.lit(1)).alias("rows"))).select(((F.col("wrong") == 0) & (F.col("rows") > 0)).alias("correct"))


def _values_equal(a, b) -> bool:
    import re

    a, b = ("<nil>" if v is None else str(v).strip() for v in (a, b))
    number = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
    p, q = number.match(a), number.match(b)
    return a == b or bool(p and q and float(p[0]) == float(q[0]))


# Errors by their messages.

#: Error types by what their message contains, in order; the first that fits counts. Fixed values.
ERROR_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("reference_error", ("gold sql execution failed", "gold sql execution error")),
    ("execution_error", ("predicted sql execution failed", "predicted sql execution error", "syntax error")),
    ("row_count_error", ("row count mismatch", "data row count")),
)
DATA_MARKS = ("data mismatch", "data inconsistency", "value mismatch")
PROJECTION_MARKS = ("column count mismatch", "column name mismatch", "column name count")


def classify_error(reason: Column) -> Column:
    """The error type of a message."""
    text = F.lower(reason)
    has = lambda marks: text.rlike("|".join(marks))  # noqa: E731  plain words only
    rule = F.when(reason.isNull() | (reason == ""), "unknown_error")
    for kind, marks in ERROR_RULES:
        rule = rule.when(has(marks), kind)
    return (
        rule.when(text.contains("column name mismatch") & has(DATA_MARKS), "data_mismatch")
        .when(has(PROJECTION_MARKS), "projection_error")
        .when(has(DATA_MARKS), "data_mismatch")
        .when(text.contains("order"), "order_error")
        .when(text.contains("join"), "join_error")
        .when(has(("where", "condition")), "condition_error")
        .otherwise("other_error")
    )


def classify_error_text(reason: str) -> str:
    text = reason.lower()
    has = lambda marks: any(m in text for m in marks)
    if not reason:
        return "unknown_error"
    for kind, marks in ERROR_RULES:
        if has(marks):
            return kind
    if "column name mismatch" in text and has(DATA_MARKS):
        return "data_mismatch"
    if has(PROJECTION_MARKS):
        return "projection_error"
    if has(DATA_MARKS):
        return "data_mismatch"
    for kind, marks in (("order_error", ("order",)), ("join_error", ("join",)), ("condition_error", ("where", "condition"))):
        if has(marks):
            return kind
    return "other_error"


@dataclass
class Verdict:
    id: int
    db_id: str
    question: str
    gt_sql: str
    pred_sql: str
    difficulty: str = "unknown"
    is_correct: bool = False
    is_equivalent: bool = False
    error_type: str = ""
    error_reason: str = ""
    strategy: str = ""
    spj_result: str = ""
    timings: dict[str, float] = field(default_factory=dict)


def _execution_error(error: str, side: str) -> tuple[str, str]:
    return f"{side} SQL execution error: {error}", "reference_error" if side == "gold" else "execution_error"


def judge(case: dict, adapter: SparkAdapter, row_order: bool = False) -> Verdict:
    """The verdict on one case (id, db_id, question, gt_sql, pred_sql, difficulty, spj_type).

    In this order: asked back, empty prediction, equal text (nothing runs), gold error, prediction error, equal
    results, ties at LIMIT 1, kind of error.
    """
    gold_sql, pred_sql = case.get("gt_sql") or "", case.get("pred_sql") or ""
    v = Verdict(case.get("id", 0), case.get("db_id", ""), case.get("question", ""), gold_sql, pred_sql, case.get("difficulty") or "unknown")
    if pred_sql == AMBIGUOUS:
        v.error_type, v.error_reason = "ambiguous_query", "ambiguous query needs clarification"
        return v
    if not pred_sql:
        v.error_type, v.error_reason = "execution_error", "predicted SQL is empty"
        return v
    if normalize_sql_text(gold_sql) == normalize_sql_text(pred_sql):
        v.is_correct = v.is_equivalent = True
        v.error_type = "exact_match"
        return v
    outcomes: dict[str, QueryOutcome] = {}
    for side, sql in (("gold", gold_sql), ("predicted", pred_sql)):
        try:
            outcomes[side] = adapter.query(sql)
        except DatabaseConnectionError as e:
            v.error_type, v.error_reason = "db_connection_error", str(e)
            return v
        if outcomes[side].error:
            v.error_reason, v.error_type = _execution_error(outcomes[side].error, side)
            return v
    gold, pred = outcomes["gold"].df, outcomes["predicted"].df
    try:
        found = compare_results(gold, pred, row_order)
    except Exception as e:  # raised by the data, when the plans ran
        for side, df in (("gold", gold), ("predicted", pred)):
            try:
                df.write.format("noop").mode("overwrite").save()
            except Exception as own:
                v.error_reason, v.error_type = _execution_error(str(own).splitlines()[0], side)
                return v
        raise e
    v.strategy = found.strategy
    if found.equal:
        v.is_correct = v.is_equivalent = True
        v.error_type = "semantic_match"
        return v
    if case.get("spj_type") not in (None, "", "null"):
        correct, v.spj_result = limit_one_compatible(gold_sql, gold, pred) if case["spj_type"] == "limit_1_tied_values" else (False, f"unknown SPJ type: {case['spj_type']}")
        if correct:
            v.is_correct = v.is_equivalent = True
            v.error_type = "spj_correct"
            return v
    v.error_reason = found.reason
    v.error_type = classify_error_text(found.reason)
    return v


__all__ = ["Comparison", "Verdict", "canonical", "classify_error", "classify_error_text", "column_signatures", "compare_results", "judge", "limit_one_compatible", "limit_one_strict", "loosely_equal", "map_columns", "map_columns_in_order", "row_differences", "same_multiset", "same_set"]
