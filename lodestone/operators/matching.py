"""Columns of two results matched by their values, where cells may differ: similarities over all rows, then the best matching.

Every distinct value of every column is counted; two columns are as similar as their multisets of values overlap. Which column
goes with which is decided for all of them together, by a matching of greatest total similarity, since a greedy choice can take
a column away from the only one it fits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.canonical import canonical_frame, normalized

#: Least similarity of a pair of columns.
LEAST = 0.8


@dataclass(frozen=True)
class Match:
    """pairs: for each gold column the pred column, or None; similarities in the same order."""

    pairs: list[int | None]
    similarities: list[float]

    @property
    def complete(self) -> bool:
        return None not in self.pairs


def _counts(frame: DataFrame, side: str) -> DataFrame:
    """(value, column, n): each column's values with null as one of them. One row for each column and distinct value is shuffled
    from a task."""
    pairs = [F.struct(F.lit(i).alias("column"), F.coalesce(normalized(F.col(c)), F.lit("\0null")).alias("value")) for i, c in enumerate(frame.columns)]
    long = frame.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    return long.groupBy("value", "column").agg(F.count(F.lit(1)).alias("n")).select("value", F.col("column").alias(side), F.col("n").alias(f"n_{side}"))


def similarities(gold: DataFrame, pred: DataFrame) -> list[list[float]]:
    """For each gold and pred column how large a share of the rows their multisets of values have in common, over all rows; the
    longer result counts in full. As many numbers as pairs of columns reach the driver."""
    x, y = canonical_frame(gold), canonical_frame(pred)
    out = [[0.0] * len(y.columns) for _ in x.columns]
    n = max(x.count(), y.count())
    if n:
        met = _counts(x, "a").join(_counts(y, "b"), "value").groupBy("a", "b").agg(F.sum(F.least("n_a", "n_b")).alias("shared"))
        for r in met.collect():
            out[r["a"]][r["b"]] = r["shared"] / n
    return out


def best_matching(weight: list[list[float]]) -> list[int | None]:
    """For each row of a matrix a column of its own (None beyond the smaller side), with the greatest sum of weights; of equally
    good matchings some one. By shortest augmenting paths with potentials (Kuhn and Munkres), cubic in the number of columns."""
    rows, columns = len(weight), len(weight[0]) if weight else 0
    if rows > columns:
        turned = best_matching([[weight[i][j] for i in range(rows)] for j in range(columns)]) if columns else []
        out: list[int | None] = [None] * rows
        for j, i in enumerate(turned):
            if i is not None:
                out[i] = j
        return out
    low, high = [0.0] * (rows + 1), [0.0] * (columns + 1)  # potentials
    owner = [0] * (columns + 1)  # the row of each column; column 0 stands for the row that looks for one
    for i in range(1, rows + 1):
        owner[0], at = i, 0
        least, came, seen = [math.inf] * (columns + 1), [0] * (columns + 1), [False] * (columns + 1)
        while owner[at]:
            seen[at], row, gap, following = True, owner[at], math.inf, 0
            for j in range(1, columns + 1):
                if seen[j]:
                    continue
                cost = -weight[row - 1][j - 1] - low[row] - high[j]
                if cost < least[j]:
                    least[j], came[j] = cost, at
                if least[j] < gap:
                    gap, following = least[j], j
            for j in range(columns + 1):
                if seen[j]:
                    low[owner[j]] += gap
                    high[j] -= gap
                else:
                    least[j] -= gap
            at = following
        while at:
            owner[at], at = owner[came[at]], came[at]
    found: list[int | None] = [None] * rows
    for j in range(1, columns + 1):
        if owner[j]:
            found[owner[j] - 1] = j - 1
    return found


def match_columns(gold: DataFrame, pred: DataFrame, least: float = LEAST) -> Match:
    """The matching of columns with the greatest similarity in all; pairs below `least` have no part in it."""
    found = similarities(gold, pred)
    held = [[s if s >= least else 0.0 for s in row] for row in found]
    pairs = best_matching(held)
    kept = [j if j is not None and held[i][j] > 0 else None for i, j in enumerate(pairs)]
    return Match(kept, [found[i][j] if j is not None else 0.0 for i, j in enumerate(kept)])


def greedy_matching(weight: list[list[float]], least: float = LEAST) -> list[int | None]:
    """For each row in turn the best column that is left, for comparison."""
    used: set[int] = set()
    out: list[int | None] = []
    for row in weight:
        best = max((j for j in range(len(row)) if j not in used and row[j] >= least), key=lambda j: (row[j], -j), default=None)
        used |= {best} - {None}
        out.append(best)
    return out


def row_overlap(gold: DataFrame, pred: DataFrame, match: Match) -> float:
    """The share of rows that both have, each as often as it occurs, once the pred columns stand in gold's order. 0 without a complete
    match; 1 for two empty results."""
    if not match.complete:
        return 0.0
    x, y = canonical_frame(gold), canonical_frame(pred)
    y = y.select(*[F.col(y.columns[j]).alias(x.columns[i]) for i, j in enumerate(match.pairs)])
    both = [f.select(*[F.coalesce(normalized(F.col(c)), F.lit("\0null")).alias(c) for c in x.columns]).groupBy(*x.columns).agg(F.count(F.lit(1)).alias(n)) for f, n in ((x, "_a"), (y, "_b"))]
    n = max(gold.count(), pred.count())
    shared = both[0].join(both[1], x.columns).agg(F.sum(F.least("_a", "_b")).alias("s")).first()["s"] or 0
    return shared / n if n else 1.0
