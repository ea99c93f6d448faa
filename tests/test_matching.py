"""Matching of columns against every permutation, and on results with changed cells."""

import itertools
import random
from collections import Counter

import pytest

from lodestone.operators import matching


@pytest.mark.parametrize("rows, columns", [(1, 1), (3, 3), (4, 4), (5, 3), (2, 5), (0, 0)])
def test_best_matching_is_the_best_permutation(rows, columns):
    rng = random.Random(rows * 10 + columns)
    for _ in range(40):
        weight = [[rng.choice([0.0, 0.5, 0.8, rng.random()]) for _ in range(columns)] for _ in range(rows)]
        got = matching.best_matching(weight)
        used = [j for j in got if j is not None]
        assert len(used) == len(set(used)) == min(rows, columns)
        total = sum(weight[i][j] for i, j in enumerate(got) if j is not None)
        if rows <= columns:
            best = max((sum(weight[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(columns), rows)), default=0)
        else:
            best = max(sum(weight[i][j] for j, i in enumerate(p)) for p in itertools.permutations(range(rows), columns))
        assert total == pytest.approx(best)


def test_similarities_equal_multisets(spark):
    rng = random.Random(5)
    a = [(rng.choice([1, 2, None]), rng.choice("xy"), rng.random() < 0.5) for _ in range(60)]
    b = [(rng.choice("xyz"), rng.choice([1, 2, 3])) for _ in range(50)]
    got = matching.similarities(spark.createDataFrame(a, "p int, q string, r boolean"), spark.createDataFrame(b, "s string, t long"))
    for i, j in itertools.product(range(3), range(2)):
        x, y = (Counter("null" if r[k] is None else str(r[k]).lower() if isinstance(r[k], bool) else str(r[k]) for r in rows) for rows, k in ((a, i), (b, j)))
        assert got[i][j] == pytest.approx((x & y).total() / 60)


def test_changed_cells_map_right_where_greedy_fails(spark):
    """5 % of all cells changed; the first column looks more like another's partner than like its own."""
    rng = random.Random(7)
    ids = list(range(1000))
    gold = [(i, i if rng.random() < 0.97 else i + 5000, f"n{i % 40}", i % 7) for i in ids]
    broken = lambda v: v if rng.random() < 0.95 else f"?{rng.randrange(10**6)}"
    pred = [(broken(f"n{i % 40}"), broken(str(i % 7)), broken(str(second)), broken(str(first + (5000 if rng.random() < 0.05 else 0)))) for first, second, _, _ in gold for i in [first]]
    rng.shuffle(pred)
    x, y = spark.createDataFrame(gold, "a int, b int, c string, d int"), spark.createDataFrame(pred, "k string, l string, m string, n string")
    weight = matching.similarities(x, y)
    match = matching.match_columns(x, y)
    assert match.complete and sorted(match.pairs) == [0, 1, 2, 3] and match.pairs[2:] == [0, 1]
    best = max(sum(weight[i][p[i]] for i in range(4)) for p in itertools.permutations(range(4)))
    assert sum(match.similarities) == pytest.approx(best) and min(match.similarities) > 0.85
    assert 0.6 < matching.row_overlap(x, y, match) < 0.95
    # a case in which greedy choice leaves the second column without a partner
    apart = [[0.95, 0.9], [0.94, 0.1]]
    assert matching.greedy_matching(apart) == [0, None] and matching.best_matching(apart) == [1, 0]


def test_no_partner_and_empty_results(spark):
    x, y = spark.createDataFrame([(1, "a"), (2, "b")], "p int, q string"), spark.createDataFrame([("b", 9), ("a", 8)], "s string, t int")
    match = matching.match_columns(x, y)
    assert match.pairs == [None, 0] and not match.complete and matching.row_overlap(x, y, match) == 0.0
    none = spark.createDataFrame([], "p int, q string")
    assert matching.match_columns(none, none).pairs == [None, None]
    same = matching.match_columns(x, x)
    assert same.pairs == [0, 1] and same.similarities == [1.0, 1.0] and matching.row_overlap(x, x, same) == 1.0
