"""Points in intervals and greedy budgets by rounds, against plain Python."""

import random

import pytest

from graphloom.operators import budget, intervals


def test_points_in_intervals_of_all_lengths(spark):
    rnd = random.Random(3)
    spans = [(rnd.choice("ab"), i, a, a + rnd.choice([-1, 0, 5, 63, 64, 300, 5000, 10**6, 10**9])) for i in range(300) for a in [rnd.randrange(2000)]] + [("a", 900, None, 5), ("a", 901, 5, None), (None, 902, 0, 9)]
    points = [(rnd.choice("abc"), rnd.choice([rnd.randrange(3000), rnd.randrange(10**6)])) for _ in range(200)] + [("a", None), (None, 5)]
    n = spark.createDataFrame(spans, "path string, id int, low long, high long")
    p = spark.createDataFrame(points, "path string, line long")
    want = sorted((k, at, i) for k, at in points for path, i, a, b in spans if k is not None and k == path and None not in (at, a, b) and a <= at <= b)
    got = intervals.containing(p, n, "path", "line", "low", "high").select("path", "line", "id")
    assert sorted(map(tuple, got.collect())) == want
    assert sorted(r.id for r in intervals.hit_by(n, p, "path", "line", "low", "high").collect()) == sorted({i for _, _, i in want})


def test_one_path_with_many_nodes_is_no_product(spark):
    n = spark.range(100_000).selectExpr("'p' AS path", "id", "id * 7 AS low", "id * 7 + 40 AS high")
    p = spark.range(100_000).selectExpr("'p' AS path", "id * 5 AS line")
    assert intervals.containing(p, n, "path", "line", "low", "high").count() == sum((5 * i) // 7 - max(0, -(-(5 * i - 40) // 7)) + 1 for i in range(100_000))


def fold(rows, limit):
    used, out = 0, []
    for _, _, i, t in sorted((-s, i, i, t) for i, s, t in rows):
        if used + t <= limit:
            used += t
            out.append((i, t))
        elif used == 0 and t > limit:
            return sorted([*out, (i, limit)])
    return sorted(out)


@pytest.mark.parametrize("seed", [0, 1])
def test_rounds_equal_the_fold(spark, seed):
    rnd = random.Random(seed)
    rows = {r: [(i, rnd.choice([0.1, 0.4, 0.4, 0.9, rnd.random()]), rnd.choice([0, 1, 5, 20, 60, 99, 150])) for i in range(rnd.choice([3, 60]))] for r in range(6)}
    rows[10] = [(0, 1.0, 0), (1, 0.9, 0), (2, 0.8, 500), (3, 0.7, 1), *[(k, 0.1, 1) for k in range(4, 30)]]
    df = spark.createDataFrame([(r, *x) for r, own in rows.items() for x in own], "req long, ord long, score double, tokens long")
    got = {}
    for x in budget.greedy(df, 100, fold=4).collect():
        got.setdefault(x.req, []).append((x.ord, x.tokens))
    assert {r: sorted(own) for r, own in got.items()} == {r: want for r, own in rows.items() if (want := fold(own, 100))}
