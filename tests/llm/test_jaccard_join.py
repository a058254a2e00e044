"""The Jaccard join against all pairs in plain Python."""

import itertools
import random

import numpy as np
import pytest

from graphloom.llm import jaccard_join, queries

from .conftest import WORDS, passage


def grams(text, width=3):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width=3, up=9, down=10):
    """(doc_id, n, component) of each row, sorted."""
    sets = [grams(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        small, large = sorted((len(sets[a]), len(sets[b])))
        if small and down * small >= up * large and down * len(sets[a] & sets[b]) >= up * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted(((d, len(sets[k]), least.get(find(k))) for k, (d, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def family(seed, base, n, changed):
    """n texts that differ from ``base`` in ``changed`` words each."""
    rnd, out = random.Random(seed), []
    for k in range(n):
        w = base.split()
        for at in rnd.sample(range(len(w)), changed[k % len(changed)]):
            w[at] = rnd.choice(WORDS) + str(rnd.randrange(4))  # few values, so that changes are shared
        out.append(" ".join(w))
    return out


def test_defined_cases(docs, rows, empty):
    assert got(jaccard_join.components(docs)) == brute([r[:2] for r in rows])
    assert jaccard_join.components(empty).count() == 0
    many = docs.selectExpr("doc_id", "text", "1 AS node", "2 AS region", "3 AS d", "4 AS root")
    assert got(jaccard_join.components(many)) == brute([r[:2] for r in rows])


@pytest.mark.parametrize("small", [2048, 16])
def test_equals_all_pairs(spark, small):
    rnd, texts = random.Random(1), []
    for f in range(4 if small > 16 else 1):
        texts += family(f, passage(50 + f, 140), 60 if small > 16 else 30, (0, 1, 2, 3, 4, 5, 7))
    texts += family(9, passage(60, 12), 40 if small > 16 else 20, (0, 1, 2)) + [passage(70 + k, rnd.randrange(1, 60)) for k in range(60)]
    texts += [passage(80, n) for n in (9, 10, 11, 12, 13, 22, 23, 24, 30, 31, 33, 34)] * 2
    walk = passage(90, 400).split()
    texts += [" ".join(walk[k : k + 200]) for k in range(0, 200, 9)]  # a chain
    rnd.shuffle(texts)
    own = list(enumerate(texts))
    want = brute(own)
    assert got(jaccard_join.components(spark.createDataFrame(own, "doc_id long, text string").repartition(5), small=small)) == want
    assert 60 < len({c for _, _, c in want}) < len(own) - 40


def test_family_below_the_threshold(spark):
    """Hundreds of texts of one origin, similar but seldom enough: no step makes rows by their square."""
    texts = family(3, passage(5, 200), 500, (5, 6, 7))
    own = list(enumerate(texts))
    df = spark.createDataFrame(own, "doc_id long, text string")
    assert got(jaccard_join.components(df)) == brute(own)
    d = jaccard_join.keyed(df)
    nodes = jaccard_join.signatures(d, 3, 9, 10).where("n > 0")
    assert jaccard_join.pivots(nodes).count() < 30 * len(own) < 500 * 499 / 2


@pytest.mark.parametrize(("up", "down"), [(9, 10), (4, 5), (2, 3), (1, 2)])
def test_projections_lose_no_pair(up, down):
    rnd = np.random.default_rng(up)
    for _ in range(300):
        n = int(rnd.integers(1, 90))
        x = np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64))
        y = x[rnd.random(len(x)) < rnd.uniform(up / down, 1)]
        y = np.union1d(y, rnd.integers(0, 1 << 63, int(rnd.integers(0, 3)), dtype=np.uint64))
        both, all_ = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        if len(y) and down * both >= up * all_ and both < all_:
            of, values = jaccard_join.projections([x, y], up, down)
            assert set(values[of == 0]) & set(values[of == 1])


def test_long_text(spark):
    text = passage(3, 150_000)  # over a megabyte
    own = [(1, text), (2, text + " more"), (3, "lorem ipsum dolor sit amet " * 40_000), (4, "Lorem " + "ipsum dolor sit amet lorem " * 40_000)]
    assert got(jaccard_join.components(spark.createDataFrame(own, "doc_id long, text string"))) == brute(own)


def test_query(spark, sf_dir):
    own = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.QUERIES["op13_jaccard_join"](spark, sf_dir)) == brute(own)
