"""Density clusters by blocks and the vector index against plain versions."""

import numpy as np
import pytest

from graphloom.operators import clustering, density, vector_index


def frame(spark, x, groups=None):
    rows = [(i, int(groups[i]) if groups is not None else 0, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, repo int, embedding array<double>").repartition(3)


def blobs(seed, n, centres, spread, dim=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim)) * 5
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dim)) * spread


def test_density_of_one_group_equals_all_distances(spark):
    for x in (np.r_[blobs(1, 240, 4, 0.3), np.random.default_rng(2).uniform(-9, 9, (60, 3))], np.round(blobs(3, 200, 5, 0.8))):  # the second has many ties
        want = density.density_labels(x)
        got = {r.id: r.cluster for r in density.density(frame(spark, x), None, "id", block=64).collect()}
        assert [got[i] for i in range(len(x))] == want.tolist() and len(set(want)) > 3


def test_density_by_groups(spark):
    sizes = [120, 7, 1, 40]
    x, groups = np.concatenate([blobs(k, n, 3, 0.3) for k, n in enumerate(sizes)]), np.repeat(range(4), sizes)
    got = {r.id: (r.repo, r.cluster) for r in density.density(frame(spark, x, groups), "repo", "id", block=50).collect()}
    for g in range(4):
        own = np.flatnonzero(groups == g)
        assert [got[i] for i in own] == [(g, c) for c in density.density_labels(x[own])]


def test_density_of_copies_and_ties(spark):
    """Equal vectors are searched once; which of equal edges are in the tree still goes by ids."""
    rng = np.random.default_rng(5)
    x = [rng.integers(0, side, (n, 2)).astype(float) for n, side in ((150, 4), (150, 12), (90, 30), (60, 2))]  # many copies, some, few, and little else
    x.append(np.r_[np.zeros((80, 2)), blobs(6, 60, 3, 0.2, 2), np.zeros((40, 2)), np.ones((3, 2)) * 1e-3, -np.zeros((5, 2))])
    x.append(np.repeat(rng.normal(size=(40, 2)), 3, axis=0)[rng.permutation(120)])
    groups = np.repeat(range(len(x)), [len(v) for v in x])
    got = {r.id: r.cluster for r in density.density(frame(spark, np.concatenate(x), groups), "repo", "id", block=32).collect()}
    for g, v in enumerate(x):
        assert [got[i] for i in np.flatnonzero(groups == g)] == density.density_labels(v).tolist(), g


def test_density_meets_each_pair_once(spark, monkeypatch):
    """Rounds after the lists meet only vectors whose lists don't tell: all products are fewer than one of all with all."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    met = spark.sparkContext.accumulator(0)

    def counted(f, size):
        def run(*a):
            met.add(size(*a))
            return f(*a)

        return run

    sizes = {"_meet": lambda a, b: len(a.ids) * len(b.ids), "_nearer": lambda best, x, y: len(x) * len(y), "_leaving": lambda x, y, *_: len(x) * len(y)}
    for name, size in sizes.items():
        monkeypatch.setattr(density, name, counted(getattr(density, name, None), size), raising=False)
    got = {r.id: r.cluster for r in density.density(frame(spark, x), None, "id", block=50).collect()}
    assert [got[i] for i in range(900)] == density.density_labels(x).tolist()
    assert 900 * 900 / 2 <= met.value < 900 * 900


@pytest.mark.parametrize(("scale", "shift"), [(1, 0), (1, 1e6), (1e-25, 0), (1e25, 0), (1e100, 0)])
def test_lists_of_a_tile_are_the_exact_ones(scale, shift):
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(300, 16)) + shift) * scale
    x[290:] = x[:10] * (1 + 1e-9)
    a, b = (density._Side(np.arange(len(v)) + at, np.ones(len(v), int), v, np.full(len(v), np.inf), 7) for v, at in ((x[:120], 0), (x[120:], 120)))
    for p, q in ((a, a), (a, b), (b, b)):
        density._meet(p, q)
    far = density.distances(x, x)
    np.fill_diagonal(far, np.inf)
    for side in (a, b):
        side.fold()
        assert (side.found["far"].reshape(-1, 7) == np.sort(far, axis=1)[side.ids, :7]).all()
        assert (side.found["far"] == far[side.ids[side.found["row"]], side.found["id"]]).all()


def test_density_without_rows(spark):
    none = spark.createDataFrame([(1, 0, None)], "id long, repo int, embedding array<double>")
    assert density.density(none, None, "id").count() == 0
    assert clustering.density is density.density


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    x = blobs(7, 3000, 12, 1.5, 24)
    x[17] = x[5]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    return x, df, vector_index.VectorIndex(spark, str(tmp_path_factory.mktemp("index"))).build(df, "id")


def brute(x, q, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = u @ u[q]
    return np.lexsort((np.arange(len(x)), -np.round(score, 12)))[:k].tolist(), score


def test_exact_search_and_recall(index):
    x, df, found = index
    queries = df.where("id % 100 = 0")
    exact, near = {}, {}
    for out, kind in ((exact, True), (near, False)):
        for r in found.search(queries, "id", 10, probes=8, exact=kind).orderBy("qid", "rank").collect():
            out.setdefault(r.qid, []).append(r.id)
    hits = total = 0
    for q in range(0, 3000, 100):
        want, score = brute(x, q, 10)
        assert np.allclose(score[exact[q]], score[want]) and sorted(exact[q]) == sorted(want)
        hits, total = hits + len({*near[q]} & {*want}), total + 10
    assert hits / total >= 0.95, hits / total


def test_only_probed_lists_are_read(index, spark):
    _, df, found = index
    _, blocks = found._open()
    assert blocks.select("list").distinct().count() > 20
    wanted = vector_index._lists(df.where("id = 0").selectExpr("id AS qid", "embedding AS x", "4D AS known"), found._open()[0], 0, 2, wide=True)
    plan = found._scored(blocks, wanted, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1][:80]


def test_few_rows_and_none(spark, tmp_path):
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.1])], "id long, embedding array<double>")
    one = vector_index.VectorIndex(spark, str(tmp_path / "a")).build(few, "id")
    got = [(r.qid, r.rank, r.id) for r in one.search(few.where("id = 1"), "id", 10, probes=1, exact=True).orderBy("rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 3), (1, 3, 2)]
    none = vector_index.VectorIndex(spark, str(tmp_path / "b")).build(few.limit(0), "id")
    assert none.search(few, "id").count() == 0
