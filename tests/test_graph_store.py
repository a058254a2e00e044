"""Stored adjacency and path lengths against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import adjacency, impact, paths, traverse

EDGES = "source string, target string, type string, line int, ord long"
NODES = "id string, type string, name string, path string, ord long"


def random_graph(seed, n=12, m=26):
    rnd = random.Random(seed)
    e = [(f"v{rnd.randrange(n)}", f"v{rnd.randrange(n)}", rnd.choice(["CALLS", "IMPORTS", "EXTENDS"]), 1, i) for i in range(m)]
    nodes = [(f"v{i}", "file", f"v{i}", f"p{i // 2}", i) for i in range(n)] + [("v0", "file", "again", "p9", n)]
    return nodes, e


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    nodes, e = random_graph(5, 40, 120)
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(e, EDGES)
    return n, e, adjacency.Adjacency(n, e, str(tmp_path_factory.mktemp("graph")))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("direction", ["outgoing", "incoming", "both"])
@pytest.mark.parametrize("types", [None, ["CALLS", "EXTENDS"]])
def test_walks_equal_those_over_all_edges(big, direction, types):
    _, e, store = big
    for got, want in zip(traverse.khop(store, "v3", 3, direction, types), traverse.khop(e, "v3", 3, direction, types), strict=True):
        assert rows(got) == rows(want)


def test_weights_paths_and_impact(big):
    n, e, store = big
    rounded = lambda df: rows(df.select("id", F.round("weight", 9)))
    assert rounded(traverse.weighted(store, "v1")) == rounded(traverse.weighted(e, "v1"))
    for a, b in (("v1", "v7"), ("v2", "v2"), ("v0", "none")):
        assert traverse.shortest_path(store, a, b) == traverse.shortest_path(e, a, b)
    assert rows(impact.direct(store, None, ["p1", "p2"])) == rows(impact.direct(e, n, ["p1", "p2"]))
    assert rows(impact.closure(store, None, ["p1"], None)) == rows(impact.closure(e, n, ["p1"], None))


def test_only_buckets_of_the_frontier_are_read(big, spark):
    _, _, store = big
    met = store.out.of(spark.createDataFrame([("v3",)], "a string"), 1)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [" in plan and "v3" in plan
    files = {f.rpartition("bucket=")[2].partition("/")[0] for f in met.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert len(files) <= 1


def test_large_frontiers_and_new_versions(spark, tmp_path, monkeypatch):
    nodes, e = random_graph(9, 30, 80)
    n, e = spark.createDataFrame(nodes, NODES), spark.createDataFrame(e, EDGES)
    (tmp_path / "t").mkdir()
    e.write.parquet(str(tmp_path / "t" / "e"))
    first = adjacency.opened(spark, "x", [str(tmp_path / "t")], lambda: n, lambda: e)
    assert adjacency.opened(spark, "x", [str(tmp_path / "t")], lambda: n, lambda: e) is first
    monkeypatch.setattr(adjacency, "PUSHED_IDS", 1)
    monkeypatch.setattr(adjacency, "BROADCAST_IDS", 1)
    assert rows(traverse.khop(first, "v3", 4, "both")[0]) == rows(traverse.khop(e, "v3", 4, "both")[0])
    e.limit(3).write.mode("append").parquet(str(tmp_path / "t" / "e"))
    assert adjacency.opened(spark, "x", [str(tmp_path / "t")], lambda: n, lambda: e) is not first


def brute_lengths(edges, start, depth):
    found, level = set(), [(start, frozenset())]
    for k in range(1, depth + 1):
        level = list({(b, used | {i}) for at, used in level for a, b, _, _, i in edges if a == at and i not in used})
        found |= {(b, k) for b, _ in level}
    return found


def thinned_lengths(edges, start, depth):
    """The operator's rule without Spark."""
    found, level = set(), {start: [frozenset()]}
    for k in range(1, depth + 1):
        new = {}
        for at, sets in level.items():
            for a, b, _, _, i in edges:
                if a == at:
                    new.setdefault(b, []).extend(s | {i} for s in sets if i not in s)
        level = {b: paths.representative(dict.fromkeys(sets), depth - k) for b, sets in new.items() if sets}
        assert all(len(sets) <= 10 for sets in level.values())
        found |= {(b, k) for b in level}
    return found


def test_representative_sets_lose_no_length():
    for seed in range(200):
        rnd = random.Random(seed)
        _, e = random_graph(seed, rnd.randrange(2, 7), rnd.randrange(3, 14))
        depth = rnd.randrange(1, 6)
        assert thinned_lengths(e, "v0", depth) == brute_lengths(e, "v0", depth), seed


def test_path_lengths_on_spark(spark, big):
    for seed in (1, 2):
        _, e = random_graph(seed, 5, 12)
        got = paths.path_lengths(spark.createDataFrame(e, EDGES), "v0", 5)
        assert {tuple(r) for r in got.collect()} == brute_lengths(e, "v0", 5)
    _, e, store = big
    assert rows(paths.path_lengths(store, "v3", 3, reverse=True)) == rows(paths.path_lengths(e, "v3", 3, reverse=True))


def test_hub_inside_cycles(spark):
    """A hub with 1000 neighbours, each way: hundreds of millions of paths, ten sets."""
    e = [("hub", f"n{i}", "CALLS", 1, 2 * i) for i in range(1000)] + [(f"n{i}", "hub", "CALLS", 1, 2 * i + 1) for i in range(1000)]
    got = paths.path_lengths(spark.createDataFrame(e, EDGES), "hub", 5).groupBy("distance").count().collect()
    assert {r[0]: r[1] for r in got} == {1: 1000, 2: 1, 3: 1000, 4: 1, 5: 1000}
