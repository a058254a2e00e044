"""Operators on small graphs with known answers, repeated ids among them."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import plugins
from graphloom.api import CodeGraph, check_budget, get_preset
from graphloom.operators import budget, clustering, diff, formats, impact, lookup, paths, sync, traverse

NODES = [("main.py", "file", "main.py", "main.py"), ("utils.py", "file", "utils.py", "utils.py"), ("main.py::main", "function", "main", "main.py"), ("utils.py::helper", "function", "helper", "utils.py"), ("utils.py::Config", "class", "Config", "utils.py")]
EDGES = [("main.py", "utils.py", "IMPORTS", 1), ("main.py::main", "utils.py::helper", "CALLS", 2), ("utils.py::Config", "utils.py::helper", "EXTENDS", 3)]


@pytest.fixture(scope="module")
def graph(spark):
    n = spark.createDataFrame([(*x, i) for i, x in enumerate(NODES)], "id string, type string, name string, path string, ord long")
    e = spark.createDataFrame([(*x, i) for i, x in enumerate(EDGES)], "source string, target string, type string, line int, ord long")
    return CodeGraph(n.withColumns({"start_line": F.lit(1), "end_line": F.lit(3), "content": F.lit("pass")}), e)


def ids(df):
    return {r.id for r in df.collect()}


def test_khop(graph):
    found, e = graph.dependencies("main.py", 2)
    assert ids(found) == {"main.py", "utils.py"} and e.count() == 1
    found, _ = graph.dependencies("utils.py::helper", 2, "incoming")
    assert ids(found) == {"utils.py::helper", "main.py::main", "utils.py::Config"}
    with pytest.raises(ValueError):
        graph.dependencies("main.py", 6)


def test_a_stored_graph_answers_the_same(graph, tmp_path):
    stored = graph.stored(str(tmp_path / "graph"))
    for a, b in zip(graph.dependencies("main.py", 2, "both"), stored.dependencies("main.py", 2, "both"), strict=True):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert stored.shortest_path("main.py", "utils.py") == ["main.py", "utils.py"]
    assert [(r.path, r.distance) for r in stored.impact(["utils.py"]).collect()] == [("main.py", 1)]


def test_cycles_paths_and_weights(spark):
    e = spark.createDataFrame([("a", "b", "EXTENDS", 0), ("b", "a", "EXTENDS", 1), ("b", "c", "CALLS", 2), ("c", "d", "IMPORTS", 3), ("a", "d", "IMPORTS", 4)], "source string, target string, type string, ord long")
    assert {r.id: r.depth for r in traverse.reach(traverse.arcs(e), spark.createDataFrame([("a",)], "id string")).collect()} == {"a": 0, "b": 1, "c": 2, "d": 1}
    assert {r.id: round(r.weight, 3) for r in traverse.weighted(e, "a").collect()} == {"a": 1.0, "b": 1.0, "c": 0.9, "d": 0.6}
    assert traverse.shortest_path(e, "d", "b") == ["d", "a", "b"] and traverse.shortest_path(e, "d", "zzz") is None
    got = {(r.id, r.distance) for r in paths.path_lengths(e, "a", 3).collect()}
    assert got == {("b", 1), ("d", 1), ("a", 2), ("c", 2), ("d", 3)}
    assert "(circular)" in formats.tree(e, "a")


def test_first_match_wins_on_repeated_ids(spark):
    n = spark.createDataFrame([("x", "p2", 5), ("x", "p1", 3), ("y", "q", 1)], "id string, path string, ord long")
    e = spark.createDataFrame([("x", "y", "CALLS", 1, 0), ("y", "x", "CALLS", 1, 1)], "source string, target string, type string, line int, ord long")
    assert {r.id: r.path for r in lookup.first_nodes(n).collect()} == {"x": "p1", "y": "q"}
    assert sorted((r.path, r.by_path) for r in lookup.file_graph(e, n).collect()) == [("p1", "q"), ("p2", "q"), ("q", "p1")]


def test_impact(graph):
    assert [(r.path, r.distance) for r in graph.impact(["utils.py"]).collect()] == [("main.py", 1)]
    with pytest.raises(LookupError):
        graph.impact(["nope.py"])
    r = graph.pr_impact(["utils.py"]).first()
    assert (r.n_impacted, r.n_direct, r.risk) == (1, 1, "medium")  # main.py is critical
    assert plugins.choose("impact").analyze_impact(["utils.py"], graph.nodes, graph.edges).first().risk == "low"


def test_tests_of(spark):
    f = spark.createDataFrame([("tests/test_a.py",), ("src/test_b.py",), ("src/a.py",)], "path string")
    a = spark.createDataFrame([("src/a.py",), ("src/b.py",), ("src/c.py",)], "path string")
    assert {r.path: r.test for r in impact.tests_of(a, f).collect()} == {"src/a.py": "tests/test_a.py", "src/b.py": "src/test_b.py"}


def test_entry_points(graph):
    assert ids(graph.entry_points("util*")) == {"utils.py", "utils.py::helper", "utils.py::Config"}
    assert ids(graph.entry_points("main.py")) == {"main.py", "main.py::main"}
    assert len(ids(graph.entry_points("utils.py:2"))) == 1 and ids(graph.entry_points("utils.py::helper")) == {"utils.py::helper"}


def test_context(graph, spark):
    ranked, chosen = graph.context(spark.createDataFrame([("main.py",)], "id string"), spark.createDataFrame([("utils.py", 0.9)], "fqn string, s double"), max_tokens=1000)
    assert ids(ranked) == ids(chosen) == {"main.py", "utils.py"}


@pytest.mark.parametrize("seed", range(4))
def test_budgets(spark, seed):
    rnd = random.Random(seed)
    rows = [(r, i, rnd.choice([0.1, 0.5, 0.5, 0.9]), rnd.randrange(1, 60)) for r in range(3) for i in range(9)]
    df = spark.createDataFrame(rows, "req long, ord long, score double, tokens long")
    for r in range(3):
        own = [x for x in rows if x[0] == r]
        used, want = 0, set()
        for _, i, _, t in sorted(own, key=lambda x: (-x[2], x[1])):
            if used + t <= 80:
                used += t
                want.add(i)
        assert {x.ord for x in budget.greedy(df, 80).where(f"req = {r}").collect()} == want
        best = max(sum(x[2] for x in c) for k in range(10) for c in itertools.combinations(own, k) if sum(x[3] for x in c) <= 80)
        got = {x.ord for x in budget.knapsack(df, 80).where(f"req = {r}").collect()}
        assert abs(sum(x[2] for x in own if x[1] in got) - best) < 1e-9 and sum(x[3] for x in own if x[1] in got) <= 80
    one = spark.createDataFrame([(0, 0, 1.0, 500), (0, 1, 0.5, 1)], "req long, ord long, score double, tokens long")
    assert [(x.ord, x.tokens) for x in budget.greedy(one, 80).collect()] == [(0, 80)]
    chosen, stats = budget.allocate(df, 580, "adaptive")
    assert stats.count() == 3 and all(s.total_tokens <= 80 for s in stats.collect())


def test_presets():
    assert get_preset("gpt-4o-mini")[0] == 8192 and get_preset("haiku")[1] == 16000 and get_preset("nothing")[0] == 8192
    with pytest.raises(ValueError):
        check_budget("gpt-4", 9000)


def test_diff(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", None), ("d", 4)], "id string, v int")
    assert {(r.id, r.change) for r in diff.node_changes(old, new).collect()} == {("a", "removed"), ("b", "changed"), ("d", "added")}
    assert diff.node_changes(old, old).count() == 0
    h = {r.id: r.hash for r in diff.content_hash(old).collect()}
    assert len(set(h.values())) == 3
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    last = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("z", 9, 1)], "id string, v int, ord int")
    assert {tuple(r) for r in diff.upsert(base, last, ["id"]).collect()} == {("a", 1), ("b", 6), ("z", 9)}
    assert {tuple(r) for r in diff.insert_ignore(base, last.drop("ord"), ["id"]).collect()} >= {("a", 1), ("b", 2)}


def test_table_versions(spark, tmp_path):
    t = sync.Table(spark, str(tmp_path / "t"), ["id"])
    assert t.read() is None
    t.merge(spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"))
    t.merge(spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int"))
    assert t.delete(spark.createDataFrame([("a",), ("q",)], "id string")) == 1
    assert {tuple(r) for r in t.read().collect()} == {("b", 3), ("c", 4)}


def test_formats(graph):
    text = formats.render(graph.nodes, "markdown")
    assert text.startswith("## Relevant Code Context\n\n### main.py\n\n**File: main.py** (lines 1-3)\n\n```python\npass\n```\n")
    assert "<![CDATA[pass]]>" in formats.render(graph.nodes, "xml") and "# utils.py:1\npass\n" in formats.render(graph.nodes, "plain")
    assert '"file_path": "main.py"' in formats.render(graph.nodes.withColumn("score", F.lit(1.0)), "json")
    assert len(formats.render(graph.nodes, "plain", 20)) == 20


def test_plugins(graph):
    n = graph.nodes.withColumns({"distance": F.col("ord"), "tokens": F.lit(10)})
    assert plugins.choose("context").rank_nodes(n, "", 200).count() == 2
    best = plugins.choose("context", {"context": {"name": "weighted"}}).rank_nodes(n, "config helper", 25).collect()
    assert len(best) == 2 and "context:basic" in plugins.capabilities()


def test_density_clusters():
    rnd = np.random.default_rng(0)
    x = np.concatenate([rnd.normal(0, 0.1, (30, 2)), rnd.normal(5, 0.1, (30, 2)), [[50.0, 50.0]]])
    found = clustering.density_labels(x, 5)
    assert len(set(found[:30]) - {-1}) == 1 and len(set(found[30:60]) - {-1}) == 1 and set(found[:30]) & set(found[30:60]) <= {-1} and found[60] == -1


def test_kmeans_and_silhouette(spark):
    rows = [(i, [float(i % 2) * 10 + i * 0.01, 0.0]) for i in range(40)]
    v = spark.createDataFrame(rows, "id int, embedding array<float>")
    c = clustering.kmeans(v, 2, starts=2)
    assert {frozenset(r.id % 2 for r in c.where(f"cluster = {k}").collect()) for k in (0, 1)} == {frozenset([0]), frozenset([1])}
    assert clustering.silhouette(c) > 0.9 and clustering.silhouette(v.withColumn("cluster", F.lit(0))) == 0.0


def test_silhouette_is_euclidean(spark):
    rnd = np.random.default_rng(2)
    x, c = rnd.normal(size=(60, 3)), rnd.integers(0, 3, 60)
    x[:5] = x[0]
    c[59] = 7  # alone in its cluster: counts as 0
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    each = []
    for i in range(60):
        own = (c == c[i]) & (np.arange(60) != i)
        a, b = d[i, own].mean() if own.any() else None, min(d[i, c == k].mean() for k in set(c.tolist()) - {c[i]})
        each.append(0.0 if a is None else (b - a) / max(a, b))
    v = spark.createDataFrame([(x[i].tolist(), int(c[i])) for i in range(60)], "embedding array<double>, cluster int")
    assert abs(clustering.silhouette(v) - np.mean(each)) < 1e-7


def test_walks_end_without_a_bound(spark):
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "CALLS", i) for i in range(12)] + [("n12", "n0", "CALLS", 12)], "source string, target string, type string, ord long")
    assert traverse.reach(traverse.arcs(chain), spark.createDataFrame([("n0",)], "id string")).count() == 13
    assert len(traverse.shortest_path(chain, "n0", "n6")) == 7


def test_deleted_snapshots_are_gone(spark, tmp_path):
    n, root = spark.range(3), str(tmp_path)
    for sha in ("a", "b"):
        sync.write_snapshot(n, n, root, "r", sha)
    assert sync.delete_snapshot(spark, root, "r", "a") and not sync.delete_snapshot(spark, root, "r", "a")
    assert [x.sha for x in sync.list_snapshots(spark, root).collect()] == ["b"]
    assert sync.read_snapshot(spark, root, "r", "b")[0].count() == 3


def test_services_are_unique_by_id_and_repository(spark, tmp_path):
    r = sync.Services(spark, str(tmp_path / "services"))
    rows = lambda *x: spark.createDataFrame(x, "ord long, service_id string, name string, repo_id string, description string")
    r.save(rows((1, "s1", "b", "r1", None), (2, "s2", "a", "r2", None), (3, "s3", "c", "r3", None)))
    assert [x.service_id for x in r.list().collect()] == ["s2", "s1", "s3"]
    r.save(rows((1, "s1", "x", "r2", "both go"), (2, "s4", "d", "r1", None), (3, "s4", "e", "r4", None)))
    assert [(x.service_id, x.repo_id) for x in r.list().collect()] == [("s3", "r3"), ("s4", "r4"), ("s1", "r2")]
    assert r.update("s1", name="y") and not r.update("s2", name="y")
    assert [tuple(x) for x in r.by_id("s1").collect()] == [("s1", "y", "r2", "both go")] == [tuple(x) for x in r.by_repo("r2").collect()]
    assert r.delete("s1") and not r.delete("s1") and r.by_repo("r2").isEmpty()


def test_default_entries(graph):
    assert [x.id for x in graph.entry_points().collect()] == ["main.py", "main.py::main"]
