"""Work that grows with the tables is dealt over tasks, and no step holds or moves more than its share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import adjacency, clustering, density, diff, extract, impact, lookup, recalc, sync, traverse, vector_index
from graphloom.plans import filters  # noqa: F401
from graphloom.plans.registry import QUERIES
from graphloom.sources import graph
from graphloom import scratch


@pytest.mark.parametrize("parsed", [extract.rows, recalc.references])
def test_sources_made_from_one_partition_are_parsed_by_several_tasks(spark, monkeypatch, parsed):
    monkeypatch.setattr(extract, "TASK_FILES", 50)
    files = spark.range(400).coalesce(1).selectExpr("concat('p/m', id, '.py') AS path", "CAST(concat('def f', id, '(x):\\n    return g(x)\\n') AS BINARY) AS content")
    found = parsed(files)
    tasks = found.select(F.spark_partition_id().alias("t")).distinct().count()
    assert found.rdd.getNumPartitions() == 8 and tasks > 4
    assert found.count() == 400 * (5 if parsed is extract.rows else 2)


def test_a_complexity_report_parses_each_file_once(spark):
    parsed, files = spark.sparkContext.accumulator(0), spark.range(300).selectExpr("concat('p/m', id, '.py') AS path", "CAST(concat('def f', id, '(x):\\n    return g(x)\\n') AS BINARY) AS content")

    def counted(batches):
        for b in batches:
            parsed.add(b.num_rows)
            yield b

    rows = extract.rows(files)
    r = recalc.complexity_report(rows.mapInArrow(counted, rows.schema)).first()
    assert (r.n_files, r.n_functions) == (300, 300) and parsed.value == 300 * 5


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_distances_by_products_are_the_exact_ones(monkeypatch, shift):
    """Only distances that can count are worked out one by one: nearest ones and edges equal those of all distances to the last bit."""
    rnd = np.random.default_rng(3)
    x, y = rnd.normal(size=(300, 32)) + shift, rnd.normal(size=(400, 32)) + shift
    y[:50] = x[:50]  # copies
    y[50:60] = x[0]
    far, core, o_core = density.distances(x, y), rnd.random(300) * 7, rnd.random(400) * 7
    comp, o_comp, theirs = rnd.integers(0, 5, 300), rnd.integers(0, 5, 400), np.arange(1000, 1400)
    reach = np.maximum(far, np.maximum(core[:, None], o_core[None, :]))
    reach[comp[:, None] == o_comp[None, :]] = np.inf
    worked = []
    for name in ("of_pairs", "distances"):
        monkeypatch.setattr(density, name, lambda *a, f=getattr(density, name): worked.append(out := f(*a)) or out)
    best = density._nearer(density._nearer(np.full((300, 5), np.inf), x, y[:200]), x, y[200:])
    assert (best == np.sort(far, axis=1)[:, :5]).all()
    rows, to, w = density._leaving(x, y, core, o_core, comp, o_comp, theirs, np.full(300, np.inf))
    assert (rows == np.arange(300)).all() and (to == reach.argmin(axis=1)).all() and (w == reach.min(axis=1)).all()
    assert shift or sum(o.size for o in worked) < far.size / 4
    assert np.abs(density.euclidean(x, y) - far).max() < (1e-9 if not shift else 1e-3) and (density.euclidean(x, y)[far == 0] == 0).all()


def test_each_pair_of_blocks_meets_once_in_a_silhouette(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    x, c = rnd.normal(size=(90, 3)).round(1), rnd.integers(0, 4, 90)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    each = []
    for i in range(90):
        a, b = far[i, c == c[i]].sum() / max((c == c[i]).sum() - 1, 1), min(far[i, c == o].mean() for o in set(c) - {c[i]})
        each.append(0 if (c == c[i]).sum() < 2 else (b - a) / max(a, b))
    monkeypatch.setattr(clustering, "BLOCK", 7)
    monkeypatch.setattr(clustering, "SIDE", 2)
    v = spark.createDataFrame([(int(k), r.tolist()) for k, r in zip(c, x, strict=True)], "cluster int, embedding array<double>")
    assert clustering.silhouette(v) == pytest.approx(np.mean(each), abs=1e-9)


def test_a_walk_over_tables_writes_no_graph(spark, tmp_path):
    """Edges are scanned for a frontier, and equal those of the stored graph."""
    edges = spark.createDataFrame([(f"v{i}", f"v{j}", "CALLS", 1, i * 40 + j) for i in range(40) for j in (i * 7 % 40, (i + 3) % 40)], "source string, target string, type string, line int, ord long")
    nodes = spark.createDataFrame([(f"v{i}", f"p{i // 2}", i) for i in range(40)] + [("v0", "p30", 40)], "id string, path string, ord long")
    edges.write.parquet(str(tmp_path / "t"))
    scanned = adjacency.opened(spark, "scanned", [str(tmp_path / "t")], lambda: nodes, lambda: spark.read.parquet(str(tmp_path / "t")))
    stored = adjacency.Adjacency(nodes, edges, str(tmp_path / "graph"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    for way in traverse.DIRECTIONS:
        assert [rows(x) for x in traverse.khop(scanned, "v3", 3, way)] == [rows(x) for x in traverse.khop(stored, "v3", 3, way)]
    assert rows(impact.direct(scanned, None, ["p1", "p2"])) == rows(impact.direct(stored, None, ["p1", "p2"]))
    assert rows(impact.closure(scanned, None, ["p1"], None)) == rows(impact.closure(stored, None, ["p1"], None))
    assert not any(t.ready() for t in scanned._stored.values()) and all(t.ready() for t in stored._stored.values())


def test_a_sample_comes_from_few_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "FIT_ROWS", 50)
    rows = spark.range(4000).repartition(20)
    tops = []
    order = type(rows).orderBy
    monkeypatch.setattr(type(rows), "orderBy", lambda df, *c: tops.append(df.count()) or order(df, *c))
    got = {r.id for r in vector_index._sampled(rows, 4000).collect()}
    assert got == {r.id for r in order(rows, F.xxhash64("id"), "id").limit(50).collect()}
    assert tops[0] < 200
    assert vector_index._sampled(spark.range(30), 30).count() == 30 and vector_index._sampled(spark.range(0), 0).count() == 0
    assert vector_index._sampled(spark.range(1, 2).crossJoin(spark.range(4000).select(F.lit(1))).select("id"), 4000).count() == 50  # one id


def test_hubs_with_the_same_users_do_not_multiply(spark, monkeypatch):
    """25 files that use the same 25, each used by 200: pairs equal plain ones, and no join makes more rows than there are pairs."""
    pairs = [(f"n{i}", f"b{j}") for i in range(25) for j in range(25)] + [(f"b{j}", f"c{k}") for j in range(25) for k in range(200)] + [("r", f"n{i}") for i in range(25)]
    pairs += [("c7", "n3"), ("c8", "c9"), ("c9", "c8")]
    want = set(pairs) | {(a, d) for a, b in pairs for c, d in pairs if b == c and a != d}
    unions = []
    union = type(spark.range(0)).union
    monkeypatch.setattr(type(spark.range(0)), "union", lambda a, b: unions.append(b.count()) or union(a, b))
    got = impact.within_two(spark.createDataFrame(pairs, "changed string, by_path string")).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert unions[0] < 2 * len(want)


@pytest.mark.parametrize("changes", [diff.edge_changes, sync.edge_changes])
def test_edges_are_compared_in_shares_that_do_not_grow(spark, monkeypatch, changes):
    monkeypatch.setattr(scratch, "KEYED_ROWS", 100)
    e = spark.range(2000).coalesce(1).selectExpr("concat('a', id) AS source", "'b' AS target", "'CALLS' AS type", "1 AS line", "id AS ord")
    found = changes(e.where("ord % 10 <> 0"), e.where("ord % 7 <> 0"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [source" in plan and ", 36" in plan  # 1800 and 1714 rows
    counts = [found.where(f"change = '{c}'").count() for c in ("added", "removed")] if "change" in found.columns else list(found.first()[:2])
    assert counts == [171, 257]


@pytest.mark.parametrize("name, wanted", [("integrity_dangling", False), ("integrity_valid", True)])
def test_targets_are_looked_up_in_shares_that_do_not_grow(spark, sf_dir, monkeypatch, name, wanted):
    monkeypatch.setattr(scratch, "KEYED_ROWS", 1000)
    found, n, e = QUERIES[name](spark, sf_dir), graph.nodes(spark, sf_dir), graph.edges(spark, sf_dir)
    rows, kept = graph.n_rows(spark, sf_dir), {r.id for r in n.where("ord % 5 <> 0").collect()}
    assert n.count() + e.count() <= rows < 1.5 * (n.count() + e.count())
    assert found.rdd.getNumPartitions() == -(-rows // 1000) > 10
    want = sorted(tuple(r)[:4] for r in e.collect() if (r.target in kept) == wanted)
    assert sorted(map(tuple, found.collect())) == want and want


@pytest.mark.parametrize("rows", [None, 500])
def test_repeated_and_missing_ids_are_looked_up_once(spark, monkeypatch, rows):
    monkeypatch.setattr(scratch, "KEYED_ROWS", 100)
    nodes = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "id string")
    edges = spark.createDataFrame([("x", "a", 1), ("x", "a", 1), ("a", "c", 2), (None, "b", 3), ("x", None, 4)], "source string, target string, line int")
    edges = edges.union(edges.where("line < 3"))
    got = [sorted(r.line for r in f(edges, nodes, rows).collect()) for f in (lookup.valid_edges, lookup.dangling_edges)]
    assert got == [[1, 1, 1, 1, 3], [2, 2, 4]]
    assert lookup.valid_edges(edges, nodes, rows).columns == ["target", "source", "line"]


def test_pairs_of_parts_and_suppliers_are_told_apart_in_shares_that_do_not_grow(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(scratch, "KEYED_ROWS", 500)
    pairs = graph.edges(spark, sf_dir).where("source LIKE 'p:%'")
    assert "RepartitionByExpression [l_partkey" in (plan := pairs._jdf.queryExecution().optimizedPlan().toString()) and ", 12" in plan  # 6000 lines
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    want = {(f"p:{r.l_partkey}", f"s:{r.l_suppkey}") for r in lines.collect()}
    got = [tuple(r) for r in pairs.select("source", "target").collect()]
    assert len(got) == len(want) and set(got) == want


def test_an_induced_graph_is_cut_in_shares_that_do_not_grow(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(scratch, "KEYED_ROWS", 1000)
    found, e = QUERIES["induced_subgraph"](spark, sf_dir), graph.edges(spark, sf_dir)
    assert found.rdd.getNumPartitions() == -(-graph.n_rows(spark, sf_dir) // 1000)
    kept = {r.id for r in graph.nodes(spark, sf_dir).where("type <> 'function'").collect()}
    want = sorted((r.source, r.target, r.type) for r in e.collect() if r.source in kept and r.target in kept)
    assert sorted(map(tuple, found.collect())) == want and want
