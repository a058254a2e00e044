"""Embedding with failures, the search modes, local context, analyzers, recalculated references, metrics."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import plugins
from graphloom.api import CodeGraph
from graphloom.operators import embed, extract, metrics, recalc, search, vector_index

TEXTS = ["open the file", "open the door", "", None, "close the file and the door " * 50, "bad", "zebra"]


class Flaky:
    """Fails its first calls, and always on texts with ``bad``."""

    def __init__(self, failures):
        self.failures = failures

    def __call__(self, texts):
        if self.failures:
            self.failures -= 1
            raise ConnectionError("busy")
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [[float(len(t)), 1.0] for t in texts]


def test_embedding_retries_and_keeps_failed_rows(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").coalesce(1)
    got = {r.id: (r.embedding, r.error) for r in embed.embed(df, embedder=Flaky(2), batch=4, wait=0.0).collect()}
    assert got[3] == (None, None)
    assert got[5] == (None, "ValueError: refused")
    assert {i: v[0] for i, (v, e) in got.items() if i not in (3, 5)} == {i: float(len(TEXTS[i])) for i in (0, 1, 2, 4, 6)}
    never = embed.embed(df, embedder=Flaky(10**6), wait=0.0).where("text IS NOT NULL").collect()
    assert {(r.embedding, r.error) for r in never} == {(None, "ConnectionError: busy")}
    with pytest.raises(RuntimeError, match="0 vectors"):
        embed.embed_query("x", lambda t: [], wait=0.0)


def test_truncation_and_wrong_number_of_vectors(spark):
    df = spark.createDataFrame([("x" * 100,)], "text string")
    assert embed.embed(df, embedder=Flaky(0), truncate=embed.CharacterTruncation(10)).first().embedding[0] == 40
    assert embed.embed(df, embedder=Flaky(0)).first().embedding[0] == 100
    assert embed.embed_texts(lambda t: [], ["a"], wait=0.0)[0][1].startswith("ValueError: 0 vectors")
    with pytest.raises(ValueError, match="already"):
        embed.embed(df.withColumn("error", F.lit(1)))


def hashed(text, dim=64):
    out = np.zeros(dim)
    for w in re.findall("[a-z0-9_]+", text.lower()):
        out[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % dim] += 1
    return out


def test_semantic_search_is_the_top_of_all_chunks(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, "file" if i % 4 == 0 else "function", f"n{i}", f"src/{'a' if i % 2 else 'b'}/m{i % 7}.{'py' if i % 3 else 'rs'}", " ".join(rng.choice(words[: 5 + i % 25], 20))) for i in range(300)]
    rows += [(1000 + i, *rows[i][1:]) for i in range(0, 300, 10)]  # copies are ties
    chunks = spark.createDataFrame(rows, "k long, type string, name string, file_path string, content string")
    index = vector_index.VectorIndex(spark, str(tmp_path / "i")).build(embed.embed(chunks.selectExpr("k", "content AS text")), "k", 9)
    text = rows[7][4]
    q = hashed(text)
    score = {r[0]: round(float(hashed(r[4]) @ q / np.linalg.norm(hashed(r[4])) / np.linalg.norm(q)), 12) for r in rows}
    best = [r for r in sorted(rows, key=lambda r: (-score[r[0]], r[0]))[:40] if score[r[0]] >= 0.7]
    want = [r[3] if r[1] == "file" else f"{r[3]}::{r[2]}" for r in best if r[3].endswith(".py") and "/a/" in r[3]][:20]
    got = search.semantic(chunks, "k", index, text, 20, [".py"], ["/a/"]).orderBy("rank").collect()
    assert [r.fqn for r in got] == want and len(want) > 5
    assert [r["rank"] for r in got] == list(range(1, len(want) + 1))
    near = spark.createDataFrame([(want[0],), ("far::away",)], "fqn string")
    h = search.hybrid(near, chunks, "k", index, text, 5).orderBy("rank").collect()
    top = max(score[r[0]] for r in rows if (r[3] if r[1] == "file" else f"{r[3]}::{r[2]}") == want[0])
    assert h[0].fqn == want[0] and h[0].score == pytest.approx(0.4 + 0.6 * top)
    assert all(a.score >= b.score for a, b in zip(h, h[1:], strict=False))


GRAPH = [("a.py", "file", "a.py", "a.py", 0, None), ("a.py::get", "function", "get", "a.py", 1, "Gets."), ("K", "class", "getter_of_k", "b.py", 2, None), ("b.py", "file", "b.py", "b.py", 3, None), ("x", "function", "x", "get/b.rs", 4, None)]


def graph(spark):
    n = spark.createDataFrame(GRAPH, "id string, type string, name string, path string, ord long, docstring string")
    e = spark.createDataFrame([("a.py", "b.py", "IMPORTS", 1, 0), ("a.py::get", "K", "CALLS", 2, 1), ("K", "x", "CALLS", 3, 2), ("a.py", "gone", "IMPORTS", 4, 3)], "source string, target string, type string, line int, ord long")
    return CodeGraph(n, e)


def test_graph_search_and_modes(spark):
    g = graph(spark)
    got = g.find("GET", "graph").orderBy("rank").collect()
    assert [(r.fqn, r.score, r.snippet) for r in got] == [("K", 0.8, "class: getter_of_k"), ("a.py::get", 0.8, "Gets."), ("x", 0.8, "function: x")]
    assert [r.fqn for r in g.find("get", "graph", 1, file_types=[".rs"]).collect()] == ["x"]
    assert g.find("nothing", "graph").count() == 0
    with pytest.raises(ValueError, match="mode"):
        g.find("get", "other")
    with pytest.raises(ValueError, match="chunks"):
        g.find("get", "semantic")


def test_filters_of_paths(spark):
    paths = spark.createDataFrame([("a.py",), ("Makefile",), ("x/b.test.py",), (None,)], "p string")
    keep = lambda *a: [r.p for r in paths.where(search.matches(F.col("p"), *a)).collect()]
    assert keep([".py"]) == ["a.py", "x/b.test.py"]
    assert keep([], ["x/", "Make"]) == ["Makefile", "x/b.test.py"]
    assert len(keep()) == 4


def test_local_context(spark, tmp_path):
    for g in (graph(spark), graph(spark).stored(str(tmp_path / "g"))):
        n, e = g.local_context(["K", "a.py"])
        assert [(r.id, r.relevance) for r in n.orderBy(F.desc("relevance"), "id").collect()] == [("K", 1.0), ("a.py", 1.0), ("a.py::get", 0.8), ("b.py", 0.8), ("x", 0.8)]
        assert {(r.source, r.target) for r in e.collect()} == {("a.py", "b.py"), ("a.py::get", "K"), ("K", "x")}
        assert [r.id for r in g.local_context(["K", "a.py"], 3)[0].where("relevance < 1").collect()] == ["a.py::get"]
        with pytest.raises(LookupError, match="nope"):
            g.local_context(["K", "nope"])


SOURCE = b"""import os, sys as s
from .m import b

class A(base.B, C, x.y.Z):
    def go(self):
        class Inner(D):
            def no_node(self): f(1)
        self.run(); a.b.c()
        return [g(i) for i in os.walk(1)]

async def top():
    def inner(): h()
    inner()
"""


def test_recalculated_references(spark):
    files = spark.createDataFrame([("p/m.py", SOURCE), ("bad.py", b"def ("), ("empty.py", None)], "path string, content binary")
    e, missing = recalc.recalculated(files, spark.createDataFrame([("C",), ("f",), ("os",)], "id string"))
    got = {}
    for r in e.collect():
        got.setdefault(r.source, set()).add((r.target, r.type, r.line))
    go = {("f", "CALLS", 7), ("self.run", "CALLS", 8), ("g", "CALLS", 9), ("os.walk", "CALLS", 9), ("D", "EXTENDS", 6)}
    cls = go | {("base.B", "EXTENDS", 4), ("C", "EXTENDS", 4)}
    top = {("inner", "CALLS", 13), ("h", "CALLS", 12)}
    assert got == {"p/m.py": cls | top | {("os", "IMPORTS", 1), ("sys", "IMPORTS", 1), ("m.b", "IMPORTS", 2)}, "A": cls, "A::go": go, "Inner": {("f", "CALLS", 7), ("D", "EXTENDS", 6)}, "top": top}
    ids = {r.id for r in extract.nodes(extract.rows(files)).where("path = 'p/m.py'").collect()}
    assert set(got) <= ids
    assert {r.id for r in missing.collect()} == {t for v in got.values() for t, _, _ in v} - {"C", "f", "os"}


def test_complexity_report_without_functions(spark):
    files = spark.createDataFrame([("a.py", b"x = 1"), (".hid/b.py", b"def f(): pass"), ("venv/c.py", b"def f(): pass"), ("t.txt", b"")], "path string, content binary")
    r = recalc.complexity_report(extract.rows(files)).first()
    assert (r.n_files, r.n_functions, r.average, r.most, r.hotspots) == (1, 0, 0.0, 0, [])
    assert r.ranks == dict.fromkeys("ABCDEF", 0)
    assert recalc.complexity_report(extract.rows(files.limit(0))).first().n_files == 0


def test_analyzers_by_language(spark):
    @plugins.analyzer
    class Lines:
        language, suffixes = "lines", (".txt",)

        def analyze(self, files):
            n = files.select(F.col("path").alias("id"), F.lit("file").alias("type"), F.col("path").alias("name"), "path")
            return n, n.select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit("IMPORTS").alias("type"), F.lit(1).alias("line"))

    try:
        files = spark.createDataFrame([("p/m.py", SOURCE), ("n.txt", b"x"), ("o.rs", b"")], "path string, content binary")
        n, e = plugins.analyze_all(files)
        assert {r.path for r in n.collect()} == {"p/m.py", "n.txt"} and e.where("source = 'n.txt'").count() == 1
    finally:
        del plugins._ANALYZERS["lines"]
    py = plugins.PythonAnalyzer()
    assert {r.id for r in py.analyze_file(files, "p/m.py").collect()} == {"p/m.py", "A", "Inner", "A::go", "top"}
    assert {r.target for r in py.resolve_references(files, spark.createDataFrame([("top",)], "id string")).collect()} == {"inner", "h"}


def test_metrics(spark):
    rows = [("requests_total", {"endpoint": "e", "method": "GET", "other": "x"}, 2.0, 1, 1), ("requests_total", {"endpoint": "e", "method": "GET"}, 3.0, 2, 2), ("graph_nodes_total", {"graph_id": "g"}, 7.0, 5, 1), ("graph_nodes_total", {"graph_id": "g"}, 4.0, 5, 2)]
    rows += [("analysis_duration_seconds", {"repo_name": "r"}, v, 1, i) for i, v in enumerate([0.01, 0.011, 99.0, None])] + [("unknown", {}, 1.0, 1, 1), (None, None, 1.0, 1, 1), ("graphs_created_total", None, 1.0, 1, 1)]
    got = {(r.metric, r.labels, r.series): r.value for r in metrics.exposition(spark.createDataFrame(rows, "metric string, labels map<string, string>, value double, ts long, ord long")).collect()}
    h = {k[2]: v for k, v in got.items() if k[0] == "analysis_duration_seconds"}
    assert got[("requests_total", 'endpoint="e",method="GET",status=""', "value")] == 5
    assert got[("graph_nodes_total", 'graph_id="g"', "value")] == 4 and got[("graphs_created_total", "", "value")] == 1
    assert (h["le=0.005"], h["le=0.01"], h["le=0.025"], h["le=10.0"], h["le=+Inf"], h["count"], h["sum"]) == (0, 1, 2, 2, 3, 3, pytest.approx(99.021))
    assert len(got) == 3 + 17


def test_prompt_trees_and_counts(spark, tmp_path):
    from graphloom.operators import budget, formats, sync

    g = graph(spark)
    n = g.nodes.where("path <> 'get/b.rs'").withColumns({"relevance": F.lit(0.5), "content": F.when(F.col("id") == "K", "class K: pass")})
    text = formats.prompt(n, g.edges, available=9)
    assert text.startswith("## Relevant Code Context\n\n### File Structure\n\n#### a.py\n- **file**: a.py (relevance: 0.50)\n- **function**: a.py::get (relevance: 0.50)\n\n#### b.py\n- **class**: K (relevance: 0.50)\n  ```python\nclass K: pass\n  ```\n- **file**: b.py")
    assert "\n### Dependencies\n\n- `a.py` **IMPORTS** `b.py`\n  (line 1)\n\n- `a.py` **CALLS** `b.py`\n  (line 2)\n\n\n*Note: Context truncated. Total nodes available: 9*" in text
    assert text.count("gone") == 0 and "- **Code**:\n```python\nclass K: pass\n```\n" in text
    short = formats.prompt(n, g.edges, max_chars=60)
    assert short == text[:57] + "..."
    assert formats.prompt(n.limit(0), g.edges) == "## Relevant Code Context\n"
    assert formats.impact_tree(g.edges, g.nodes, "x") == "🎯 Impact Analysis: x\n\n   1 direct dependents:\n   └── getter_of_k\n       └── get"
    assert formats.impact_tree(g.edges, g.nodes, "a.py").endswith("   No dependents found (this is a leaf node)")
    both = spark.createDataFrame([("b", "a", "CALLS", 1, 0), ("c", "a", "CALLS", 1, 1), ("c", "b", "CALLS", 1, 2), ("a", "c", "CALLS", 1, 3)], g.edges.schema)
    assert formats.impact_tree(both, g.nodes, "a").split("\n")[2:] == ["   2 direct dependents:", "   ├── b", "   │   └── c"]
    assert formats.summary_lines(g.nodes, g.edges, "r", 1).first().text == "📊 r - Dependency Summary\n   Total: 2 files, 4 edges\n\nTop connected files:\n   └── a.py (0↓ 2↑)\n   ... and 1 more files"
    rest, gone = sync.without_touching(g.edges, "K")
    assert (rest.count(), gone) == (2, 2) and sync.without_touching(g.edges, "K", True)[1] == 1
    c = spark.createDataFrame([(1, 1, 0.5, 400), (2, 1, 0.5, 10)], "req long, ord long, score double, tokens long")
    r = {x.req: x for x in budget.allocation_report(c, c.where("req = 2"), 0).collect()}
    assert (r[1].nodes_excluded, r[1].token_savings, r[1].truncation_rate) == (1, 400, 0.0) and (r[2].truncation_rate, r[2].budget_used_pct) == (100.0, 0.0)
    with pytest.raises(ValueError, match="limit is 1 to 100"):
        g.find("x", "graph", 0)


def test_graph_by_id(spark, tmp_path):
    from graphloom.sources import graph as source

    n = spark.createDataFrame([("g1", "a", "file", "a", "a", 0), ("g2", "b", "file", "b", "b", 0)], "graph_id string, id string, type string, name string, path string, ord int")
    e = spark.createDataFrame([("g1", "a", "a", "CALLS", 1, 0)], "graph_id string, source string, target string, type string, line int, ord int")
    for k in ("g1", "g2"):
        source.write_json(n.where(F.col("graph_id") == k), e.where(F.col("graph_id") == k), str(tmp_path / f"all/{k}.d"), k, "r")
    path = str(tmp_path / "all/*.d")
    ids = {r.version: r.graph_id for r in source.read_json(spark, path)[0].collect()}
    _, nodes, edges = source.load(spark, path, ids["g1"])
    assert [r.id for r in nodes.collect()] == ["a"] and edges.count() == 1
    assert source.load(spark, path, ids["g2"])[2].count() == 0
    with pytest.raises(LookupError, match="no graph"):
        source.load(spark, path, "other")
