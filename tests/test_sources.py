"""File, git, graph JSON and configuration sources."""

import json
import subprocess

from pyspark.sql import functions as F

from graphloom.api import CodeGraph
from graphloom.operators import extract, services
from graphloom.operators.usage import blame
from graphloom.sources import files, git, graph


def test_scan_ignores_and_parses(spark, tmp_path):
    for p, t in {"main.py": "import utils\n\ndef main():\n    utils.helper()\n    run(inner())\n", "utils.py": "def helper():\n    pass\n", "pkg/__init__.py": "", "pkg/sub.py": "from . import x\nfrom .sib import y\nclass A(B):\n    def m(self):\n        def nested():\n            pass\n        helper()\n", "pkg/sib.py": "class B: pass", "venv/x.py": "a = 1", "bad.py": "def (", "gen/skip.py": "x = 1", "a.txt": "no"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    found = files.scan(spark, str(tmp_path), files.ignore_patterns(["gen/"]))
    assert {r.path for r in found.collect()} == {"main.py", "utils.py", "pkg/__init__.py", "pkg/sub.py", "pkg/sib.py", "bad.py"}
    parsed = extract.rows(found)
    nodes = {(r.type, r.id) for r in extract.nodes(parsed).collect()}
    assert ("function", "A::m") in nodes and ("class", "B") in nodes and ("file", "bad.py") in nodes
    assert ("function", "A::nested") not in nodes
    edges = {(r.source, r.target, r.type) for r in extract.edges(parsed).collect()}
    assert ("main.py", "utils.py", "IMPORTS") in edges and ("pkg/sub.py", "pkg/sib.py", "IMPORTS") in edges
    assert ("main", "utils.helper", "CALLS") in edges and ("main", "run", "CALLS") in edges and ("main", "inner", "CALLS") not in edges
    g = CodeGraph.analyze(spark, str(tmp_path), files.ignore_patterns(["gen/"]))
    assert {(r.source, r.target) for r in g.edges.where("type = 'CALLS'").collect()} == {("A::m", "helper")}
    assert {r.a: r.b for r in extract.predicted_uses(parsed).where("a = 'utils.py'").collect()}


def test_gitignore_patterns(spark):
    paths = ["a.py", "build/x.py", "src/build/y.py", "src/gen_1.py", "docs/a/b.md", "keep/gen_2.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    left = {r.path for r in df.where(~files.ignored(F.col("path"), ["build/", "gen_*.py", "!keep/gen_2.py", "/docs/**/*.md"])).collect()}
    assert left == {"a.py", "keep/gen_2.py"}


def test_text_decoding(spark):
    df = spark.createDataFrame([("u", "é".encode()), ("l", "é".encode("latin-1")), ("b", b"a\0b")], "path string, content binary")
    assert {r.path: r.t for r in df.select("path", files.text_of(F.col("content")).alias("t")).collect()} == {"u": "é", "l": "é", "b": None}


def test_config_layers(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"context": {"depth": 4}}))
    c = files.load_config(str(p), {"GRAPHLOOM__CONTEXT__MAX_NODES": "7", "GRAPHLOOM__ANALYZER__IGNORE": "a, b", "OTHER": "1"}, cli={"context": {"format": "xml"}})
    assert c["context"] == {"depth": 4, "max_nodes": 7, "format": "xml"} and c["analyzer"]["ignore"] == ["a", "b"]


def test_git_rows(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A B", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("one\ntwo\nthree\n")
    (tmp_path / "b.py").write_text("x\n" * 20)
    run("add", "."), run("commit", "-qm", "1")
    (tmp_path / "a.py").write_text("one\nTWO\nthree\nfour\n")
    run("mv", "b.py", "c.py"), run("add", "."), run("commit", "-qm", "2")
    raw = git.lines(spark, git.run(str(tmp_path), "diff", "--name-status", "-M", "HEAD~1", "HEAD"))
    assert {(r.path, r.change_type) for r in git.name_status(raw).collect()} == {("a.py", "modified"), ("b.py", "modified"), ("c.py", "modified")}
    assert ("c.py", "renamed", "b.py") in {tuple(r) for r in git.name_status(raw, False).collect()}
    assert tuple(git.diff_stats(git.lines(spark, git.run(str(tmp_path), "diff", "--stat", "HEAD~1", "HEAD"))).first()) == (2, 2, 1)
    diff = git.lines(spark, git.run(str(tmp_path), "diff", "HEAD~1", "HEAD", "--", "a.py"))
    assert {tuple(r) for r in git.changed_lines(diff).collect()} == {("removed", 2), ("added", 2), ("added", 4)}
    lines = git.blame_lines(git.lines(spark, git.run(str(tmp_path), "blame", "--line-porcelain", "a.py")))
    b = blame(lines.withColumn("file", F.lit("a.py"))).first()
    assert b.primary_author == "A B" and b.author_distribution == {"A B": 4}
    assert git.commits(spark, str(tmp_path)).where("path = 'a.py'").count() == 2 and len(git.head(spark, str(tmp_path)).first().sha) == 40


def test_graph_json_round_trip(spark, tmp_path, sf_dir):
    n = graph.nodes(spark, sf_dir).where("type = 'file'").withColumn("graph_id", F.lit("g"))
    e = graph.edges(spark, sf_dir).where("type = 'EXTENDS'").withColumn("graph_id", F.lit("g"))
    graph.write_json(n, e, str(tmp_path / "g"), "1", "repo")
    _, n2, e2 = graph.read_json(spark, str(tmp_path / "g"))
    assert [r.id for r in n2.orderBy("ord").collect()] == [r.id for r in n.orderBy("ord").collect()]
    assert e2.count() == e.count()


def test_service_patterns(spark):
    py = ['requests.get("http://user-service:8080/api/users")', 'grpc.client.stub("order-service:50051")', 'producer.send(topic="notification-events")', "from billing.client import x", 'requests.post("http://web-app/x")']
    df = spark.createDataFrame([("a.py", i, t) for i, t in enumerate(py)], "path string, line int, text string")
    got = sorted((r.service, r.kind) for r in services.scan(df, "py", F.lit("web-app")).collect())
    assert got == [("billing", "import"), ("notification", "kafka"), ("order-service", "grpc"), ("order-service", "grpc"), ("user-service", "http")]
    ts = ['import x from "@pay/client"', 'axios.get("http://gateway.example.com/a")', 'import y from "./local"']
    df = spark.createDataFrame([("a.ts", i, t) for i, t in enumerate(ts)], "path string, line int, text string")
    assert sorted(r.service for r in services.scan(df, "ts", F.lit("me")).collect()) == ["gateway", "pay"]


def test_a_nul_byte_anywhere_is_binary(spark):
    rows = [(b"P\nabc\x00def",), (b"\x50\x0a\x0b\x00",), (b"\x10\x01P\x00",), (b"plain P\x10\x0a text",), (b"\x00",), (b"",)]
    df = spark.createDataFrame(rows, "content binary")
    assert [r[0] for r in df.select(files.is_binary(F.col("content"))).collect()] == [True, True, True, False, True, False]
