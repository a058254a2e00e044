"""Incremental updates against a full rebuild, on random edit scripts."""

import random

import pytest

from graphloom.operators import incremental

FILES = "path string, content binary"
CHANGES = "path string, change_type string, old_path string"


def text(rnd, names):
    lines = []
    for m in rnd.sample(names, min(3, len(names))):
        lines.append(rnd.choice([f"import {m}", f"from .{m.split('.')[-1]} import x", f"import {m}, pkg.other", f"from {m} import y"]))
    for i in range(rnd.randrange(3)):
        lines += [f"class K{rnd.randrange(6)}(K{rnd.randrange(6)}):", f"    def go{i}(self):", f"        f{rnd.randrange(8)}()", ""]
    for _ in range(rnd.randrange(3)):
        lines += [f"def f{rnd.randrange(8)}():", f"    f{rnd.randrange(8)}(); f{rnd.randrange(8)}()", ""]
    return "def broken(:\n" if rnd.random() < 0.06 else "\n".join(lines)


def edited(rnd, files, names):
    """New state, changes."""
    new, changes = dict(files), []
    for path in rnd.sample(sorted(files), 4):
        kind = rnd.choice(["modified", "deleted", "renamed"])
        if kind == "modified":
            new[path] = text(rnd, names)
            changes.append((path, kind, None))
        else:
            del new[path]
            if kind == "deleted":
                changes.append((path, kind, None))
            else:
                to = f"{rnd.choice(['pkg', 'lib', 'pkg/sub'])}/r{rnd.randrange(9)}.py"
                if to not in new and to not in files:
                    new[to] = files[path]
                    changes.append((to, kind, path))
                else:
                    changes.append((path, "deleted", None))
    for _ in range(2):
        path = rnd.choice(["pkg/m1.py", "pkg/m2/__init__.py", "m3.py", "lib/m4.py", f"pkg/n{rnd.randrange(9)}.py"])
        if path not in new and path not in files:
            new[path] = text(rnd, names)
            changes.append((path, "added", None))
    return new, changes


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def same(a, b):
    assert rows(a.nodes, "id", "type", "path", "start_line") == rows(b.nodes, "id", "type", "path", "start_line")
    assert rows(a.edges, *incremental.EDGE) == rows(b.edges, *incremental.EDGE)
    assert rows(a.index.rows(), *incremental.REFERENCE) == rows(b.index.rows(), *incremental.REFERENCE)


def frame(spark, files):
    return spark.createDataFrame([(p, t.encode()) for p, t in files.items()], FILES)


@pytest.mark.parametrize("seed", [1])
def test_updates_equal_a_rebuild(spark, seed):
    rnd = random.Random(seed)
    names = ["pkg.m0", "pkg.m1", "pkg.m2", "m3", "lib.m4", "pkg.sub.r1"]
    files = {p: text(rnd, names) for p in ["pkg/m0.py", "pkg/m1.py", "pkg/m2.py", "m3.py", "lib/m4.py", "lib/a.py", "pkg/b.py", "pkg/sub/c.py"]}
    graph = incremental.RepoGraph.build(frame(spark, files))
    for _ in range(2):
        files, changes = edited(rnd, files, names)
        new = {p: files[p] for p, k, _ in changes if k != "deleted" and p in files}
        graph, report = incremental.update(graph, spark.createDataFrame(changes, CHANGES), frame(spark, new) if new else spark.createDataFrame([], FILES))
        same(graph, incremental.RepoGraph.build(frame(spark, files)))
    same(graph.compact(), graph)


def test_errors_stop_nothing(spark):
    files = {"a.py": "import b\ndef f():\n    g()\n", "b.py": "def g():\n    pass\n"}
    graph = incremental.RepoGraph.build(frame(spark, files))
    changes = spark.createDataFrame([("b.py", "modified", None), ("c.py", "added", None), ("d.py", "added", None)], CHANGES)
    new = frame(spark, {"b.py": "def (\n", "d.py": "def g():\n    pass\n"})
    after, report = incremental.update(graph, changes, new)
    assert report.errors == {"c.py": "not found", "b.py": "can't be parsed"}
    assert (report.nodes_deleted, report.nodes_added) == (2, 3)
    assert rows(after.edges, "source", "target", "type") == [("a.py", "b.py", "IMPORTS"), ("f", "g", "CALLS")]
    one_by_one, total = incremental.update_batches(graph, changes, new, size=1)
    same(one_by_one, after)
    assert total.errors == report.errors and (total.nodes_deleted, total.nodes_added) == (2, 3)
    assert total.files_resolved_again == 2  # g goes with b.py and comes with d.py
