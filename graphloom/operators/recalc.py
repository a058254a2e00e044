"""References of re-parsed nodes, the edges they give, and complexity of whole folders."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import HOT_COMPLEXITY
from ..functions.scalars import complexity_rank, dirname
from ..scratch import cut
from .extract import spread

#: Nodes of a tree that can be references, and those that hold nothing.
_REFERRING = (ast.Import, ast.ImportFrom, ast.Call, ast.ClassDef)
_LEAVES = frozenset({ast.Name, ast.Constant, ast.alias, ast.Load, ast.Store, ast.Del, ast.Pass, ast.Break, ast.Continue})
REFERENCE = "source string, target string, type string, line int"
#: Folders whose files are no part of a complexity report, beside those with a leading dot.
IGNORED_FOLDERS = ["__pycache__", "venv", "node_modules", ".git"]
#: How many of the hottest functions are in a report.
HOTTEST = 10


def _short(e: ast.expr) -> str | None:
    """``a`` or ``a.b``; longer chains and other expressions have no name."""
    if isinstance(e, ast.Attribute) and isinstance(e.value, ast.Name):
        return f"{e.value.id}.{e.attr}"
    return e.id if isinstance(e, ast.Name) else None


def _own_references(x: ast.AST) -> Iterator[tuple[str, str, int]]:
    """target, type, line of the references that a node of the tree is itself."""
    found: list[tuple[str | None, str]] = []
    if isinstance(x, ast.Import):
        found = [(a.name, "IMPORTS") for a in x.names]
    elif isinstance(x, ast.ImportFrom):
        found = [(f"{x.module or ''}.{a.name}", "IMPORTS") for a in x.names]
    elif isinstance(x, ast.Call):
        found = [(_short(x.func), "CALLS")]
    elif isinstance(x, ast.ClassDef):
        found = [(_short(b), "EXTENDS") for b in x.bases]
    for target, kind in found:
        if target:
            yield target, kind, x.lineno


def references_of(tree: ast.Module, path: str) -> Iterator[tuple[str, str, str, int]]:
    """source, target, type, line of all references within the file, within its classes, and within its functions that aren't
    inside others, under the ids of their nodes. One pass: each place of the tree knows the nodes around it."""
    todo: list[tuple[ast.AST, tuple[str, ...], str | None, bool]] = [(tree, (path,), None, False)]
    while todo:
        x, around, cls, inside = todo.pop()
        if isinstance(x, ast.ClassDef):
            around, cls = (*around, x.name), x.name
        elif isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef) and not inside:
            around, inside = (*around, f"{cls}::{x.name}" if cls else x.name), True
        if isinstance(x, _REFERRING):
            for r in _own_references(x):
                yield from ((own, *r) for own in around)
        for f in x._fields:
            v = getattr(x, f, None)
            for child in v if isinstance(v, list) else (v,):
                if isinstance(child, ast.AST) and type(child) not in _LEAVES:
                    todo.append((child, around, cls, inside))


def references(files: DataFrame) -> DataFrame:
    """source, target, type, line of all nodes of ``files`` (path, content binary); files that can't be parsed have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    tree = ast.parse((content or b"").decode())
                except (UnicodeDecodeError, SyntaxError, ValueError, RecursionError):
                    continue
                out += references_of(tree, path)
            kinds = {"source": pa.string(), "target": pa.string(), "type": pa.string(), "line": pa.int32()}
            yield pa.RecordBatch.from_pydict({f: pa.array([r[i] for r in out], k) for i, (f, k) in enumerate(kinds.items())})

    return spread(files).mapInArrow(run, REFERENCE)


def recalculated(files: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of all nodes of ``files``, each (source, target, type) once at its first line, and the external nodes
    (id, type, name) that stand for targets which ``nodes`` doesn't have."""
    edges = cut(references(files).groupBy("source", "target", "type").agg(F.min("line").alias("line")), "references")  # files are parsed once for both
    missing = edges.select(F.col("target").alias("id")).distinct().join(nodes.select("id").distinct(), "id", "left_anti")
    return edges, missing.select("id", F.lit("external").alias("type"), F.col("id").alias("name"))


def reported(path: Column) -> Column:
    """Whether a file counts in complexity reports: a Python file with no hidden or ignored part in its path."""
    return path.endswith(".py") & ~F.exists(F.split(path, "/"), lambda p: p.startswith(".") | p.isin(IGNORED_FOLDERS))


def directory_complexity(parsed: DataFrame) -> DataFrame:
    """dir, n_files, n_functions, total, mean, most, n_hot for each folder of ``parsed`` (rows of ``extract.rows``); folders without functions have 0."""
    own = parsed.where(reported(F.col("path")) & F.col("kind").isin("file", "function"))
    f = F.when(F.col("kind") == "function", F.col("value"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return own.groupBy(dirname(F.col("path")).alias("dir")).agg(F.count_if(F.col("kind") == "file").alias("n_files"), F.count(f).alias("n_functions"), zero(F.sum(f)).alias("total"), F.coalesce(F.avg(f), F.lit(0.0)).alias("mean"), zero(F.max(f)).alias("most"), F.count_if(f >= HOT_COMPLEXITY).alias("n_hot"))


def complexity_report(parsed: DataFrame) -> DataFrame:
    """One row: n_files, n_functions, average (two digits), most, ranks (a count for each of A to F, zeros too), hotspots (the
    hottest functions: complexity, rank, name, file; ties by file and name). The hottest come from a top-k, not from one list.
    Files are parsed once for both."""
    own = cut(parsed.where(reported(F.col("path")) & F.col("kind").isin("file", "function")).select("kind", "path", "id", "value"), "complexity")
    f = F.when(F.col("kind") == "function", F.col("value"))
    ranks = [F.count_if((F.col("kind") == "function") & (complexity_rank(F.col("value")) == r)).alias(r) for r in "ABCDEF"]
    a = own.agg(F.count_if(F.col("kind") == "file").alias("n_files"), F.count(f).alias("n_functions"), F.coalesce(F.round(F.avg(f), 2), F.lit(0.0)).alias("average"), F.coalesce(F.max(f), F.lit(0)).alias("most"), *ranks)
    hot = own.where((F.col("kind") == "function") & (F.col("value") >= HOT_COMPLEXITY)).select((-F.col("value")).alias("minus"), "path", "id").orderBy("minus", "path", "id").limit(HOTTEST)
    item = lambda h: F.struct((-h["minus"]).alias("complexity"), complexity_rank(-h["minus"]).alias("rank"), h["id"].alias("name"), h["path"].alias("file"))
    h = hot.agg(F.transform(F.array_sort(F.collect_list(F.struct("minus", "path", "id"))), item).alias("hotspots"))
    return a.crossJoin(h).select("n_files", "n_functions", "average", "most", F.create_map(*[x for r in "ABCDEF" for x in (F.lit(r), F.col(r))]).alias("ranks"), "hotspots")  # one row by one row
