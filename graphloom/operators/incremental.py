"""Incremental updates of a repository's graph: after a change of files only these are parsed, and of all other files only the
references that the change can reach are resolved again.

Which those are is a question to the reverse-reference index: for each reference of a file the keys whose coming or going
can change it, the candidate files of an import, the name of a call or a base. It is stored by key, so an update
reads the buckets of its own keys. Later updates lie beside it as small frames until ``compact``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, scratch
from . import extract
from .adjacency import Stored, few

REFERENCE = ["key", "path", "kind", "id", "ref", "start_line", "value"]
EDGE = ["source", "target", "type", "line", "path", "ref"]


def references(parsed: DataFrame) -> DataFrame:
    """The reverse-reference index of parsed rows: REFERENCE, one row for each key of a reference."""
    imports = parsed.where("kind = 'import'").withColumn("key", F.explode(F.array_distinct(extract.candidates(F.col("path"), F.col("ref"), F.col("value")))))
    names = parsed.where("kind IN ('call', 'extends')").withColumn("key", F.col("ref"))
    return imports.select(*REFERENCE).union(names.select(*REFERENCE))


class ReverseIndex:
    """The stored index of one version, with what later updates took away (paths) and brought."""

    def __init__(self, base: Stored, gone: DataFrame | None = None, more: DataFrame | None = None):
        self.base, self.gone, self.more = base, gone, more

    @classmethod
    def build(cls, rows: DataFrame) -> ReverseIndex:
        base = Stored(rows.sparkSession, scratch(rows.sparkSession, "references"), "key")
        base.write(rows)
        return cls(base)

    def rows(self) -> DataFrame:
        out = self.base.table().drop("bucket")
        return self._current(out)

    def _current(self, base: DataFrame) -> DataFrame:
        out = base.select(*REFERENCE)
        if self.gone is not None:
            out = out.join(self.gone, "path", "left_anti").select(*REFERENCE).unionByName(self.more)
        return out

    def of(self, keys: DataFrame, n: int) -> DataFrame:
        """References that one of ``keys`` (n rows of key) can change."""
        found = self.base.of(keys, n).select(*REFERENCE)
        if self.gone is None:
            return found
        return found.join(self.gone, "path", "left_anti").select(*REFERENCE).unionByName(self.more.join(few(keys, n), "key", "left_semi").select(*REFERENCE))

    def after(self, paths: DataFrame, rows: DataFrame) -> ReverseIndex:
        gone = paths if self.gone is None else self.gone.union(paths).distinct()
        more = rows if self.more is None else self.more.join(paths, "path", "left_anti").select(*REFERENCE).unionByName(rows)
        return ReverseIndex(self.base, cut(gone, "references-gone"), cut(more, "references-more"))


@dataclass
class RepoGraph:
    """nodes and edges (EDGE: with the path they come from, and the reference) of one state of a repository, and its index."""

    nodes: DataFrame
    edges: DataFrame
    index: ReverseIndex

    @classmethod
    def build(cls, files: DataFrame) -> RepoGraph:
        """From all files (path, content)."""
        parsed = cut(extract.rows(files), "parsed")
        nodes = cut(extract.nodes(parsed), "nodes")
        return cls(nodes, cut(_resolved(references(parsed), nodes), "edges"), ReverseIndex.build(references(parsed)))

    def compact(self) -> RepoGraph:
        """The same with one stored index."""
        return RepoGraph(self.nodes, self.edges, ReverseIndex.build(self.index.rows()))


def _resolved(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """EDGE of references: imports of files that exist, calls and bases of names that are some node's id."""
    imports = refs.where("kind = 'import'").select(*[c for c in REFERENCE if c != "key"]).distinct()
    found = extract.resolve_imports(imports, nodes.where("type = 'file'").select("path"))
    found = found.select(F.col("path").alias("source"), "target", F.lit("IMPORTS").alias("type"), "line", "path", "ref")
    kind = F.when(F.col("kind") == "call", "CALLS").otherwise("EXTENDS")
    named = refs.where("kind <> 'import'").select(F.col("id").alias("source"), F.col("ref").alias("target"), kind.alias("type"), F.col("start_line").alias("line"), "path", "ref")
    return found.unionByName(named.join(nodes.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select(*EDGE))


@dataclass
class Report:
    """What an update did; errors by file."""

    nodes_added: int
    nodes_deleted: int
    edges_recalculated: int
    files_resolved_again: int
    errors: dict[str, str]


def update(graph: RepoGraph, changes: DataFrame, files: DataFrame) -> tuple[RepoGraph, Report]:
    """The graph after ``changes`` (path, change_type, old_path), and a report. ``files`` (path, content) has the new state of
    added, modified and renamed files at least. A file that isn't there or can't be parsed is an error of its own and
    stops nothing; one that can't be parsed stays as its file node."""
    changes = cut(changes.select("path", "change_type", "old_path"), "changes")
    touched = cut(changes.select(F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct(), "touched")
    n_touched = touched.count()
    wanted = changes.where("change_type <> 'deleted'").select("path").distinct()
    parsed = cut(extract.rows(files.join(few(wanted, n_touched), "path", "left_semi").select("path", "content")), "parsed")
    new = cut(extract.nodes(parsed), "nodes")
    was = cut(graph.nodes.join(few(touched, n_touched), "path", "left_semi"), "nodes-before")
    nodes = cut(graph.nodes.join(few(touched, n_touched), "path", "left_anti").select(*graph.nodes.columns).unionByName(new), "nodes")

    # names and files that came or went: of ids, whether any node has them
    ids = was.select("id").union(new.select("id")).distinct()
    before = graph.nodes.join(few(ids, n_touched), "id", "left_semi").select("id").distinct().withColumn("was", F.lit(True))
    after = nodes.join(few(ids, n_touched), "id", "left_semi").select("id").distinct().withColumn("is", F.lit(True))
    flipped = cut(before.join(after, "id", "full").where("was IS NULL OR is IS NULL").select(F.col("id").alias("key")), "flipped")
    n = flipped.count()
    own = references(parsed)
    again = graph.index.of(flipped, n) if n else own.limit(0)
    again = cut(again.join(few(touched, n_touched), "path", "left_anti").select(*REFERENCE), "again")

    redone = cut(_resolved(again, nodes), "edges-again")
    fresh = cut(_resolved(own, nodes), "edges-new")
    kind = F.when(F.col("kind") == "import", "IMPORTS").when(F.col("kind") == "call", "CALLS").otherwise("EXTENDS").alias("type")
    replaced = again.select("path", "ref", F.col("start_line").alias("line"), kind).distinct()
    kept = graph.edges.join(few(touched, n_touched), "path", "left_anti").join(replaced, ["path", "ref", "line", "type"], "left_anti")
    edges = cut(kept.select(*EDGE).unionByName(fresh).unionByName(redone), "edges")
    errors = {r.path: "not found" for r in wanted.join(files.select("path"), "path", "left_anti").collect()}  # of the changes, not more
    errors |= {r.path: "can't be parsed" for r in new.where("type = 'file' AND start_line IS NULL").select("path").collect()}
    report = Report(new.count(), was.count(), fresh.count() + redone.count(), again.select("path").distinct().count(), errors)
    return RepoGraph(nodes, edges, graph.index.after(touched, own)), report


def update_batches(graph: RepoGraph, changes: DataFrame, files: DataFrame, size: int | None = None) -> tuple[RepoGraph, Report]:
    """Updates by batches of ``size`` changed paths, in order of path; all at once by default, as a Spark job bears any number.
    The graph is that of the last batch; an error in one file stops no batch."""
    if size is None:
        return update(graph, changes, files)
    marks = changes.groupBy("path").count().select("path").orderBy("path").collect()  # a change script's paths
    total = Report(0, 0, 0, 0, {})
    for at in range(0, len(marks), size):
        last = marks[min(at + size, len(marks)) - 1].path
        graph, r = update(graph, changes.where(F.col("path").between(marks[at].path, last)), files)
        total = Report(total.nodes_added + r.nodes_added, total.nodes_deleted + r.nodes_deleted, total.edges_recalculated + r.edges_recalculated, total.files_resolved_again + r.files_resolved_again, total.errors | r.errors)
    return graph, total
