"""Lookup joins where ids may repeat: the first match by ``ord`` wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ENTRY_FILES
from ..scratch import dealt


def first_nodes(nodes: DataFrame, key: str = "id") -> DataFrame:
    """One node for each id: the one with the smallest ``ord``. A partially aggregated group-by, not a window."""
    rest = [c for c in nodes.columns if c not in (key, "ord")]
    return nodes.groupBy(key).agg(F.min(F.struct("ord", *rest)).alias("n")).select(key, "n.*")


def _resolved(edges: DataFrame, nodes: DataFrame, rows: int | None, end: str = "target") -> DataFrame:
    """``edges`` and ``found``, true where the ``end`` is a node. With ``rows``, the number of both together, about, they are
    dealt by it and meet in one join, else in the session's number of tasks (for frames that are costly to count). A semi
    join would go below a union of edges and become one for each of its tables."""
    ids = nodes.select(F.col("id").alias(end))
    if rows is not None:
        edges, ids = dealt(edges, rows, end), dealt(ids, rows, end)
    return edges.join(ids.distinct().withColumn("found", F.lit(True)), end, "left")


def valid_edges(edges: DataFrame, nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """Edges whose target is a node; the source isn't looked at."""
    return _resolved(edges, nodes, rows).where("found").drop("found")


def dangling_edges(edges: DataFrame, nodes: DataFrame, rows: int | None = None) -> DataFrame:
    return _resolved(edges, nodes, rows).where("found IS NULL").drop("found")


def induced(edges: DataFrame, kept: DataFrame, rows: int | None = None) -> DataFrame:
    """Edges with both ends in ``kept`` (id)."""
    return valid_edges(_resolved(edges, kept, rows, "source").where("found").drop("found"), kept, rows)


def both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with source_path and target_path; unresolved edges are dropped."""
    f = first_nodes(nodes.select("id", "ord", "path"))
    return edges.join(f.select(F.col("id").alias("source"), F.col("path").alias("source_path")), "source").join(f.select(F.col("id").alias("target"), F.col("path").alias("target_path")), "target")


def file_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, by_path, edge_type, ord...: every node with the target's id is hit, the source is the first with its id."""
    first = first_nodes(nodes.select("id", "ord", "path")).select(F.col("id").alias("source"), F.col("path").alias("by_path"))
    hit = nodes.select(F.col("id").alias("target"), "path", F.col("ord").alias("node_ord"))
    return edges.join(hit, "target").join(first, "source").select("path", "by_path", F.col("type").alias("edge_type"), "node_ord", F.col("ord").alias("edge_ord"), F.col("target").alias("node_id"))


def default_entries(nodes: DataFrame, files: list[str] = ENTRY_FILES, most: int = 5) -> DataFrame:
    """The first ``most`` nodes of the usual entry files, file by file in the given order, then by ``ord``."""
    place = F.array_position(F.array(*map(F.lit, files)), F.col("path"))
    return nodes.where(F.col("path").isin(*files)).orderBy(place, "ord").limit(most)
