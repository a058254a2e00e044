"""Search by text in three modes. All return rank, fqn, type, file_path, score, snippet; ties go by fqn.

* semantic: the chunks nearest to the text's vector, twice the limit, then filtered.
* graph: nodes whose name or path holds the text, those with the longest matching name first.
* hybrid: the fused ranking of graph nearness and vector similarity, cut to the limit, then filtered.

Vectors come from a stored index, so that a search reads the lists near its query and not the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import snippet
from . import embed, ranking
from .vector_index import VectorIndex

MODES = ("semantic", "graph", "hybrid")
#: Least similarity of a semantic hit, chunks that hybrid search asks for, and the score of a graph hit.
THRESHOLD, HYBRID_CHUNKS, GRAPH_SCORE = 0.7, 50, 0.8


def matches(path: Column, file_types: list[str] | None = None, paths: list[str] | None = None) -> Column:
    """Whether a path ends in one of ``file_types`` (with their dot) and holds one of ``paths``; an empty list asks for nothing."""
    out = F.lit(True)
    if file_types:
        ext = F.when(path.contains("."), F.concat(F.lit("."), F.substring_index(path, ".", -1))).otherwise(".")
        out = out & ext.isin(*file_types)
    if paths:
        out = out & F.exists(F.array(*map(F.lit, paths)), lambda p: path.contains(p))
    return out


def fqn(type_: Column, path: Column, name: Column) -> Column:
    return F.when(type_ == "file", path).otherwise(F.concat_ws("::", path, name))


def _ranked(hits: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The best ``limit`` with their rank: a top-k first, so that the window has ``limit`` rows."""
    top = hits.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _nearest(chunks: DataFrame, key: str, index: VectorIndex, text: str, k: int, embedder: embed.Embedder | None) -> DataFrame:
    q = embed.query_frame(chunks.sparkSession, text, embedder)
    near = index.search(q, "qid", k, exact=True).where(F.col("score") >= THRESHOLD).select(F.col("id").alias(key), "score")
    return chunks.join(F.broadcast(near), key)  # k rows at most


def semantic(chunks: DataFrame, key: str, index: VectorIndex, text: str, limit: int = 10, file_types: list[str] | None = None, paths: list[str] | None = None, embedder: embed.Embedder | None = None) -> DataFrame:
    """``chunks``: ``key`` (the index's id), type, name, file_path, content."""
    near = _nearest(chunks, key, index, text, 2 * limit, embedder).where(matches(F.col("file_path"), file_types, paths))
    hits = near.select(fqn(F.col("type"), F.col("file_path"), F.col("name")).alias("fqn"), "type", "file_path", "score", snippet(F.col("content")).alias("snippet"), F.col(key).alias("k"))
    return _ranked(hits, limit, F.desc("score"), F.col("k")).select("rank", "fqn", "type", "file_path", "score", "snippet")


def graph(nodes: DataFrame, text: str, limit: int = 10, file_types: list[str] | None = None, paths: list[str] | None = None) -> DataFrame:
    """``nodes``: id, type, name, path, ord, and docstring and content if there are any."""
    low = text.lower()
    hit = nodes.where(matches(F.col("path"), file_types, paths) & F.lower(F.concat_ws(" ", "name", "path")).contains(low))
    long = F.when(F.lower("name").contains(low), F.length("name")).otherwise(0)
    said = [F.when(F.col(c) != "", snippet(F.col(c))) for c in ("content", "docstring") if c in nodes.columns]
    text_ = F.coalesce(*said, F.concat_ws(": ", "type", "name"))
    hits = hit.select(F.when(F.col("type") == "file", F.col("path")).otherwise(F.col("id")).alias("fqn"), "type", F.col("path").alias("file_path"), F.lit(GRAPH_SCORE).alias("score"), text_.alias("snippet"), long.alias("long"), "ord")
    return _ranked(hits, limit, F.desc("long"), F.col("ord")).select("rank", "fqn", "type", "file_path", "score", "snippet")


def hybrid(near_nodes: DataFrame, chunks: DataFrame, key: str, index: VectorIndex, text: str, limit: int = 10, file_types: list[str] | None = None, paths: list[str] | None = None, embedder: embed.Embedder | None = None) -> DataFrame:
    """``near_nodes``: fqn of the nodes within reach of the entry points (none: an empty table)."""
    g = near_nodes.select("fqn").distinct().withColumn("g", F.lit(1.0))
    near = _nearest(chunks, key, index, text, HYBRID_CHUNKS, embedder)
    s = near.groupBy(fqn(F.col("type"), F.col("file_path"), F.col("name")).alias("fqn")).agg(F.max("score").alias("s"))
    fused = ranking.fuse(g, s).withColumn("score", F.round("score", 12))
    top = _ranked(fused, limit, F.desc("score"), F.col("fqn"))
    named = F.col("fqn").contains("::")
    out = top.withColumns({"type": F.when(named, "function").otherwise("file"), "file_path": F.substring_index("fqn", "::", 1), "snippet": F.lit(None).cast("string")})
    return out.where(matches(F.col("file_path"), file_types, paths)).select("rank", "fqn", "type", "file_path", "score", "snippet")
