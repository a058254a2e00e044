"""Vector search, score fusion and the five-factor rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FUSION
from ..functions.scalars import combined, cosine, criticality, frequency_score, token_efficiency


def cosine_scored(vectors: DataFrame, query: list[float], threshold: float = 0.7) -> DataFrame:
    """``vectors`` (with ``embedding``) and ``score``, of at least ``threshold``. The query vector is a literal."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", cosine(F.col("embedding"), q)).where(F.col("score") >= threshold)


def cosine_topk(vectors: DataFrame, query: list[float], k: int, threshold: float = 0.7) -> DataFrame:
    """The k best of ``cosine_scored``."""
    return cosine_scored(vectors, query, threshold).orderBy(F.desc("score")).limit(k)


def fuse(graph: DataFrame, semantic: DataFrame) -> DataFrame:
    """fqn, graph_score, semantic_score, score from (fqn, g) and (fqn, s); a missing graph side counts 0.1, a missing semantic one 0."""
    both = graph.join(semantic, "fqn", "full").select("fqn", F.coalesce("g", F.lit(FUSION["no_graph"])).alias("graph_score"), F.coalesce("s", F.lit(FUSION["no_semantic"])).alias("semantic_score"))
    return both.withColumn("score", FUSION["graph"] * F.col("graph_score") + FUSION["semantic"] * F.col("semantic_score"))


def five_factor(nodes: DataFrame, semantic: DataFrame, depth: Column | None) -> DataFrame:
    """``nodes`` (id, type, name, path, tokens, ord) with their scores; ``semantic`` (fqn, s); ``depth``: hops from the focal nodes, None without any."""
    freq = nodes.groupBy("path").agg(F.count("*").alias("freq"))
    n_files = freq.count()
    fqn = F.when(F.col("type") == "file", F.col("path")).otherwise(F.col("id"))
    x = nodes.withColumn("fqn", fqn).join(freq, "path").join(semantic, "fqn", "left")
    graph = F.lit(0.5) if depth is None else 1.0 / (1.0 + F.coalesce(depth, F.lit(10)))
    parts = {"semantic_score": F.coalesce("s", F.lit(0.0)), "graph_score": graph, "criticality": criticality(F.col("type"), F.col("name")), "frequency": frequency_score(F.col("freq"), F.lit(n_files)), "efficiency": token_efficiency(F.col("tokens"))}
    return x.withColumns(parts).withColumn("score", combined(*[F.col(c) for c in parts])).drop("fqn", "freq", "s")


def stable_topk(df: DataFrame, k: int, score: str = "score", ord_: str = "ord") -> DataFrame:
    return df.orderBy(F.desc(score), ord_).limit(k)
