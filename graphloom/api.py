"""The engine's front: analyze, query, search, rank, diff, cluster and report over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.constants import PRESETS
from .functions.scalars import glob_regex
from .operators import budget, clustering, diff, extract, formats, impact, lookup, ranking, tokens, traverse, usage
from .operators import search as text_search
from .operators.adjacency import Adjacency
from .operators.embed import Embedder
from .operators.vector_index import VectorIndex
from .plugins import Analyzer, PythonAnalyzer
from .scratch import cut
from .sources import files as source_files
from .sources import graph as graph_source


def get_preset(model: str) -> tuple[int, int, int, float]:
    """Context window, recommended and greatest budget, characters per token: exact name, else the first that contains or is contained, else gpt-4."""
    if model in PRESETS:
        return PRESETS[model]
    return next((v for k, v in PRESETS.items() if k in model or model in k), PRESETS["gpt-4"])


def check_budget(model: str, max_tokens: int) -> None:
    if not 0 < max_tokens <= get_preset(model)[0]:
        raise ValueError(f"max_tokens is 1 to {get_preset(model)[0]} for {model}")


def check_range(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} is {low} to {high}")


@dataclass
class CodeGraph:
    """nodes (id, type, name, path, ord, ...) and edges (source, target, type, line, ord); walks use the stored adjacency if there is one."""

    nodes: DataFrame
    edges: DataFrame
    store: Adjacency | None = None

    @classmethod
    def analyze(cls, spark: SparkSession, root: str, patterns: list[str] | None = None, analyzer: Analyzer | None = None) -> CodeGraph:
        """Analyze all files under ``root``, by default with the Python analyzer; edges to unknown targets are dropped."""
        nodes, edges = (analyzer or PythonAnalyzer()).analyze(source_files.scan(spark, root, patterns))
        edges = lookup.valid_edges(edges, nodes)
        return cls(nodes, edges.withColumn("ord", F.xxhash64("source", "target", "type", "line")))

    @classmethod
    def tables(cls, spark: SparkSession, sf_dir: str) -> CodeGraph:
        return cls(graph_source.nodes(spark, sf_dir), graph_source.edges(spark, sf_dir))

    def stored(self, root: str) -> CodeGraph:
        """The same graph, whose walks read an adjacency under ``root``: a folder of this graph version alone."""
        return CodeGraph(self.nodes, self.edges, Adjacency(self.nodes, self.edges, root))

    def stats(self) -> DataFrame:
        return self.nodes.groupBy("type").agg(F.count("*").alias("n"))

    def node(self, id_: str) -> DataFrame:
        return self.nodes.where(F.col("id") == id_).orderBy("ord").limit(1)

    def dependencies(self, start: str, depth: int = 2, direction: str = "outgoing", types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        check_range("depth", depth, 1, 5)
        return traverse.khop(self.store or self.edges, start, depth, direction, types)

    def shortest_path(self, source: str, target: str) -> list[str] | None:
        return traverse.shortest_path(self.store or self.edges, source, target)

    def impact(self, changed: list[str]) -> DataFrame:
        """path, distance of affected files, with edge types where direct."""
        known = {r.path for r in self.nodes.where((F.col("type") == "file") & F.col("path").isin(changed)).select("path").distinct().collect()}
        if missing := sorted(set(changed) - known):
            raise LookupError(f"no such file in the graph: {', '.join(missing)}")
        direct = impact.direct(self.store or self.edges, self.nodes, changed)
        return impact.closure(self.store or self.edges, self.nodes, changed).join(direct, "path", "left")

    def pr_impact(self, changed: list[str]) -> DataFrame:
        """One row: impacted and direct files, tests, risk."""
        c = impact.closure(self.store or self.edges, self.nodes, changed, rounds=1)
        a = c.agg(F.count("*").alias("n_impacted"), F.count_if(F.col("distance") == 1).alias("n_direct"), F.count_if(F.lower("path").contains("test")).alias("n_tests"), F.coalesce(F.max(impact.critical(F.col("path"))), F.lit(False)).alias("critical"))
        return a.withColumn("risk", impact.pr_risk(F.col("n_impacted"), F.lit(len(changed)), F.col("critical")))

    def entry_points(self, spec: str | None = None) -> DataFrame:
        """Nodes of a pattern with ``*``, a ``.py`` path, a ``path:line`` or an id, tried in this order; without a spec
        those of the usual entry files."""
        n = self.nodes
        if spec is None:
            return lookup.default_entries(n)
        if "*" in spec:
            return n.where(F.col("path").rlike(glob_regex(spec)))
        if spec.endswith(".py"):
            return n.where(F.col("path") == spec)
        path, colon, line = spec.rpartition(":")
        if colon and line.isdigit() and not path.endswith(":"):
            hit = n.where((F.col("path") == path) & F.lit(int(line)).between(F.col("start_line"), F.col("end_line")))
            return hit.orderBy(F.col("end_line") - F.col("start_line"), "ord").limit(1)
        return self.node(spec)

    def context(self, starts: DataFrame, semantic: DataFrame, depth: int = 2, max_tokens: int = 8000, strategy: str = "adaptive") -> tuple[DataFrame, DataFrame]:
        """Ranked nodes within ``depth`` of ``starts`` (id) and the budget's choice; ``semantic`` is (fqn, s)."""
        found = traverse.reach(self.store.steps("both") if self.store else traverse.arcs(self.edges, "both"), starts, depth)
        n = lookup.first_nodes(self.nodes.select("id", "type", "name", "path", "ord")).join(found, "id")
        n = n.withColumn("tokens", tokens.estimate(F.concat_ws("\n", "path", "name")))
        ranked = ranking.five_factor(n, semantic, F.col("depth"))
        flat = ranked.select(F.lit(0).cast("long").alias("req"), F.xxhash64("id").alias("ord"), "score", "tokens")
        chosen, _ = budget.allocate(flat, max_tokens, strategy)
        return ranked, ranked.join(chosen.select(F.col("ord").alias("h"), F.col("tokens").alias("taken")), F.xxhash64("id") == F.col("h")).drop("h")

    def local_context(self, entries: list[str], most: int = 50) -> tuple[DataFrame, DataFrame]:
        """The entries (relevance 1.0) and what they are directly connected with (0.8), ``most`` nodes in all unless there are
        more entries; neighbours come in the order of ``ord``. Then the edges of entries within that choice."""
        spark = self.nodes.sparkSession
        known = lookup.first_nodes(self.nodes.select("id", "type", "path", "ord"))
        found = {r.id for r in known.where(F.col("id").isin(entries)).select("id").collect()}
        if missing := [e for e in entries if e not in found]:
            raise LookupError(f"no such node in the graph: {', '.join(missing)}")
        check_range("most", most, 1, 100)
        starts = spark.createDataFrame([(e,) for e in dict.fromkeys(entries)], "id string")
        near = traverse.reach(self.store.steps("both") if self.store else traverse.arcs(self.edges, "both"), starts, 1)
        top = known.join(near, "id").orderBy("depth", "ord", "id").limit(max(most, len(found)))
        nodes = cut(top.select("id", "type", "path", F.when(F.col("depth") == 0, 1.0).otherwise(0.8).alias("relevance")), "local-context")
        ids = F.broadcast(nodes.select("id"))  # ``most`` rows, or the entries
        own = self.edges.where(F.col("source").isin(entries) | F.col("target").isin(entries))
        return nodes, own.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")

    def find(self, text: str, mode: str = "hybrid", limit: int = 10, chunks: DataFrame | None = None, key: str = "chunk_id", index: VectorIndex | None = None, entries: list[str] | None = None, depth: int = 2, file_types: list[str] | None = None, paths: list[str] | None = None, embedder: Embedder | None = None) -> DataFrame:
        """Search by text (``operators/search.py``). Semantic and hybrid modes need ``chunks`` and their ``index``; hybrid counts
        what is within ``depth`` of ``entries`` as near."""
        if mode not in text_search.MODES:
            raise ValueError(f"mode is one of {text_search.MODES}")
        check_range("limit", limit, 1, 100)
        check_range("depth", depth, 1, 5)
        if mode == "graph":
            return text_search.graph(self.nodes, text, limit, file_types, paths)
        if chunks is None or index is None:
            raise ValueError(f"{mode} search needs chunks and their index")
        if mode == "semantic":
            return text_search.semantic(chunks, key, index, text, limit, file_types, paths, embedder)
        starts = self.nodes.sparkSession.createDataFrame([(e,) for e in dict.fromkeys(entries or [])], "id string")
        near = traverse.reach(self.store.steps("both") if self.store else traverse.arcs(self.edges, "both"), starts, depth) if entries else starts
        nodes = self.nodes.join(near.select("id"), "id", "left_semi")
        near = nodes.select(F.when(F.col("type") == "file", F.col("path")).otherwise(F.col("id")).alias("fqn"))
        return text_search.hybrid(near, chunks, key, index, text, limit, file_types, paths, embedder)

    def clusters(self, vectors: DataFrame, k: int = 8) -> DataFrame:
        check_range("k", k, 2, 20)
        return clustering.kmeans(vectors, k)

    def diff(self, other: CodeGraph) -> tuple[DataFrame, DataFrame]:
        return diff.node_changes(self.nodes.drop("ord"), other.nodes.drop("ord")), diff.edge_changes(self.edges, other.edges)


search = ranking.cosine_topk
render = formats.render
kmeans = clustering.kmeans
usage_report = usage.aggregate
