"""Context and impact plugins: table-valued functions by name, with the built-in ones."""

from __future__ import annotations

import os
from functools import reduce
from importlib.metadata import entry_points
from operator import or_
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import extract, recalc
from .operators.impact import plugin_risk
from .operators.lookup import file_graph
from .scratch import cut


class ContextPlugin(Protocol):
    name: str
    capabilities: dict[str, bool]

    def rank_nodes(self, nodes: DataFrame, task: str, max_tokens: int) -> DataFrame: ...


class ImpactPlugin(Protocol):
    name: str
    capabilities: dict[str, bool]

    def analyze_impact(self, files: list[str], nodes: DataFrame, edges: DataFrame, depth: int) -> DataFrame: ...


class Analyzer(Protocol):
    """From the files of one language to rows of the graph."""

    language: str
    suffixes: tuple[str, ...]

    def analyze(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges, before the integrity check, of all of ``files`` (path, content binary)."""

    def analyze_file(self, files: DataFrame, path: str) -> DataFrame:
        """The nodes of one file."""

    def resolve_references(self, files: DataFrame, ids: DataFrame) -> DataFrame:
        """source, target, type, line of what the nodes of ``ids`` (id) refer to."""


_ANALYZERS: dict[str, type] = {}


def analyzer(cls: type) -> type:
    """Register an analyzer under its language."""
    _ANALYZERS[cls.language] = cls
    return cls


def analyze_all(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges by all analyzers, each over the files with its suffixes; their columns may differ."""
    nodes = edges = None
    for cls in _ANALYZERS.values():
        own = files.where(reduce(or_, [F.col("path").endswith(s) for s in cls.suffixes]))
        n, e = cls().analyze(own)
        nodes = n if nodes is None else nodes.unionByName(n, allowMissingColumns=True)
        edges = e if edges is None else edges.unionByName(e, allowMissingColumns=True)
    return nodes, edges


@analyzer
class PythonAnalyzer:
    language, suffixes = "python", (".py",)

    def analyze(self, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        parsed = cut(extract.rows(files), "parsed")
        return extract.nodes(parsed), extract.edges(parsed)

    def analyze_file(self, files: DataFrame, path: str) -> DataFrame:
        return extract.nodes(extract.rows(files.where(F.col("path") == path)))

    def resolve_references(self, files: DataFrame, ids: DataFrame) -> DataFrame:
        return recalc.references(files).join(ids.select(F.col("id").alias("source")).distinct(), "source", "left_semi")


_CONTEXT: dict[str, type] = {}
_IMPACT: dict[str, type] = {}


def context_plugin(name: str):
    def add(cls: type) -> type:
        cls.name = name
        _CONTEXT[name] = cls
        return cls

    return add


def impact_plugin(name: str):
    def add(cls: type) -> type:
        cls.name = name
        _IMPACT[name] = cls
        return cls

    return add


def discover(group: str = "graphloom.plugins") -> list[str]:
    """Load installed entry points; their modules register what they define."""
    return [ep.name for ep in entry_points(group=group) if ep.load() is not None]


def choose(kind: str, config: dict | None = None) -> object:
    """The configured plugin (``GRAPHLOOM_PLUGIN_<KIND>`` wins), or its fallback, or ``basic``."""
    known = {"context": _CONTEXT, "impact": _IMPACT}[kind]
    own = (config or {}).get(kind, {})
    for name in (os.environ.get(f"GRAPHLOOM_PLUGIN_{kind.upper()}"), own.get("name"), own.get("fallback"), "basic"):
        if name in known:
            return known[name]()
    raise LookupError(f"no {kind} plugin")


def capabilities() -> dict[str, dict[str, bool]]:
    return {f"{kind}:{name}": cls.capabilities for kind, known in (("context", _CONTEXT), ("impact", _IMPACT)) for name, cls in known.items()}


@context_plugin("basic")
class BasicContext:
    """Nearest nodes first, a node for each hundred tokens."""

    capabilities = {"semantic_ranking": False, "token_budgeting": False, "task_understanding": False}

    def rank_nodes(self, nodes: DataFrame, task: str, max_tokens: int) -> DataFrame:
        return nodes.orderBy(F.coalesce("distance", F.lit(0)), "ord").limit(max(1, max_tokens // 100))


@impact_plugin("basic")
class BasicImpact:
    """Files that use a changed file directly, and a risk by their number."""

    capabilities = {"transitive_analysis": True, "test_detection": False, "risk_scoring": False}

    def analyze_impact(self, files: list[str], nodes: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
        g = file_graph(edges, nodes).where(F.col("path").isin(files) & ~F.col("by_path").isin(files))
        hit = g.groupBy(F.col("by_path").alias("path")).agg(F.array_sort(F.collect_set("edge_type")).alias("edge_types"))
        n = hit.count()
        return hit.withColumn("risk", plugin_risk(F.lit(n)))


@context_plugin("weighted")
class WeightedContext:
    """Type weight, nearness and words of the task in the name; a true prefix of the ranking that fits the budget."""

    capabilities = {"semantic_ranking": True, "token_budgeting": True, "task_understanding": True}
    weights = {"function": 1.0, "class": 0.8, "file": 0.5}

    def rank_nodes(self, nodes: DataFrame, task: str, max_tokens: int) -> DataFrame:
        from pyspark.sql import Window

        w = F.create_map(*[F.lit(x) for kv in self.weights.items() for x in kv])
        words = F.array(*[F.lit(t) for t in dict.fromkeys(task.lower().split())]) if task.strip() else F.array().cast("array<string>")
        bonus = F.size(F.filter(words, lambda t: F.lower("name").contains(t))) * 0.2
        scored = nodes.withColumn("score", F.coalesce(w[F.col("type")], F.lit(0.3)) + 1.0 / (1.0 + F.coalesce("distance", F.lit(0))) + bonus)
        # the best rows can't outnumber the budget, since each costs a token at least
        best = scored.orderBy(F.desc("score"), "ord").limit(max_tokens)
        upto = F.sum(F.greatest(F.col("tokens"), F.lit(1))).over(Window.orderBy(F.desc("score"), "ord"))
        return best.withColumn("upto", upto).where(F.col("upto") <= max_tokens).drop("upto")
