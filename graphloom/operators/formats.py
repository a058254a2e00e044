"""Contexts as text: markdown, XML, JSON, plain, trees and comments. Formatting is by groups; nothing is collected
but what a caller renders."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import language

FORMATS = ("markdown", "xml", "json", "plain")


def _line(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("0"))


def markdown_by_file(nodes: DataFrame, metadata: bool = True) -> DataFrame:
    """path, first (ord of its first node), text: one section for each file, its nodes by start line."""
    title = F.concat(F.lit("**"), F.initcap("type"), F.lit(": "), "name", F.lit("** (lines "), _line("start_line"), F.lit("-"), _line("end_line"), F.lit(")\n"))
    block = F.concat_ws("\n", *([title] if metadata else []), F.concat(F.lit("```"), language(F.col("path"))), F.coalesce("content", F.lit("")), F.lit("```\n"))
    items = F.array_sort(F.collect_list(F.struct(F.coalesce("start_line", F.lit(0)).alias("at"), "ord", block.alias("text"))))
    g = nodes.groupBy("path").agg(F.min("ord").alias("first"), F.array_join(F.transform(items, lambda x: x["text"]), "\n").alias("body"))
    return g.select("path", "first", F.concat_ws("\n", F.concat(F.lit("### "), "path", F.lit("\n")), "body").alias("text"))


def xml_items(nodes: DataFrame) -> DataFrame:
    lines = F.concat(F.lit(' lines="'), _line("start_line"), F.lit("-"), _line("end_line"), F.lit('">'))
    text = F.concat_ws("\n", F.concat(F.lit('  <file path="'), "path", F.lit('">')), F.concat(F.lit("    <"), "type", F.lit(' name="'), "name", F.lit('"'), lines), F.concat(F.lit("      <![CDATA["), F.coalesce("content", F.lit("")), F.lit("]]>")), F.concat(F.lit("    </"), "type", F.lit(">")), F.lit("  </file>"))
    return nodes.select("ord", text.alias("text"))


def plain_items(nodes: DataFrame) -> DataFrame:
    return nodes.select("ord", F.concat(F.lit("# "), "path", F.lit(":"), _line("start_line"), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n")).alias("text"))


def json_items(nodes: DataFrame) -> DataFrame:
    return nodes.select("ord", F.to_json(F.struct(F.col("path").alias("file_path"), "type", "name", "start_line", "end_line", "content", F.col("score").alias("relevance_score"))).alias("text"))


def render(nodes: DataFrame, kind: str = "markdown", max_chars: int | None = None) -> str:
    """One prompt of all ``nodes``: a selection that a budget has bounded."""
    if kind not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    if kind == "markdown":
        parts = [r.text for r in markdown_by_file(nodes).orderBy("first").collect()]
        out = "\n".join(["## Relevant Code Context\n", *parts])
    else:
        parts = [r.text for r in {"xml": xml_items, "plain": plain_items, "json": json_items}[kind](nodes).orderBy("ord").collect()]
        out = "\n".join({"xml": ["<code_context>", *parts, "</code_context>"]}.get(kind, parts))
        if kind == "json":
            out = json.dumps({"context": [json.loads(p) for p in parts]}, indent=2)
    return out if max_chars is None or len(out) <= max_chars else out[: max(0, max_chars - 3)] + "..."


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def tree(edges: DataFrame, root: str, max_depth: int = 3) -> str:
    """The dependency tree of ``root`` within ``max_depth``; a node that was shown before is marked and not entered."""
    from .traverse import khop

    kids: dict[str, list[str]] = {}
    for r in khop(edges, root, max_depth)[1].orderBy("source", "target").collect():
        kids.setdefault(r.source, []).append(r.target)
    out, seen = [root], {root}

    def show(node: str, indent: str, depth: int) -> None:
        own = list(dict.fromkeys(kids.get(node, ()))) if depth < max_depth else []
        for i, k in enumerate(own):
            last = i == len(own) - 1
            out.append(f"{indent}{'└── ' if last else '├── '}{k}{' (circular)' if k in seen else ''}")
            if k not in seen:
                seen.add(k)
                show(k, indent + ("    " if last else "│   "), depth + 1)

    show(root, "", 0)
    return "\n".join(out)


def impact_tree(edges: DataFrame, nodes: DataFrame, target: str, max_depth: int = 2) -> str:
    """What depends on ``target``, within ``max_depth``; a node that was shown before isn't shown again."""
    from .traverse import khop

    met = khop(edges, target, max_depth, "incoming")[1]
    users: dict[str, list[str]] = {}
    for r in met.select("source", "target").orderBy("target", "source").collect():
        users.setdefault(r.target, []).append(r.source)
    ids = list({target, *(u for own in users.values() for u in own)})
    spark = nodes.sparkSession
    named = nodes.join(spark.createDataFrame([(i,) for i in ids], "id string"), "id", "left_semi")
    names = {r.id: r["name"] for r in named.groupBy("id").agg(F.min_by("name", "ord").alias("name")).collect()}
    out = [f"🎯 Impact Analysis: {names.get(target, target)}", ""]
    if target not in users:
        return "\n".join([*out, "   No dependents found (this is a leaf node)"])
    out.append(f"   {len(users[target])} direct dependents:")
    seen = {target}
    todo = [(u, "   ", i == len(users[target]) - 1, 1) for i, u in enumerate(users[target])][::-1]
    while todo:
        node, indent, last, depth = todo.pop()
        if depth > max_depth or node in seen:
            continue
        seen.add(node)
        out.append(f"{indent}{'└── ' if last else '├── '}{names.get(node, node)}")
        own = users.get(node, [])
        todo += [(u, indent + ("    " if last else "│   "), i == len(own) - 1, depth + 1) for i, u in enumerate(own)][::-1]
    return "\n".join(out)


def summary_lines(nodes: DataFrame, edges: DataFrame, repo: str, max_files: int = 10) -> DataFrame:
    """One row, ``text``: numbers of files and edges, and the files with most edges (ties by ``ord``) with those in and out."""
    files = nodes.where("type = 'file'").select("id", "name", "ord")
    ends = edges.select(F.explode(F.array(F.struct(F.col("target").alias("id"), F.lit(1).alias("n_in"), F.lit(0).alias("n_out")), F.struct(F.col("source").alias("id"), F.lit(0).alias("n_in"), F.lit(1).alias("n_out")))).alias("e")).select("e.*")
    degree = ends.groupBy("id").agg(F.sum("n_in").alias("n_in"), F.sum("n_out").alias("n_out"))
    counted = files.join(degree, "id", "left").na.fill(0, ["n_in", "n_out"])
    top = counted.withColumn("minus", -(F.col("n_in") + F.col("n_out"))).orderBy("minus", "ord").limit(max_files)
    items = F.array_sort(F.collect_list(F.struct("minus", "ord", F.format_string("%s (%d↓ %d↑)", "name", "n_in", "n_out").alias("text"))))
    n = files.agg(F.count("*").alias("n_files")).crossJoin(edges.agg(F.count("*").alias("n_edges"))).crossJoin(top.agg(items.alias("items")))  # one row each
    line = lambda x, i: F.concat(F.when(i == F.size("items") - 1, "   └── ").otherwise("   ├── "), x["text"])
    head = [F.lit(f"📊 {repo} - Dependency Summary"), F.format_string("   Total: %d files, %d edges", "n_files", "n_edges"), F.lit(""), F.lit("Top connected files:")]
    more = F.when(F.col("n_files") > max_files, F.format_string("   ... and %d more files", F.col("n_files") - max_files))
    return n.select(F.array_join(F.array_compact(F.concat(F.array(*head), F.transform("items", line), F.array(more))), "\n").alias("text"))


def file_sections(nodes: DataFrame) -> DataFrame:
    """path, first, text: the part of a prompt's file structure for each file; ``nodes``: id, type, path, relevance, ord, content."""
    code = F.when(F.coalesce("content", F.lit("")) != "", F.concat(F.lit("  ```python\n"), "content", F.lit("\n  ```")))
    item = F.concat_ws("\n", F.format_string("- **%s**: %s (relevance: %.2f)", "type", "id", "relevance"), code)
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("text")))), lambda x: x["text"])
    g = nodes.groupBy("path").agg(F.min("ord").alias("first"), F.array_join(items, "\n").alias("body"))
    return g.select("path", "first", F.concat(F.lit("#### "), "path", F.lit("\n"), "body", F.lit("\n")).alias("text"))


def node_sections(nodes: DataFrame) -> DataFrame:
    """ord, text of each node of a prompt."""
    code = F.when(F.coalesce("content", F.lit("")) != "", F.concat(F.lit("- **Code**:\n```python\n"), "content", F.lit("\n```")))
    text = F.concat_ws("\n", F.concat(F.lit("#### "), "id"), F.concat(F.lit("- **Type**: "), "type"), F.concat(F.lit("- **Path**: "), "path"), F.format_string("- **Relevance**: %.2f", "relevance"), code, F.lit(""))
    return nodes.select("ord", text.alias("text"))


def edge_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """ord, text of each edge between two of ``nodes``, by their paths."""
    path = lambda end: nodes.groupBy(F.col("id").alias(end)).agg(F.min_by("path", "ord").alias(f"{end}_path"))
    line = F.when(F.coalesce("line", F.lit(0)) != 0, F.concat(F.lit("  (line "), F.col("line").cast("string"), F.lit(")")))
    text = F.concat_ws("\n", F.format_string("- `%s` **%s** `%s`", "source_path", "type", "target_path"), line, F.lit(""))
    return edges.join(path("source"), "source").join(path("target"), "target").select("ord", text.alias("text"))


def prompt(nodes: DataFrame, edges: DataFrame | None = None, with_tree: bool = True, available: int | None = None, max_chars: int | None = None) -> str:
    """A selection as markdown with its file structure, nodes and dependencies; ``available`` is the number of nodes that it
    was cut from, if it was. Sections come in order and stop once ``max_chars`` is reached; the end is then three dots."""
    out, size = ["## Relevant Code Context\n"], 0

    def add(title: str, parts: DataFrame, order: str) -> None:
        nonlocal size
        own = parts.orderBy(order)
        rows = own.toLocalIterator() if max_chars is not None else own.collect()
        for i, r in enumerate(rows):
            out.extend([title, r.text] if i == 0 else [r.text])
            size += len(r.text)
            if max_chars is not None and size > max_chars:
                return

    if with_tree:
        add("### File Structure\n", file_sections(nodes), "first")
    add("### Context Nodes\n", node_sections(nodes), "ord")
    if edges is not None:
        add("### Dependencies\n", edge_lines(edges, nodes), "ord")
    if available is not None:
        out.append(f"\n*Note: Context truncated. Total nodes available: {available}*")
    text = "\n".join(out)
    return text if max_chars is None or len(text) <= max_chars else text[: max(0, max_chars - 3)] + "..."


def comment_text() -> Column:
    """The comment on a change, of columns risk, n_impacted, n_direct, n_tests."""
    icon = F.create_map(*map(F.lit, ["low", "🟢", "medium", "🟡", "high", "🔴"]))
    return F.concat_ws("\n", F.lit("## Impact"), F.concat(icon[F.col("risk")], F.lit(" risk: "), "risk"), F.concat(F.lit("- impacted files: "), F.col("n_impacted").cast("string"), F.lit(" ("), F.col("n_direct").cast("string"), F.lit(" direct)")), F.concat(F.lit("- tests to run: "), F.col("n_tests").cast("string")))


def pr_comment(impact: DataFrame) -> DataFrame:
    """One row, ``comment``."""
    return impact.select(comment_text().alias("comment"))
