"""From Python sources to graph rows. Parsing is one Arrow map over (path, content); every name is then resolved by joins."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dirname, join_path

ROW = "path string, kind string, id string, name string, ref string, start_line int, end_line int, docstring string, value long, content string"
_FIELDS = [f.split()[0] for f in ROW.split(", ")]
#: Files that a task parses, about: a few seconds of work, however few bytes they come from.
TASK_FILES = 5_000
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.Assert, ast.match_case, ast.comprehension)


def dotted(e: ast.expr) -> str | None:
    """The text of a name or attribute chain; a chain on anything else keeps its attributes only."""
    parts: list[str] = []
    while isinstance(e, ast.Attribute):
        parts.append(e.attr)
        e = e.value
    if isinstance(e, ast.Name):
        parts.append(e.id)
    return ".".join(reversed(parts)) or None


def complexity(f: ast.AST) -> int:
    """1 and one for each branch and further boolean operand."""
    n = 1
    for x in ast.walk(f):
        n += isinstance(x, _BRANCHES) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0) + (len(x.ifs) if isinstance(x, ast.comprehension) else 0)
    return n


def signature(f: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    a = f.args
    names = [x.arg for x in [*a.posonlyargs, *a.args]]
    return f"{f.name}({', '.join([*names, *([f'*{a.vararg.arg}'] if a.vararg else []), *([f'**{a.kwarg.arg}'] if a.kwarg else [])])})"


def parse(path: str, content: bytes | None) -> Iterator[tuple]:
    """Rows of ROW: the file itself, then classes, functions, imports, calls, bases, and parts for embedding."""
    try:
        text = (content or b"").decode()
        tree = ast.parse(text)
    except (UnicodeDecodeError, SyntaxError, ValueError, RecursionError):
        yield (path, "file", path, path.rsplit("/", 1)[-1], None, None, None, None, None, None)
        return
    lines = text.split("\n")
    yield (path, "file", path, path.rsplit("/", 1)[-1], None, 1, max(1, len(lines)), ast.get_docstring(tree), None, None)
    source = lambda x: "\n".join(lines[x.lineno - 1 : x.end_lineno])
    out: list[tuple] = []

    def row(kind: str, id_: str | None, name: str | None, ref: str | None, x: ast.AST, doc: str | None = None, value: int | None = None, body: str | None = None) -> None:
        out.append((path, kind, id_, name, ref, x.lineno, x.end_lineno, doc, value, body))

    for x in ast.walk(tree):
        if isinstance(x, ast.ClassDef):
            row("class", x.name, x.name, None, x, ast.get_docstring(x))
            methods = [m for m in x.body if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef)]
            head = [f"class {x.name}:", *([f'    """{d}"""'] if (d := ast.get_docstring(x)) else []), *[f"    def {signature(m)}: ..." for m in methods]]
            row("chunk", f"{path}::{x.name}::{x.lineno}", x.name, "class", x, body="\n".join(head))
            for b in x.bases:
                if t := dotted(b):
                    row("extends", x.name, None, t, x)
        elif isinstance(x, ast.Import):
            for a in x.names:
                row("import", path, None, a.name, x, value=0)
        elif isinstance(x, ast.ImportFrom) and x.module:
            row("import", path, None, x.module, x, value=x.level)
            for a in x.names:
                row("import_name", path, a.name, f"{x.module}.{a.name}", x, value=x.level)

    def visit(x: ast.AST, classes: tuple[str, ...], functions: tuple[str, ...]) -> None:
        for child in ast.iter_child_nodes(x):
            if isinstance(child, ast.ClassDef):
                visit(child, (*classes, child.name), functions)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                own = f"{classes[-1]}::{child.name}" if classes else child.name
                if not functions:  # functions inside functions are no nodes of their own
                    row("function", own, child.name, signature(child), child, ast.get_docstring(child), complexity(child))
                row("definition", own, child.name, None, child)
                if isinstance(child, ast.FunctionDef):
                    row("chunk", f"{path}::{child.name}::{child.lineno}", child.name, "function", child, body=source(child))
                visit(child, classes, (*functions, own))
            elif isinstance(child, ast.Call):
                t = dotted(child.func) if isinstance(child.func, ast.Name | ast.Attribute) else None
                if functions and t:
                    row("call", functions[-1], None, t, child)
                elif t:
                    row("toplevel_call", path, None, t, child)
            else:
                visit(child, classes, functions)

    visit(tree, (), ())
    yield from out


def spread(files: DataFrame) -> DataFrame:
    """``files`` (path, content) over as many tasks as there is work. Parsing takes its time by file, and a small table whose rows
    are made into sources is one partition otherwise."""
    return files.select("path", "content").repartition(max(1, -(-files.count() // TASK_FILES)), "path")


def rows(files: DataFrame) -> DataFrame:
    """ROW for all of ``files`` (path, content binary); a file that can't be parsed is its file row alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [r for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for r in parse(p, c)]
            kinds = {"start_line": pa.int32(), "end_line": pa.int32(), "value": pa.int64()}
            yield pa.RecordBatch.from_pydict({f: pa.array([r[i] for r in found], kinds.get(f, pa.string())) for i, f in enumerate(_FIELDS)})

    return spread(files).mapInArrow(run, ROW)


def nodes(parsed: DataFrame) -> DataFrame:
    """id, type, name, path, ord..., in order of path and place."""
    kinds = {"file": 0, "class": 1, "function": 2}
    n = parsed.where(F.col("kind").isin(*kinds))
    rank = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("kind")]
    return n.select("id", F.col("kind").alias("type"), "name", "path", F.struct("path", rank.alias("r"), "start_line", "id").alias("ord"), "start_line", "end_line", "docstring", F.when(F.col("kind") == "function", F.col("ref")).alias("signature"), F.col("value").alias("complexity"))


def candidates(path: Column, ref: Column, level: Column) -> Column:
    """The four files that an import may mean, in order; ``from .m import x`` looks from its level's folder."""
    mod, here, up_by = F.regexp_replace(ref, r"\.", "/"), dirname(path), F.coalesce(level, F.lit(0))
    up = F.aggregate(F.sequence(F.lit(1), F.greatest(up_by.cast("int"), F.lit(1))), here, lambda d, k: F.when(k == 1, d).otherwise(dirname(d)))
    root = F.when(up_by > 0, up).otherwise("")
    near = F.when(up_by > 0, up).otherwise(here)
    return F.array(join_path(near, F.concat(mod, F.lit(".py"))), join_path(near, F.concat(mod, F.lit("/__init__.py"))), join_path(root, F.concat(mod, F.lit(".py"))), join_path(root, F.concat(mod, F.lit("/__init__.py"))))


def resolve_imports(refs: DataFrame, files: DataFrame) -> DataFrame:
    """path, ref, line, target: the first of four candidate files that exists; unresolved imports are external and left out."""
    c = refs.select("path", "ref", F.col("start_line").alias("line"), F.posexplode(candidates(F.col("path"), F.col("ref"), F.col("value"))).alias("k", "target"))
    known = files.select(F.col("path").alias("target")).distinct()
    return c.join(known, "target").groupBy("path", "ref", "line").agg(F.min_by("target", "k").alias("target"))


def edges(parsed: DataFrame) -> DataFrame:
    """source, target, type, line of imports, calls and bases, before the integrity check."""
    files = parsed.where("kind = 'file'")
    imports = resolve_imports(parsed.where("kind = 'import'"), files).select(F.col("path").alias("source"), "target", F.lit("IMPORTS").alias("type"), "line")
    named = parsed.where("kind IN ('call', 'extends')").select(F.col("id").alias("source"), F.col("ref").alias("target"), F.when(F.col("kind") == "call", "CALLS").otherwise("EXTENDS").alias("type"), F.col("start_line").alias("line"))
    return imports.unionByName(named)


def predicted_uses(parsed: DataFrame) -> DataFrame:
    """a, b: file b uses file a, by module suffixes it imports, names it calls and bases it extends."""
    path = F.regexp_replace("path", r"\.py", "")
    parts = F.split(path, "/")
    modules = parsed.where("kind = 'file'").select(F.col("path").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("name"))
    imported = parsed.where("kind = 'import'").select(F.col("path").alias("b"), F.explode(F.array("ref", F.split("ref", r"\.")[0])).alias("name")).distinct()
    functions = parsed.where("kind = 'definition'").select(F.col("path").alias("a"), "name").distinct()
    called = parsed.where("kind IN ('call', 'toplevel_call')").select(F.col("path").alias("b"), F.element_at(F.split("ref", r"\."), -1).alias("name")).distinct()
    classes = parsed.where("kind = 'class'").select(F.col("path").alias("a"), "name").distinct()
    based = parsed.where("kind = 'extends'").select(F.col("path").alias("b"), F.element_at(F.split("ref", r"\."), -1).alias("name")).distinct()
    uses = modules.join(imported, "name").union(functions.join(called, "name")).union(classes.join(based, "name"))
    return uses.select("a", "b").where("a <> b").distinct()


def classify(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """id, state of a re-parsed file: updated if it is new or touches a changed line (path, line), else unchanged; deleted if gone."""
    touched = new.join(changed, (new["path"] == changed["path"]) & changed["line"].between(new["start_line"], new["end_line"]), "left_semi").select("id").distinct().withColumn("hit", F.lit(True))
    both = old.select("id", F.lit(True).alias("was")).join(new.select("id", F.lit(True).alias("is")), "id", "full").join(touched, "id", "left")
    return both.select("id", F.when(F.col("is").isNull(), "deleted").when(F.col("was").isNull() | F.col("hit"), "updated").otherwise("unchanged").alias("state"))
