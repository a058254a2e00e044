"""Token estimates, truncation and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("full", "signature", "stub", "reference")


def chars_per_token(model: str) -> float:
    return 3.5 if model.startswith("claude") else 4.0


def estimate(text: Column, model: str = "gpt-4") -> Column:
    return F.floor(F.length(text) / F.lit(chars_per_token(model))).cast("long")


def node_text(path: Column, name: Column, docstring: Column, content: Column) -> Column:
    doc = F.when(docstring.isNotNull() & (docstring != ""), F.concat(F.lit('"""'), docstring, F.lit('"""')))
    return F.concat_ws("\n", F.concat(F.lit("# "), path), name, doc, F.when(content != "", content))


def truncate(text: Column, tokens: Column, model: str = "gpt-4") -> Column:
    """The first characters that ``tokens`` stand for."""
    return F.substring(text, F.lit(1), F.greatest(F.lit(0), F.floor(tokens * chars_per_token(model))).cast("int"))


def summarize(nodes: DataFrame, target: int, model: str = "gpt-4") -> DataFrame:
    """``nodes`` (id, type, name, path, start_line, content) with ``level`` and ``summary``: the fullest form within ``target`` tokens, else a reference."""
    head = F.concat(F.lit("# "), "path", F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("0")))
    full = F.concat_ws("\n", head, F.coalesce("content", F.lit("")))
    body = F.when(F.col("type") == "function", F.concat(F.lit("def "), "name", F.lit("(...):\n    ..."))).when(F.col("type") == "class", F.concat(F.lit("class "), "name", F.lit(":")))
    forms = {"full": full, "signature": F.concat_ws("\n", head, body), "stub": F.concat_ws("\n", head, "name")}
    level = None
    for name, form in forms.items():
        fits = estimate(form, model) <= target
        level = F.when(fits, name) if level is None else level.when(fits, name)
    fqn = F.when(F.col("type") == "file", F.col("path")).otherwise(F.col("id"))
    x = nodes.withColumn("level", level.otherwise("reference"))
    pick = None
    for name, form in forms.items():
        pick = F.when(F.col("level") == name, form) if pick is None else pick.when(F.col("level") == name, form)
    return x.withColumn("summary", pick.otherwise(F.concat(F.lit("# See: "), fqn, F.lit(" in "), "path")))


def count_tokens(df: DataFrame, text: str, ranks: str, pattern: str, scale: float = 1.0) -> DataFrame:
    """``df`` with ``tokens``: byte-pair tokens of column ``text`` by the rank file at ``ranks``, times ``scale``, rounded down (some models count 5 % more)."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        for b in batches:
            n = [int(len(enc.encode_ordinary(t)) * scale) if t else 0 for t in b.column(text).to_pylist()]
            yield b.append_column("tokens", pa.array(n, pa.int64()))

    from pyspark.sql import types as T

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("tokens", T.LongType())]))
