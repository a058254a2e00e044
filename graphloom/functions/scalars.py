"""Column expressions for paths, names, tokens and scores."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import COMPLEXITY_RANKS, CRITICALITY, CRITICALITY_ELSE, LANGUAGES, RANK_WEIGHTS


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise("")


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def join_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat_ws("/", folder, name))


def extension(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(names[extension(path)], F.lit("text"))


def glob_regex(pattern: str) -> str:
    """A Java regular expression for a shell pattern (``*`` crosses slashes)."""
    out = fnmatch.translate(pattern)
    return re.sub(r"\\[zZ]$|\)\\[zZ]$", lambda m: ")" if m.group().startswith(")") else "", out).replace("(?s:", "^(?s:", 1) + "$"


def first_pattern(path: Column, patterns: list[str]) -> Column:
    """Include/exclude list: the first matching pattern decides, ``!`` negates, no match excludes."""
    if not patterns:
        return F.lit(True)
    out = None
    for p in patterns:
        hit, keep = path.rlike(glob_regex(p.removeprefix("!"))), F.lit(not p.startswith("!"))
        out = F.when(hit, keep) if out is None else out.when(hit, keep)
    return out.otherwise(False)


def estimated_tokens(n_chars: Column, chars_per_token: float = 4.0) -> Column:
    return F.floor(n_chars / F.lit(chars_per_token)).cast("long")


def criticality(type_: Column, name: Column) -> Column:
    low, out = F.lower(name), None
    for kind, (patterns, default) in CRITICALITY.items():
        own = None
        for p, w in patterns:
            own = F.when(low.contains(p), w) if own is None else own.when(low.contains(p), w)
        own = own.otherwise(default)
        out = F.when(type_ == kind, own) if out is None else out.when(type_ == kind, own)
    return out.otherwise(CRITICALITY_ELSE)


def frequency_score(freq: Column, n_files: Column) -> Column:
    return F.when(n_files == 0, 0.5).otherwise(F.least(F.ln(freq + 1) / F.ln(n_files + 1), F.lit(1.0)))


def token_efficiency(tokens: Column) -> Column:
    return F.when(tokens <= 0, 0.0).otherwise(F.least(F.lit(2.0) / F.ln(tokens + 1), F.lit(1.0)))


def combined(semantic: Column, graph: Column, crit: Column, freq: Column, eff: Column) -> Column:
    w = RANK_WEIGHTS
    return F.least(F.lit(1.0), w["semantic"] * semantic + w["graph"] * graph + w["criticality"] * crit + w["frequency"] * freq + w["efficiency"] * eff)


def path_distance(a: Column, b: Column) -> Column:
    """Estimated distance of two node ids (``path::name``): 0 same id, 1 same file, else by directories, at most 10."""
    pa, pb = F.split(F.split(a, "::")[0], "/"), F.split(F.split(b, "::")[0], "/")
    same = F.transform(F.arrays_zip(pa.alias("x"), pb.alias("y")), lambda z: z["x"] == z["y"])
    common = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, e: F.struct((acc["n"] + F.when(acc["go"] & F.coalesce(e, F.lit(False)), 1).otherwise(0)).alias("n"), (acc["go"] & F.coalesce(e, F.lit(False))).alias("go")), lambda acc: acc["n"])
    far = F.least(F.lit(10), F.greatest(F.lit(2), 5 - common + F.abs(F.size(pa) - F.size(pb))))
    return F.when(a == b, 0).when(F.split(a, "::")[0] == F.split(b, "::")[0], 1).otherwise(far).cast("int")


def complexity_rank(value: Column) -> Column:
    out = None
    for rank, most in COMPLEXITY_RANKS:
        out = F.when(value <= most, rank) if out is None else out.when(value <= most, rank)
    return out.otherwise("F")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def snippet(text: Column, most: int = 100) -> Column:
    """At most ``most`` characters: cut at the last newline if that is beyond 70 % of them, else with dots."""
    head = F.substring(text, 1, most)
    at = F.lit(most) - F.instr(F.reverse(head), "\n")  # 0-based place of the last newline
    cut = F.when(head.contains("\n") & (at > int(most * 0.7)), F.substring(head, F.lit(1), at)).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(text) <= most, text).otherwise(cut)
