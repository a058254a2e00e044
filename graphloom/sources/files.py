"""Source files: scans, ignore patterns, text decoding, configuration."""

from __future__ import annotations

import copy
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import SKIPPED_DIRS


def gitwild_regex(pattern: str) -> str | None:
    """Java regular expression on a relative path for one gitignore line; None for blanks and comments."""
    p = pattern.strip()
    if not p or p.startswith("#"):
        return None
    p = p.removeprefix("!")
    only_dir, rooted = p.endswith("/"), "/" in p.strip("/") or p.startswith("/")
    out = ""
    for part in re.split(r"(\*\*/|/\*\*|\*|\?|\[[^\]]*\])", p.strip("/")):
        out += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part if part.startswith("[") and part.endswith("]") else re.escape(part))
    return ("^" if rooted else "(?:^|/)") + out + ("/" if only_dir else "(?:/|$)")


def ignored(path: Column, patterns: list[str]) -> Column:
    """The last pattern that matches decides; ``!`` takes back."""
    out = F.lit(False)
    for p in patterns:
        if r := gitwild_regex(p):
            out = F.when(path.rlike(r), not p.strip().startswith("!")).otherwise(out)
    return out


def ignore_patterns(config: list[str], ignore_file: str | None = None) -> list[str]:
    """Built-in folders, then the configured patterns, then those of an ignore file."""
    own = []
    if ignore_file and os.path.exists(ignore_file):
        with open(ignore_file, encoding="utf-8") as f:
            own = [x.rstrip("\n") for x in f]
    return [*[f"{d}/" for d in SKIPPED_DIRS], *config, *own]


def _empty_files(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> list[str]:
    """Paths of files without a byte, from the file system's listing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    it, out = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True), []
    while it.hasNext():
        f = it.next()
        if f.getLen() == 0 and f.getPath().getName().rpartition(".")[2] in extensions:
            out.append(f.getPath().toString())
    return out


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None, extensions: tuple[str, ...] = ("py",)) -> DataFrame:
    """path (relative), content, length of the files under ``root``, without those that ``patterns`` ignore."""
    glob = "*." + (extensions[0] if len(extensions) == 1 else "{" + ",".join(extensions) + "}")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    plain = lambda p: re.sub(r"^\w+:/*(?=/)", "", str(p)).rstrip("/")
    cut = len(plain(root)) + 2
    strip = lambda c: F.expr(f"substr(regexp_replace({c}, '^[a-z]+:/*(?=/)', ''), {cut})")
    df = raw.select(strip("path").alias("path"), "content", "length")
    if empty := _empty_files(spark, root, extensions):  # Spark's readers leave these out
        df = df.union(spark.createDataFrame([(p, b"", 0) for p in empty], "path string, content binary, length long").select(strip("path"), "content", "length"))
    return df.where(~ignored(F.col("path"), ignore_patterns([]) if patterns is None else patterns))


def is_binary(content: Column) -> Column:
    """A NUL byte in the first 8 KiB."""
    return F.contains(F.substring(content, 1, 8192), F.lit(b"\x00"))


def text_of(content: Column) -> Column:
    """UTF-8 text, Latin-1 where that isn't valid; null for binary content."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.when(~is_binary(content), F.coalesce(utf8, F.decode(content, "ISO-8859-1")))


def text_lines(files: DataFrame) -> DataFrame:
    """path, line (from 1), text."""
    return files.select("path", F.posexplode(F.split(text_of(F.col("content")), "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


DEFAULTS = {"analyzer": {"ignore": [], "languages": ["python"], "max_file_mb": 10}, "context": {"depth": 2, "max_nodes": 50, "format": "markdown"}, "server": {"rate_limit": 60}, "token_budget": {"model": "gpt-4", "strategy": "adaptive", "reserve": 500}}


def _merged(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = _merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def env_value(v: str) -> object:
    """Booleans, numbers and comma lists of an environment variable."""
    if v.lower() in ("true", "false"):
        return v.lower() == "true"
    for kind in (int, float):
        try:
            return kind(v)
        except ValueError:
            pass
    return [x.strip() for x in v.split(",")] if "," in v else v


def load_config(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "GRAPHLOOM__", cli: dict | None = None) -> dict:
    """Defaults, then the YAML (or JSON) file, then ``PREFIX + A__B`` variables, then the command line."""
    out = copy.deepcopy(DEFAULTS)
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        try:
            import yaml

            out = _merged(out, yaml.safe_load(text) or {})
        except ModuleNotFoundError:
            import json

            out = _merged(out, json.loads(text or "{}"))
    for k, v in sorted((os.environ if env is None else env).items()):
        if k.startswith(prefix):
            own: object = env_value(v)
            for part in reversed(k[len(prefix) :].lower().split("__")):
                own = {part: own}
            out = _merged(out, own)
    return _merged(out, cli or {})
