"""Text that git prints, as rows. The commands run on the driver, where the repository is; parsing is relational."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = {"A": "added", "M": "modified", "D": "deleted"}


def run(repo: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, timeout=120)
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.strip()}")
    return done.stdout


def lines(spark: SparkSession, text: str) -> DataFrame:
    """ord, line."""
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "ord long, line string")


def name_status(raw: DataFrame, renames_as_modified: bool = True) -> DataFrame:
    """path, change_type, old_path of ``--name-status`` lines. Renames count as two modified paths, or as one renamed path."""
    p = raw.where("line <> ''").select("ord", F.split("line", "\t").alias("p"))
    code = F.substring(F.col("p")[0], 1, 1)
    kinds = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    if renames_as_modified:
        pairs = F.when(code == "R", F.array(*[F.struct(F.col("p")[i].alias("path"), F.lit("modified").alias("change_type")) for i in (1, 2)])).when(kinds[code].isNotNull(), F.array(F.struct(F.col("p")[1].alias("path"), kinds[code].alias("change_type"))))
        return p.select(F.explode(pairs).alias("x")).select("x.path", "x.change_type", F.lit(None).cast("string").alias("old_path"))
    return p.select(F.when(code == "R", F.col("p")[2]).otherwise(F.col("p")[1]).alias("path"), F.when(code == "R", "renamed").otherwise(F.coalesce(kinds[code], F.lit("modified"))).alias("change_type"), F.when(code == "R", F.col("p")[1]).alias("old_path"))


def diff_stats(raw: DataFrame) -> DataFrame:
    """files, insertions, deletions of the last line of ``--stat``; 0 where not named."""
    last = raw.where("trim(line) <> ''").agg(F.max_by("line", "ord").alias("l"))
    n = lambda p: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("l", p, 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    return last.select(n(r"(\d+) files? changed").alias("files"), n(r"(\d+) insertion").alias("insertions"), n(r"(\d+) deletion").alias("deletions"))


def changed_lines(raw: DataFrame) -> DataFrame:
    """kind (added/removed), line: line numbers of unified diffs of one file, by running counts inside each hunk."""
    at = r"^@@ -(\d+)(?:,\d+)? \+(\d+)"
    x = raw.selectExpr("ord", "line", "sum(CASE WHEN line LIKE '@@%' THEN 1 ELSE 0 END) OVER (ORDER BY ord) AS hunk").where("hunk > 0")
    heads = x.where("line LIKE '@@%'").select("hunk", F.regexp_extract("line", at, 1).cast("int").alias("old0"), F.regexp_extract("line", at, 2).cast("int").alias("new0"))
    body = x.where("line NOT LIKE '@@%' AND line NOT LIKE '\\\\%' AND line NOT LIKE '+++%' AND line NOT LIKE '---%' AND line <> ''").selectExpr(
        "hunk", "ord", "substr(line, 1, 1) AS c",
        "coalesce(sum(CASE WHEN substr(line, 1, 1) <> '+' THEN 1 ELSE 0 END) OVER (PARTITION BY hunk ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS olds",
        "coalesce(sum(CASE WHEN substr(line, 1, 1) <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY hunk ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS news",
    )
    y = body.join(heads, "hunk")
    return y.where("c IN ('+', '-')").select(F.when(F.col("c") == "+", "added").otherwise("removed").alias("kind"), F.when(F.col("c") == "+", F.col("new0") + F.col("news")).otherwise(F.col("old0") + F.col("olds")).cast("int").alias("line"))


def blame_lines(raw: DataFrame) -> DataFrame:
    """author, ord: the author of each line of ``blame --line-porcelain``."""
    return raw.where("line LIKE 'author %'").select(F.expr("substr(line, 8)").alias("author"), "ord")


def head(spark: SparkSession, repo: str) -> DataFrame:
    """branch, sha, tag (nearest, or null)."""
    try:
        tag = run(repo, "describe", "--tags", "--abbrev=0").strip()
    except RuntimeError:
        tag = None
    return spark.createDataFrame([(run(repo, "rev-parse", "--abbrev-ref", "HEAD").strip(), run(repo, "rev-parse", "HEAD").strip(), tag)], "branch string, sha string, tag string")


def commits(spark: SparkSession, repo: str, since: str = "90 days ago") -> DataFrame:
    """sha, author, at (seconds), path."""
    rows, now = [], None
    for x in run(repo, "log", f"--since={since}", "--name-only", "--format=%x01%H%x02%an%x02%at").split("\n"):
        if x.startswith("\x01"):
            now = x[1:].split("\x02")
        elif x and now:
            rows.append((now[0], now[1], int(now[2]), x))
    return spark.createDataFrame(rows, "sha string, author string, at long, path string")
