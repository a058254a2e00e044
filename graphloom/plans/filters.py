"""Filters, predicates, projections and lookups."""

from pyspark.sql import functions as F

from ..functions.scalars import extension, first_pattern
from ..operators.impact import critical
from ..operators.lookup import dangling_edges, default_entries, induced, valid_edges
from ..sources.graph import G, edges, n_rows, nodes
from .registry import query

#: Synthetic source paths of the documents table: folders, test files and extensions.
PATHS = "concat('src/', source, '/', CASE WHEN doc_id % 4 = 0 THEN 'test_' WHEN doc_id % 7 = 0 THEN 'api/' ELSE '' END, 'f', doc_id, CASE WHEN doc_id % 3 = 0 THEN '.ts' WHEN doc_id % 11 = 0 THEN '_test.py' ELSE '.py' END)"
FILES = f"files AS (SELECT doc_id, {PATHS} AS path, n_chars, text FROM documents)"


def files(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", f"{PATHS} AS path", "n_chars", "text")


@query("node_type_filter", f"WITH {G} SELECT id, type, path FROM nodes WHERE type IN ('class', 'file')")
def _(spark, d):
    return nodes(spark, d).where(F.col("type").isin("class", "file")).select("id", "type", "path")


@query("edge_type_filter", f"WITH {G} SELECT source, target, type, line FROM edges WHERE type IN ('EXTENDS', 'IMPORTS')")
def _(spark, d):
    return edges(spark, d).where(F.col("type").isin("EXTENDS", "IMPORTS")).select("source", "target", "type", "line")


@query("path_contains", f"WITH {G} SELECT id, path FROM nodes WHERE contains(path, 'c:1')")
def _(spark, d):
    return nodes(spark, d).where(F.col("path").contains("c:1")).select("id", "path")


@query("edge_end_contains", f"WITH {G} SELECT source, target, line FROM edges WHERE contains(source, 'o:1') AND contains(target, 'p:')")
def _(spark, d):
    return edges(spark, d).where(F.col("source").contains("o:1") & F.col("target").contains("p:")).select("source", "target", "line")


@query("induced_subgraph", f"WITH {G}, k AS (SELECT DISTINCT id FROM nodes WHERE type <> 'function') SELECT source, target, type FROM edges WHERE source IN (FROM k) AND target IN (FROM k)")
def _(spark, d):
    return induced(edges(spark, d), nodes(spark, d).where("type <> 'function'"), n_rows(spark, d)).select("source", "target", "type")


@query("integrity_valid", f"WITH {G}, k AS (SELECT id FROM nodes WHERE ord % 5 <> 0) SELECT source, target, type, line FROM edges WHERE target IN (FROM k)")
def _(spark, d):
    return valid_edges(edges(spark, d), nodes(spark, d).where("ord % 5 <> 0"), n_rows(spark, d)).select("source", "target", "type", "line")


@query("integrity_dangling", f"WITH {G}, k AS (SELECT id FROM nodes WHERE ord % 5 <> 0) SELECT source, target, type, line FROM edges WHERE target NOT IN (FROM k)")
def _(spark, d):
    return dangling_edges(edges(spark, d), nodes(spark, d).where("ord % 5 <> 0"), n_rows(spark, d)).select("source", "target", "type", "line")


@query("search_filters", f"WITH {FILES} SELECT doc_id, path FROM files WHERE list_contains(['py', 'go'], lower(string_split(path, '.')[-1])) AND (contains(path, 'src1') OR contains(path, 'api/'))")
def _(spark, d):
    wanted = F.array(F.lit("src1"), F.lit("api/"))
    return files(spark, d).where(extension(F.col("path")).isin("py", "go") & F.exists(wanted, lambda w: F.col("path").contains(w))).select("doc_id", "path")


@query(
    "test_file_predicates",
    f"""WITH {FILES} SELECT path, contains(lower(path), 'test') OR ends_with(path, '_test.py') AS by_name,
    regexp_matches(path, '^(test_|tests/|test/)') OR contains(lower(path), 'test') AS by_prefix, contains(path, 'test_') OR contains(path, 'tests/') AS by_part,
    regexp_matches(string_split(path, '/')[-1], 'test|spec') AS by_file FROM files""",
)
def _(spark, d):
    p = F.col("path")
    low = F.lower(p).contains("test")
    return files(spark, d).select("path", (low | p.endswith("_test.py")).alias("by_name"), (p.rlike("^(test_|tests/|test/)") | low).alias("by_prefix"), (p.contains("test_") | p.contains("tests/")).alias("by_part"), F.element_at(F.split(p, "/"), -1).rlike("test|spec").alias("by_file"))


@query("glob_first_match", f"WITH {FILES} SELECT path FROM files WHERE CASE WHEN path GLOB '*/test_*' THEN false WHEN path GLOB 'src/*.py' THEN true WHEN path GLOB '*[0-4].ts' THEN true ELSE false END")
def _(spark, d):
    return files(spark, d).where(first_pattern(F.col("path"), ["!*/test_*", "src/*.py", "*[0-4].ts"])).select("path")


@query("owned_rows", f"WITH {G} SELECT id, repo_id FROM nodes WHERE repo_id = 'repo1'")
def _(spark, d):
    return nodes(spark, d).where("repo_id = 'repo1'").select("id", "repo_id")


@query("without_code", f"WITH {FILES} SELECT doc_id, path, n_chars FROM files")
def _(spark, d):
    return files(spark, d).drop("text")


@query("usage_range", "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").where("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-12'").select("event_id", "user_id")


@query("rolling_period", "SELECT p AS period, count(*) AS n FROM events, (VALUES ('day', 1), ('week', 7), ('month', 30)) v(p, k) WHERE ts >= (SELECT max(ts) FROM events) - to_days(k) GROUP BY p")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("ts")
    last = e.agg(F.max("ts").alias("last")).first().last
    since = [F.when(F.col("ts") >= F.lit(last) - F.expr(f"INTERVAL {k} DAY"), F.lit(p)) for p, k in (("day", 1), ("week", 7), ("month", 30))]
    return e.select(F.explode(F.array(*since)).alias("period")).where("period IS NOT NULL").groupBy("period").agg(F.count("*").alias("n"))


@query("stale_repos", "SELECT user_id, max(ts) AS last_sync_at FROM events GROUP BY user_id HAVING max(ts) FILTER (WHERE event_type = 'signup') < TIMESTAMP '2024-01-20' OR max(ts) FILTER (WHERE event_type = 'signup') IS NULL")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    s = e.groupBy("user_id").agg(F.max("ts").alias("last_sync_at"), F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).alias("s"))
    return s.where("s < TIMESTAMP_NTZ '2024-01-20' OR s IS NULL").select("user_id", "last_sync_at")


@query("critical_files", f"WITH {FILES} SELECT path, contains(path, '__init__.py') OR contains(path, 'main.py') OR contains(path, 'app.py') OR contains(path, 'api/') OR contains(path, 'core/') OR contains(path, 'config/') AS critical FROM files")
def _(spark, d):
    return files(spark, d).select("path", critical(F.col("path")).alias("critical"))


@query("graph_text_search", f"WITH {G} SELECT id, CASE WHEN contains(lower(name), 'get') THEN length(name) ELSE 0 END::INT AS rank_key, 0.8::DOUBLE AS score FROM nodes WHERE contains(lower(name || ' ' || path), 'get')")
def _(spark, d):
    hit = nodes(spark, d).where(F.lower(F.concat_ws(" ", "name", "path")).contains("get"))
    key = F.when(F.lower("name").contains("get"), F.length("name")).otherwise(0).cast("int")
    return hit.select("id", key.alias("rank_key"), F.lit(0.8).alias("score"), "ord").orderBy(F.desc("rank_key"), "ord").drop("ord")


@query("ui_search", f"WITH {G} SELECT id, name FROM nodes WHERE contains(lower(name), 'ar') OR contains(lower(path), 'ar') ORDER BY ord LIMIT 10")
def _(spark, d):
    return nodes(spark, d).where(F.lower("name").contains("ar") | F.lower("path").contains("ar")).orderBy("ord").limit(10).select("id", "name")


@query("entry_point_lookup", f"WITH {G} SELECT id, type, path FROM nodes WHERE id = 'c:7' ORDER BY ord LIMIT 1")
def _(spark, d):
    return nodes(spark, d).where("id = 'c:7'").orderBy("ord").limit(1).select("id", "type", "path")


@query("line_explode", "SELECT doc_id, i::INT AS pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("default_entry_points", f"WITH {G} SELECT id, path FROM nodes WHERE path IN ('main.py', 'r:3', 'n:7', 'r:0') ORDER BY list_position(['main.py', 'r:3', 'n:7', 'r:0'], path), ord LIMIT 12")
def _(spark, d):
    return default_entries(nodes(spark, d), ["main.py", "r:3", "n:7", "r:0"], 12).select("id", "path")
