"""Compositions: context pipeline, incremental reports, directory figures, comments and token counts."""

from pyspark.sql import functions as F

from ..api import CodeGraph
from ..functions.scalars import dirname
from ..operators import budget, extract, formats, impact, ranking, sync, tokens, traverse
from ..sources.graph import G, edges, nodes
from .extraction import SUP, sources
from .filters import FILES, files
from .graphs import FG, R
from .registry import query


@query(
    "context_pipeline",
    f"""{R}r(id, depth) AS (SELECT 'c:5', 0 UNION SELECT CASE WHEN e.source = r.id THEN e.target ELSE e.source END, depth + 1 FROM r JOIN edges e ON e.source = r.id OR e.target = r.id WHERE depth < 2),
m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id), s AS (SELECT 'o:' || doc_id AS fqn, (doc_id * 37 % 100) / 100.0 AS s FROM documents)
SELECT m.id, m.depth::INT AS depth, coalesce(s, 0)::DOUBLE AS semantic_score, round(0.4 * pow(0.8, depth) + 0.6 * coalesce(s, 0), 6)::DOUBLE AS score FROM m LEFT JOIN s ON s.fqn = m.id""",
)
def _(spark, d):
    g = CodeGraph.tables(spark, d)
    found = traverse.decayed(traverse.reach(traverse.arcs(g.edges, "both"), spark.createDataFrame([("c:5",)], "id string"), 2))
    s = spark.read.parquet(f"{d}/documents.parquet").selectExpr("concat('o:', doc_id) AS fqn", "(doc_id * 37 % 100) / 100.0D AS s")
    x = ranking.fuse(found.selectExpr("id AS fqn", "score AS g"), s)
    return found.select("id", "depth").join(x.withColumnRenamed("fqn", "id"), "id").select("id", "depth", "semantic_score", F.round("score", 6).alias("score"))


@query("context_selection")
def _(spark, d):
    g = CodeGraph.tables(spark, d)
    s = spark.read.parquet(f"{d}/documents.parquet").selectExpr("concat('o:', doc_id) AS fqn", "(doc_id * 37 % 100) / 100.0D AS s")
    return g.context(spark.createDataFrame([("c:5",)], "id string"), s, 2, 700)[1].select("id", "taken")


@query("adaptive_budget")
def _(spark, d):
    n = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id AS ord", "doc_id % 20 AS req", "(doc_id * 37 % 100) / 100.0D AS score", "n_chars div 4 AS tokens")
    return budget.adaptive(n, 3000)


@query("node_signatures", f"WITH {SUP} SELECT 'C' || s_suppkey || '::run' AS id, 'run(self, x)' AS signature FROM sup UNION ALL SELECT 'helper_' || s_suppkey, 'helper_' || s_suppkey || '(x)' FROM sup")
def _(spark, d):
    return extract.nodes(extract.rows(sources(spark, d))).where("type = 'function'").select("id", "signature")


@query("partial_analysis", f"WITH {SUP} SELECT 'helper_' || s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'deleted' WHEN s_suppkey % 3 = 0 OR s_suppkey % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS state FROM sup")
def _(spark, d):
    all_ = extract.nodes(extract.rows(sources(spark, d))).where("id LIKE 'helper%'").withColumn("k", F.regexp_extract("id", r"(\d+)$", 1).cast("int"))
    changed = all_.where("k % 5 = 0").select("path", (F.col("start_line") + 1).alias("line"))
    return extract.classify(all_.where("k % 3 <> 0 OR k % 4 = 0"), all_.where("k % 4 <> 0"), changed)


@query("directory_complexity", f"WITH {FILES} SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, count(*) AS n, round(avg(n_chars % 50), 6)::DOUBLE AS mean, max(n_chars % 50) AS most FROM files GROUP BY 1")
def _(spark, d):
    c = F.col("n_chars") % 50
    return files(spark, d).groupBy(dirname(F.col("path")).alias("dir")).agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("mean"), F.max(c).alias("most"))


@query("pr_comments", f"WITH {G}, {FG}, d AS (SELECT path, count(DISTINCT by_path) AS n FROM f WHERE path <> by_path GROUP BY path) SELECT path, '## Impact' || chr(10) || CASE WHEN n <= 5 THEN '🟢 risk: low' ELSE '🟡 risk: medium' END || chr(10) || '- impacted files: ' || n || ' (' || n || ' direct)' || chr(10) || '- tests to run: 0' AS comment FROM d")
def _(spark, d):
    from ..operators.lookup import file_graph

    f = file_graph(edges(spark, d), nodes(spark, d)).where("path <> by_path").select("path", "by_path").distinct().groupBy("path").agg(F.count("*").alias("n"))
    x = f.select("path", impact.pr_risk(F.col("n"), F.lit(1), F.lit(False)).alias("risk"), F.col("n").alias("n_impacted"), F.col("n").alias("n_direct"), F.lit(0).alias("n_tests"))
    return x.select("path", formats.comment_text().alias("comment"))


@query("entry_point_glob", f"WITH {G} SELECT id FROM nodes WHERE path GLOB 'c:1?5*'")
def _(spark, d):
    return CodeGraph.tables(spark, d).entry_points("c:1?5*").select("id")


@query("change_report", f"WITH {G} SELECT 0::BIGINT AS files_added, 1::BIGINT AS files_modified, 0::BIGINT AS files_deleted, 1::BIGINT AS files_renamed, (SELECT count(*) FROM nodes WHERE path IN ('n:1', 'n:2')) AS nodes_deleted, (SELECT count(*) FROM nodes WHERE path = 'n:1') AS nodes_added")
def _(spark, d):
    n, e = nodes(spark, d).select("id", "path"), edges(spark, d)
    changes = spark.createDataFrame([("n:1", "modified", None), ("n:9999", "renamed", "n:2")], "path string, change_type string, old_path string")
    new = n.where("path = 'n:1'").select(F.concat("id", F.lit("_new")).alias("id"), "path")
    return sync.change_counts(changes, n, sync.apply_changes(n, e, changes, new, e.limit(0))[0])


@query("xml_items", f"WITH {G} SELECT id, '  <file path=\"' || path || '\">' || chr(10) || '    <' || type || ' name=\"' || name || '\" lines=\"' || coalesce(start_line, 0) || '-' || coalesce(end_line, 0) || '\">' || chr(10) || '      <![CDATA[]]>' || chr(10) || '    </' || type || '>' || chr(10) || '  </file>' AS text FROM nodes")
def _(spark, d):
    n = nodes(spark, d).withColumns({"content": F.lit(None).cast("string"), "ord": F.col("id")})
    return formats.xml_items(n).withColumnRenamed("ord", "id")


@query("plain_items", f"WITH {FILES} SELECT doc_id, '# ' || path || ':' || (doc_id % 9) || chr(10) || text || chr(10) AS text FROM files")
def _(spark, d):
    return formats.plain_items(files(spark, d).selectExpr("doc_id AS ord", "path", "doc_id % 9 AS start_line", "text AS content")).withColumnRenamed("ord", "doc_id")


@query("bpe_token_counts")
def _(spark, d):
    import public_tokenizers

    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return tokens.count_tokens(docs, "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "tokens")
