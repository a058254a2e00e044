"""Merges, change streams and states as batch queries; the streaming operators are tested against these."""

from pyspark.sql import functions as F

from ..operators import diff, incremental, sync, usage
from ..operators.formats import escaped, markdown_by_file
from ..plugins import choose
from ..sources.graph import G, edges, nodes
from ..streaming import webhooks
from .extraction import source_files, sources
from .filters import FILES, files
from .graphs import FG
from .registry import query


@query("upsert_latest", "WITH b AS (SELECT o_custkey AS k, min(o_orderkey) AS v FROM orders GROUP BY 1), n AS (SELECT o_custkey + 5 AS k, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT k, v FROM n UNION ALL SELECT k, v FROM b WHERE k NOT IN (SELECT k FROM n)")
def _(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    base = o.groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("v"))
    new = o.where("o_orderkey % 3 = 0").select((F.col("o_custkey") + 5).alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderkey").alias("ord"))
    return diff.upsert(base, new, ["k"]).select("k", "v")


@query("delete_touching", f"WITH {G} SELECT source, target, type FROM edges WHERE NOT (source = 'n:4' OR target = 'n:4')")
def _(spark, d):
    e = edges(spark, d)
    return e.join(sync.touching(e, "n:4").select("ord"), "ord", "left_anti").select("source", "target", "type")


@query("external_placeholders", f"WITH {G}, k AS (SELECT id, type, name FROM nodes WHERE ord % 5 <> 0) SELECT id, type, name FROM k UNION ALL SELECT DISTINCT target, 'external', target FROM edges WHERE target NOT IN (SELECT id FROM k)")
def _(spark, d):
    return sync.with_placeholders(nodes(spark, d).where("ord % 5 <> 0").select("id", "type", "name"), edges(spark, d))


@query("service_registry", "WITH a AS (SELECT -1 AS ord, c_custkey AS service_id, c_custkey AS repo_id, c_name AS name FROM customer UNION ALL SELECT o_orderkey, o_custkey, o_custkey + o_orderkey % 3, o_orderpriority FROM orders) SELECT service_id, repo_id, name FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.service_id = a.service_id AND b.ord > a.ord) AND NOT EXISTS (SELECT 1 FROM a b WHERE b.repo_id = a.repo_id AND b.ord > a.ord)")
def _(spark, d):
    base = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("service_id"), F.col("c_custkey").alias("repo_id"), F.col("c_name").alias("name"))
    saved = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("service_id"), (F.col("o_custkey") + F.col("o_orderkey") % 3).alias("repo_id"), F.col("o_orderpriority").alias("name"))
    return sync.replace_services(base, saved)


@query("migrated_edges", f"WITH {G} SELECT e.source, e.target, a.ord AS source_ord, b.ord AS target_ord FROM edges e JOIN nodes a ON e.source = a.id JOIN nodes b ON e.target = b.id WHERE e.type = 'IMPORTS'")
def _(spark, d):
    return sync.migrate(edges(spark, d).where("type = 'IMPORTS'"), nodes(spark, d)).select("source", "target", "source_ord", "target_ord")


@query("incremental_update", f"WITH {G}, g AS (SELECT id FROM nodes WHERE path IN ('n:1', 'n:2')), n AS (SELECT id, path FROM nodes WHERE path NOT IN ('n:1', 'n:2') UNION ALL SELECT id || '_new', 'n:1' FROM nodes WHERE path = 'n:1') SELECT id, path FROM n")
def _(spark, d):
    n, e = nodes(spark, d).select("id", "path", "ord"), edges(spark, d)
    changes = spark.createDataFrame([("n:1", "modified", None), ("n:9999", "renamed", "n:2")], "path string, change_type string, old_path string")
    new = n.where("path = 'n:1'").select(F.concat("id", F.lit("_new")).alias("id"), "path", "ord")
    return sync.apply_changes(n, e, changes, new, e.limit(0))[0].select("id", "path")


EDITED = """WITH sup AS (SELECT s_suppkey + 1 AS k FROM supplier), f AS (
  SELECT k, CASE WHEN k % 5 = 0 THEN 2 ELSE 1 END AS step, CASE WHEN k % 5 = 0 THEN 'aid_' ELSE 'helper_' END AS own FROM sup WHERE k % 7 <> 0
  UNION ALL SELECT k + 1000000, 1, 'helper_' FROM sup WHERE k % 7 = 0)"""


@query("incremental_edges", f"""{EDITED}
SELECT 'pkg/m' || f.k || '.py' AS source, 'pkg/m' || g.k || '.py' AS target, 'IMPORTS' AS type, 1 AS line FROM f JOIN f g ON g.k = f.k - f.step
UNION ALL SELECT 'C' || f.k, 'C' || g.k, 'EXTENDS', 4 FROM f JOIN f g ON g.k = f.k - f.step
UNION ALL SELECT 'C' || f.k || '::run', 'helper_' || g.k, 'CALLS', 8 FROM f JOIN f g ON g.k = f.k - f.step AND g.own = 'helper_'
UNION ALL SELECT f.own || f.k, 'helper_' || g.k, 'CALLS', 12 FROM f JOIN f g ON g.k = f.k - f.step AND g.own = 'helper_'""")
def _(spark, d):
    """Files of every seventh supplier are deleted and come again under new names, every fifth is rewritten."""
    graph = incremental.RepoGraph.build(sources(spark, d))
    k = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    all_ = sources(spark, d).select("path", k.alias("k"))
    gone, edited = F.col("k") % 7 == 0, (F.col("k") % 5 == 0) & (F.col("k") % 7 != 0)
    changes = all_.where(gone | edited).select("path", F.when(gone, "deleted").otherwise("modified").alias("change_type"), F.lit(None).cast("string").alias("old_path"))
    added = source_files(all_.where(gone).select((F.col("k") + 1_000_000).alias("k")))
    changes = changes.union(added.select("path", F.lit("added"), F.lit(None)))
    new = source_files(all_.where(edited).select("k"), step=2, own="aid_").union(added)
    return incremental.update(graph, changes, new)[0].edges.select("source", "target", "type", "line")


@query("edge_recalc_counts", f"WITH {G}, a AS (SELECT DISTINCT source, target, type FROM edges WHERE ord % 10 <> 0), b AS (SELECT DISTINCT source, target, type FROM edges WHERE ord % 7 <> 0) SELECT (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS added, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS removed, (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS kept")
def _(spark, d):
    e = edges(spark, d)
    return sync.edge_changes(e.where("ord % 10 <> 0"), e.where("ord % 7 <> 0"))


@query("vector_sync", "SELECT vec_id, label FROM embeddings WHERE label NOT IN (1, 2) UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE label = 1")
def _(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").selectExpr("vec_id", "label", "concat('f', label) AS file_path")
    changed = spark.createDataFrame([("f1",), ("f2",)], "path string")
    return sync.sync_vectors(v, changed, v.where("label = 1").withColumn("vec_id", F.col("vec_id") + 1_000_000)).select("vec_id", "label")


@query("sync_status", "SELECT user_id AS repo_id, arg_max(CASE event_type WHEN 'click' THEN 'syncing' WHEN 'view' THEN 'synced' WHEN 'error' THEN 'error' ELSE 'pending' END, event_id) AS state, arg_max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, event_id)::INT AS retry_count FROM events GROUP BY 1")
def _(spark, d):
    u = spark.read.parquet(f"{d}/events.parquet").selectExpr("user_id AS repo_id", "event_id AS ord", "CASE event_type WHEN 'click' THEN 'syncing' WHEN 'view' THEN 'synced' WHEN 'error' THEN 'error' END AS state", "CASE WHEN event_type = 'error' THEN 1 END AS retry_count", "0 AS commits_behind")
    return sync.latest_status(u).select("repo_id", "state", "retry_count")


@query("snapshot_round_trip", f"WITH {G} SELECT type, count(*) AS n, min(id) AS least FROM nodes GROUP BY type")
def _(spark, d):
    from ..scratch import scratch

    root = scratch(spark, "snapshots")
    sync.write_snapshot(nodes(spark, d), edges(spark, d), root, "r1", "abc")
    sync.write_snapshot(nodes(spark, d).where("type = 'file'"), edges(spark, d), root, "r1", "def")
    return sync.read_snapshot(spark, root, "r1", "abc")[0].groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("least"))


@query("versioned_merge", "SELECT user_id AS k, count(*) FILTER (WHERE user_id % 2 = 0) * 0 + CASE WHEN user_id % 2 = 0 THEN max(event_id) ELSE min(event_id) END AS v FROM events GROUP BY 1")
def _(spark, d):
    from ..scratch import scratch

    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"))
    t = sync.Table(spark, scratch(spark, "table"), ["k"])
    t.merge(e.groupBy("k").agg(F.min("v").alias("v")))
    t.merge(e.where("k % 2 = 0").groupBy("k").agg(F.max("v").alias("v")))
    return t.read()


def _webhooks(spark, d):
    body = "concat('{\"ref\":\"refs/heads/b', o_orderkey % 3, '\",\"before\":\"', o_orderkey, '\",\"after\":\"', o_orderkey + 1, '\",\"repository\":{\"full_name\":\"org/r', o_custkey % 10, '\"},\"pusher\":{\"name\":\"u', o_custkey % 7, '\"},\"commits\":[{\"id\":\"c', o_orderkey, '\",\"added\":[\"a.py\"],\"modified\":[\"b.py\",\"a.py\"]}]}')"
    return spark.read.parquet(f"{d}/orders.parquet").selectExpr("cast(o_orderkey AS string) AS delivery_id", "CASE WHEN o_orderkey % 5 = 0 THEN 'ping' ELSE 'push' END AS event", f"{body} AS data")


@query("webhook_normalize", "SELECT o_orderkey::VARCHAR AS delivery_id, 'org/r' || (o_custkey % 10) AS repo, 'b' || (o_orderkey % 3) AS branch, o_orderkey::VARCHAR AS \"before\", 'u' || (o_custkey % 7) AS author, 1 AS n_commits FROM orders WHERE o_orderkey % 5 <> 0")
def _(spark, d):
    return webhooks.normalize(_webhooks(spark, d)).where("event = 'push'").select("delivery_id", "repo", "branch", "before", "author", F.size("commits").alias("n_commits"))


@query("push_snapshots", "SELECT 'org/r' || (o_custkey % 10) AS repo, 'c' || o_orderkey AS sha, 2 AS n_files FROM orders WHERE o_orderkey % 5 <> 0")
def _(spark, d):
    return webhooks.snapshots_of_push(_webhooks(spark, d).where("event = 'push'")).select("repo", "sha", "n_files")


@query("quota_join", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n FROM c WHERE user_id % 4 <> 3 AND n >= 10 * (user_id % 4 + 1)")
def _(spark, d):
    c = usage.events(spark, d).groupBy("user_id").agg(F.count("*").alias("n"))
    limits = c.select("user_id", F.when(F.col("user_id") % 4 == 3, -1).otherwise(10 * (F.col("user_id") % 4 + 1)).alias("most"))
    return webhooks.over_limit(c, limits).select("user_id", "n")


@query("markdown_by_file", f"WITH {FILES}, n AS (SELECT 'src/' || (doc_id % 9) || CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.rs' END AS path, doc_id, doc_id * 7 % 40 AS line, left(text, 40) AS content FROM files), b AS (SELECT path, line, doc_id, '**Function: f' || doc_id || '** (lines ' || line || '-' || (line + 2) || ')' || chr(10) || chr(10) || '```' || CASE WHEN ends_with(path, '.py') THEN 'python' ELSE 'rust' END || chr(10) || content || chr(10) || '```' || chr(10) AS block FROM n) SELECT path, '### ' || path || chr(10) || chr(10) || string_agg(block, chr(10) ORDER BY line, doc_id) AS text FROM b GROUP BY path")
def _(spark, d):
    n = files(spark, d).selectExpr("concat('src/', doc_id % 9, CASE WHEN doc_id % 2 = 0 THEN '.py' ELSE '.rs' END) AS path", "doc_id AS ord", "'function' AS type", "concat('f', doc_id) AS name", "doc_id * 7 % 40 AS start_line", "doc_id * 7 % 40 + 2 AS end_line", "left(text, 40) AS content")
    return markdown_by_file(n).select("path", "text")


@query("xml_escape", "SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", escaped(F.col("html")).alias("escaped"))


@query("plugin_basic_context", f"WITH {G} SELECT id FROM nodes ORDER BY CASE type WHEN 'file' THEN 1 WHEN 'class' THEN 2 ELSE 3 END, ord LIMIT 40")
def _(spark, d):
    n = nodes(spark, d).withColumn("distance", F.when(F.col("type") == "file", 1).when(F.col("type") == "class", 2).otherwise(3))
    return choose("context").rank_nodes(n, "", 4000).select("id")


@query("plugin_basic_impact", f"WITH {G}, {FG}, h AS (SELECT by_path AS path, list_sort(list(DISTINCT edge_type)) AS edge_types FROM f WHERE path = 'r:1' AND by_path <> 'r:1' GROUP BY 1) SELECT path, edge_types, CASE WHEN (SELECT count(*) FROM h) <= 1 THEN 'low' WHEN (SELECT count(*) FROM h) <= 5 THEN 'medium' ELSE 'high' END AS risk FROM h")
def _(spark, d):
    return choose("impact").analyze_impact(["r:1"], nodes(spark, d), edges(spark, d))
