"""Joins and set operations."""

from pyspark.sql import functions as F

from ..functions.constants import FUSION, PLANS, PRESETS
from ..operators import diff, extract, intervals
from ..operators.impact import tests_of
from ..operators.lookup import both_ends, first_nodes
from ..sources.graph import G, edges, nodes
from .filters import FILES, files
from .registry import query

#: Node ids that repeat: orders by the customer's id; ord is the order's.
REPEATED = "dup AS (SELECT 'c:' || o_custkey AS id, o_orderkey AS ord, 'f' || (o_orderkey % 10) AS path FROM orders)"
SCORES = "graph AS (SELECT doc_id AS fqn, round(1.0 / (1 + doc_id % 5), 6) AS g FROM documents WHERE doc_id % 3 <> 0), semantic AS (SELECT doc_id AS fqn, (doc_id * 37 % 100) / 100.0 AS s FROM documents WHERE doc_id % 2 = 0)"


def _dup(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").selectExpr("concat('c:', o_custkey) AS id", "o_orderkey AS ord", "concat('f', o_orderkey % 10) AS path")


def _scores(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    g = docs.where("doc_id % 3 <> 0").selectExpr("doc_id AS fqn", "round(1.0D / (1 + doc_id % 5), 6) AS g")
    return g, docs.where("doc_id % 2 = 0").selectExpr("doc_id AS fqn", "(doc_id * 37 % 100) / 100.0D AS s")


@query("first_match_lookup", f"WITH {G}, {REPEATED}, f AS (SELECT id, arg_min(path, ord) AS path FROM dup GROUP BY id) SELECT e.source, e.target, f.path FROM edges e JOIN f ON e.target = f.id WHERE e.type = 'CALLS'")
def _(spark, d):
    f = first_nodes(_dup(spark, d)).select(F.col("id").alias("target"), "path")
    return edges(spark, d).where("type = 'CALLS'").join(f, "target").select("source", "target", "path")


@query("both_ends_join", f"WITH {G}, f AS (SELECT id, arg_min(path, ord) AS path FROM nodes GROUP BY id) SELECT e.source, e.target, e.line, a.path AS source_path, b.path AS target_path FROM edges e JOIN f a ON e.source = a.id JOIN f b ON e.target = b.id")
def _(spark, d):
    return both_ends(edges(spark, d), nodes(spark, d)).select("source", "target", "line", "source_path", "target_path")


@query("neighbour_join", f"WITH {G}, {REPEATED} SELECT e.source, e.target, dup.ord, dup.path FROM edges e JOIN dup ON e.target = dup.id")
def _(spark, d):
    return edges(spark, d).select("source", "target").join(_dup(spark, d).withColumnRenamed("id", "target"), "target").select("source", "target", "ord", "path")


@query("edges_outside_changes", f"WITH {G}, changed AS (SELECT id FROM nodes WHERE path = 'n:3') SELECT source, target, type FROM edges WHERE target IN (SELECT id FROM changed) AND source NOT IN (SELECT id FROM changed)")
def _(spark, d):
    changed = nodes(spark, d).where("path = 'n:3'").select("id")
    e = edges(spark, d).join(changed.withColumnRenamed("id", "target"), "target", "left_semi")
    return e.join(changed.withColumnRenamed("id", "source"), "source", "left_anti").select("source", "target", "type")


@query("score_full_outer", f"WITH {SCORES} SELECT coalesce(a.fqn, b.fqn) AS fqn, coalesce(g, 0.1)::DOUBLE AS graph_score, coalesce(s, 0.0)::DOUBLE AS semantic_score, round(0.4 * coalesce(g, 0.1) + 0.6 * coalesce(s, 0.0), 6)::DOUBLE AS score FROM graph a FULL JOIN semantic b ON a.fqn = b.fqn")
def _(spark, d):
    g, s = _scores(spark, d)
    both = g.join(s, "fqn", "full").select("fqn", F.coalesce("g", F.lit(FUSION["no_graph"])).alias("graph_score"), F.coalesce("s", F.lit(FUSION["no_semantic"])).alias("semantic_score"))
    return both.withColumn("score", F.round(FUSION["graph"] * F.col("graph_score") + FUSION["semantic"] * F.col("semantic_score"), 6))


@query("semantic_left_join", "WITH s AS (SELECT conv_id AS id, arg_max(turn, turn) AS last FROM conversations GROUP BY conv_id) SELECT doc_id, coalesce(last, 0)::BIGINT AS score FROM documents LEFT JOIN s ON doc_id = id")
def _(spark, d):
    s = spark.read.parquet(f"{d}/conversations.parquet").groupBy(F.col("conv_id").alias("doc_id")).agg(F.max_by("turn", "turn").alias("last"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id").join(s, "doc_id", "left").select("doc_id", F.coalesce("last", F.lit(0)).cast("long").alias("score"))


@query("interval_overlap_semi", f"WITH {G}, l AS (SELECT DISTINCT 'c:' || o_custkey AS path, (o_orderkey % 400)::INT AS line FROM orders WHERE o_orderkey % 5 = 0) SELECT id, start_line, end_line FROM nodes n WHERE type = 'function' AND EXISTS (SELECT 1 FROM l WHERE l.path = n.path AND l.line BETWEEN n.start_line AND n.end_line)")
def _(spark, d):
    lines = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 5 = 0").selectExpr("concat('c:', o_custkey) AS path", "cast(o_orderkey % 400 AS int) AS line").distinct()
    n = nodes(spark, d).where("type = 'function'").select("id", "path", "start_line", "end_line")
    return intervals.hit_by(n, lines, "path", "line", "start_line", "end_line").select("id", "start_line", "end_line")


@query("node_at_line", f"WITH {G}, q AS (SELECT DISTINCT path, start_line + 3 AS line FROM nodes WHERE type = 'function' AND ord % 2 = 0), h AS (SELECT q.path, q.line, n.id, row_number() OVER (PARTITION BY q.path, q.line ORDER BY n.end_line - n.start_line, n.ord) AS k FROM q JOIN nodes n ON n.path = q.path AND q.line BETWEEN n.start_line AND n.end_line) SELECT path, line::INT AS line, id FROM h WHERE k = 1")
def _(spark, d):
    n = nodes(spark, d).select("id", "path", "start_line", "end_line", "ord", "type")
    q = n.where("type = 'function' AND ord % 2 = 0").select("path", (F.col("start_line") + 3).alias("line")).distinct()
    hit = intervals.containing(q, n.drop("type"), "path", "line", "start_line", "end_line")
    return hit.groupBy("path", "line").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), "ord", "id")).alias("m")).select("path", F.col("line").cast("int").alias("line"), F.col("m.id").alias("id"))


@query("name_resolution", "WITH f AS (SELECT DISTINCT p_brand AS name, 'm' || (p_partkey % 50) AS path FROM part), r AS (SELECT DISTINCT p_type AS ref, p_brand AS name, 'u' || (p_partkey % 70) AS user_path FROM part) SELECT DISTINCT f.path, r.user_path FROM f JOIN r USING (name) WHERE f.path <> r.user_path")
def _(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    f = p.selectExpr("p_brand AS name", "concat('m', p_partkey % 50) AS path").distinct()
    r = p.selectExpr("p_brand AS name", "concat('u', p_partkey % 70) AS user_path").distinct()
    return f.join(r, "name").where("path <> user_path").select("path", "user_path").distinct()


@query(
    "import_resolution",
    f"""WITH {FILES},
refs AS (SELECT a.path, a.doc_id AS line, a.doc_id % 2 AS level, regexp_replace(a.path, '/[^/]*$', '') AS here,
  CASE WHEN a.doc_id % 2 = 0 THEN regexp_replace(b.path, '[.][a-z]+$', '') ELSE regexp_extract(b.path, '([^/]+)[.][a-z]+$', 1) END AS mod
  FROM files a JOIN files b ON b.doc_id BETWEEN a.doc_id + 1 AND a.doc_id + 20),
c AS (SELECT path, line, replace(mod, '/', '.') AS ref, unnest([0, 1, 2, 3]) AS k, unnest([here || '/' || mod || '.py', here || '/' || mod || '/__init__.py',
  CASE WHEN level > 0 THEN here || '/' ELSE '' END || mod || '.py', CASE WHEN level > 0 THEN here || '/' ELSE '' END || mod || '/__init__.py']) AS target FROM refs)
SELECT path, ref, line::INT AS line, arg_min(target, k) AS target FROM c WHERE target IN (SELECT path FROM files) GROUP BY path, ref, line""",
)
def _(spark, d):
    f = files(spark, d).select("doc_id", "path")
    near = f.select("doc_id", "path", F.explode(F.sequence(F.col("doc_id") + 1, F.col("doc_id") + 20)).alias("other"))
    refs = near.join(f.select(F.col("doc_id").alias("other"), F.col("path").alias("to")), "other")
    mod = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(F.regexp_replace("to", "[.][a-z]+$", ""), "/", ".")).otherwise(F.regexp_extract("to", "([^/]+)[.][a-z]+$", 1))
    return extract.resolve_imports(refs.select("path", mod.alias("ref"), F.col("doc_id").cast("int").alias("start_line"), (F.col("doc_id") % 2).alias("value")), f)


@query("registry_lookup", f"WITH {G}, reg AS (SELECT 'n:' || n_nationkey AS repo, n_name AS service FROM nation WHERE n_nationkey % 2 = 0) SELECT e.source, coalesce(a.service, e.target) AS service FROM edges e LEFT JOIN reg a ON e.target = a.repo WHERE e.type = 'IMPORTS'")
def _(spark, d):
    reg = spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey % 2 = 0").selectExpr("concat('n:', n_nationkey) AS target", "n_name AS service")
    return edges(spark, d).where("type = 'IMPORTS'").join(reg, "target", "left").select("source", F.coalesce("service", "target").alias("service"))


@query("test_candidates", f"WITH {FILES}, a AS (SELECT DISTINCT replace(replace(path, 'test_', ''), 'api/', '') AS path FROM files), s AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, string_split(path, '/')[-1] AS base FROM a), t AS (SELECT *, regexp_extract(base, '^(.*)\\.[^.]*$', 1) AS stem FROM s), c AS (SELECT path, unnest([0, 1, 2, 3, 4]) AS k, unnest([dir || '/test_' || base, dir || '/test_' || stem || '.py', 'tests/' || base, 'tests/test_' || base, 'tests/test_' || stem || '.py']) AS test FROM t) SELECT path, arg_min(test, k) AS test FROM c WHERE test IN (SELECT path FROM files) GROUP BY path")
def _(spark, d):
    f = files(spark, d).select("path")
    return tests_of(f.select(F.regexp_replace("path", "test_|api/", "").alias("path")).distinct(), f)


@query("plan_limits_join", "WITH p(plan, day, month) AS (VALUES ('free', 100, 1000), ('pro', 1000, 10000), ('team', 5000, 50000), ('enterprise', -1, -1)), u AS (SELECT user_id, (['free', 'pro', 'team', 'enterprise'])[user_id % 4 + 1] AS plan, count(*) AS used FROM events GROUP BY user_id) SELECT user_id, plan, used, CASE WHEN month = -1 THEN false ELSE used >= day END AS over_day, CASE WHEN month <= 0 THEN 0.0 ELSE round(100.0 * used / month, 6) END::DOUBLE AS month_percent FROM u JOIN p USING (plan)")
def _(spark, d):
    plans = spark.createDataFrame([(k, v[1], v[2]) for k, v in PLANS.items()], "plan string, day long, month long")
    u = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.count("*").alias("used")).withColumn("plan", F.element_at(F.array(*map(F.lit, PLANS)), (F.col("user_id") % 4 + 1).cast("int")))
    over = F.when(F.col("month") == -1, False).otherwise(F.col("used") >= F.col("day"))
    return u.join(F.broadcast(plans), "plan").select("user_id", "plan", "used", over.alias("over_day"), F.when(F.col("month") <= 0, 0.0).otherwise(F.round(100.0 * F.col("used") / F.col("month"), 6)).alias("month_percent"))


@query("preset_lookup", "WITH p(name, k, window_size) AS (VALUES ('gpt-4', 0, 8192), ('gpt-4-turbo', 1, 128000), ('gpt-4o', 2, 128000), ('gpt-3.5-turbo', 3, 16385), ('claude-3-opus', 4, 200000), ('claude-3.5-sonnet', 5, 200000), ('claude-3-haiku', 6, 200000)), q AS (SELECT doc_id, (['gpt-4', 'gpt-4o-mini', 'claude-3-opus-2024', 'unknown', 'haiku', 'gpt-3.5-turbo'])[doc_id % 6 + 1] AS model FROM documents), m AS (SELECT doc_id, model, CASE WHEN model = name THEN -1 WHEN contains(model, name) OR contains(name, model) THEN k WHEN name = 'gpt-4' THEN 99 END AS prio, window_size FROM q, p) SELECT doc_id, model, arg_min(window_size, prio)::INT AS window_size FROM m WHERE prio IS NOT NULL GROUP BY ALL")
def _(spark, d):
    q = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.element_at(F.array(*map(F.lit, ["gpt-4", "gpt-4o-mini", "claude-3-opus-2024", "unknown", "haiku", "gpt-3.5-turbo"])), (F.col("doc_id") % 6 + 1).cast("int")).alias("model"))
    m, exact, part = F.col("model"), None, None
    for name, v in PRESETS.items():
        exact = F.when(m == name, v[0]) if exact is None else exact.when(m == name, v[0])
        hit = m.contains(name) | F.lit(name).contains(m)
        part = F.when(hit, v[0]) if part is None else part.when(hit, v[0])
    return q.select("doc_id", "model", F.coalesce(exact, part, F.lit(PRESETS["gpt-4"][0])).cast("int").alias("window_size"))


SNAPSHOTS = "old AS (SELECT 'o:' || o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 10 <> 0), new AS (SELECT 'o:' || o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders WHERE o_orderkey % 7 <> 0)"


def _snapshots(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    old = o.where("o_orderkey % 10 <> 0").selectExpr("concat('o:', o_orderkey) AS id", "o_orderstatus AS status", "o_totalprice AS price")
    new = o.where("o_orderkey % 7 <> 0").selectExpr("concat('o:', o_orderkey) AS id", "CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS status", "o_totalprice AS price")
    return old, new


@query("snapshot_diff", f"WITH {SNAPSHOTS} SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM old a FULL JOIN new b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status <> b.status")
def _(spark, d):
    return diff.node_changes(*_snapshots(spark, d))


@query("diff_added_nodes", f"WITH {SNAPSHOTS} SELECT id FROM new EXCEPT SELECT id FROM old")
def _(spark, d):
    old, new = _snapshots(spark, d)
    return diff.node_changes(old, new).where("change = 'added'").select("id")


@query("diff_removed_nodes", f"WITH {SNAPSHOTS} SELECT id FROM old EXCEPT SELECT id FROM new")
def _(spark, d):
    old, new = _snapshots(spark, d)
    return diff.node_changes(old, new).where("change = 'removed'").select("id")


@query("diff_common_nodes", f"WITH {SNAPSHOTS} SELECT id FROM old INTERSECT SELECT id FROM new")
def _(spark, d):
    old, new = _snapshots(spark, d)
    return old.select("id").intersect(new.select("id"))


@query("diff_edges", f"WITH {G}, a AS (SELECT DISTINCT source, target, type FROM edges WHERE ord % 10 <> 0), b AS (SELECT DISTINCT source, target, type FROM edges WHERE ord % 7 <> 0) SELECT *, 'added' AS change FROM (FROM b EXCEPT FROM a) UNION ALL SELECT *, 'removed' FROM (FROM a EXCEPT FROM b)")
def _(spark, d):
    e = edges(spark, d)
    return diff.edge_changes(e.where("ord % 10 <> 0"), e.where("ord % 7 <> 0")).select("source", "target", "type", "change")


@query("ordered_dedup", "SELECT o_custkey AS fqn, min(o_orderkey) AS ord FROM orders GROUP BY o_custkey")
def _(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("fqn")).agg(F.min("o_orderkey").alias("ord"))


@query("union_distinct", f"WITH {G} SELECT target AS id FROM edges WHERE type = 'CALLS' UNION SELECT target FROM edges WHERE type = 'IMPORTS'")
def _(spark, d):
    e = edges(spark, d)
    return e.where("type = 'CALLS'").select(F.col("target").alias("id")).union(e.where("type = 'IMPORTS'").select("target")).distinct()


@query("replace_by_path", f"WITH {G}, new AS (SELECT id || '_v2' AS id, path FROM nodes WHERE path = 'n:5') SELECT id, path FROM nodes WHERE path <> 'n:5' UNION ALL FROM new")
def _(spark, d):
    n = nodes(spark, d).select("id", "path")
    new = n.where("path = 'n:5'").select(F.concat("id", F.lit("_v2")).alias("id"), "path")
    return diff.replace_paths(n, new, ["n:5"])
