"""Traversal and impact queries."""

from pyspark.sql import functions as F

from ..functions.scalars import path_distance
from ..operators import impact, paths, traverse
from ..operators.adjacency import Picked
from ..operators.cache import ResultCache
from ..operators.lookup import file_graph, first_nodes, induced
from ..scratch import cut, scratch
from ..sources.graph import G, adjacency, edges, nodes, transitions
from .registry import query

R = f"WITH RECURSIVE {G}, "


def _khop(name, start, depth, step, direction, types=None):
    kind = f" AND e.type IN ({', '.join(map(repr, types))})" if types else ""
    sql = f"{R}r(id, depth) AS (SELECT '{start}', 0 UNION SELECT {step[1]}, depth + 1 FROM r JOIN edges e ON {step[0]}{kind} WHERE depth < {depth}) SELECT id, min(depth)::INT AS depth, round(pow(0.8, min(depth)), 6)::DOUBLE AS score FROM r GROUP BY id"

    @query(name, sql)
    def _(spark, d):
        found, _ = traverse.khop(adjacency(spark, d), start, depth, direction, types)
        return traverse.decayed(found).withColumn("score", F.round("score", 6))


_khop("khop_outgoing", "o:1", 3, ("e.source = r.id", "e.target"), "outgoing")
_khop("khop_incoming", "n:3", 2, ("e.target = r.id", "e.source"), "incoming")
_khop("khop_both", "s:2", 2, ("(e.source = r.id OR e.target = r.id)", "CASE WHEN e.source = r.id THEN e.target ELSE e.source END"), "both")
_khop("khop_typed", "o:33", 3, ("e.source = r.id", "e.target"), "outgoing", ["CALLS"])
_khop("decayed_expansion", "c:5", 2, ("(e.source = r.id OR e.target = r.id)", "CASE WHEN e.source = r.id THEN e.target ELSE e.source END"), "both")


@query("khop_edges", f"{R}r(id, depth) AS (SELECT 'o:1', 0 UNION SELECT e.target, depth + 1 FROM r JOIN edges e ON e.source = r.id WHERE depth < 3) SELECT DISTINCT source, target, type FROM edges WHERE source IN (SELECT id FROM r GROUP BY id HAVING min(depth) < 3)")
def _(spark, d):
    return traverse.khop(adjacency(spark, d), "o:1", 3)[1]


CACHED = "r(id, depth) AS (SELECT 'c:7', 0 UNION SELECT CASE WHEN e.source = r.id THEN e.target ELSE e.source END, depth + 1 FROM r JOIN edges e ON e.source = r.id OR e.target = r.id WHERE depth < 2)"


@query("cached_context", f"{R}{CACHED} SELECT id, min(depth)::INT AS depth FROM r GROUP BY id")
def _(spark, d):
    """Asked twice: the second answer is the kept one."""
    store = ResultCache(spark, scratch(spark, "results"))
    request = {"repo_id": "tables", "task": "context", "entry_points": ["c:7"], "depth": 2}
    for _ in range(2):
        found = store.get_or_run(request, d, lambda: traverse.khop(adjacency(spark, d), "c:7", 2, "both")[0])
    return found


@query("khop_cycle", f"{R}r(id, depth) AS (SELECT 'signup', 0 UNION SELECT s.target, depth + 1 FROM r JOIN steps s ON s.source = r.id WHERE depth < 5) SELECT id, min(depth)::INT AS depth FROM r GROUP BY id")
def _(spark, d):
    return traverse.reach(transitions(spark, d).select(F.col("source").alias("a"), F.col("target").alias("b")), spark.createDataFrame([("signup",)], "id string"), 5)


@query("event_transitions", f"WITH {G} SELECT source, target, n FROM steps")
def _(spark, d):
    return transitions(spark, d)


@query("hop_distance", f"{R}r(id, depth) AS (SELECT id, 0 FROM nodes WHERE id IN ('o:1', 'o:2', 'p:3') UNION SELECT e.target, depth + 1 FROM r JOIN edges e ON e.source = r.id WHERE depth < 5), m AS (SELECT id, min(depth) AS depth FROM r GROUP BY id) SELECT id, depth::INT AS depth, round(CASE WHEN depth IS NULL THEN 0.1 ELSE 1.0 / (1.0 + depth) END, 6)::DOUBLE AS score FROM nodes LEFT JOIN m USING (id)")
def _(spark, d):
    start = spark.createDataFrame([("o:1",), ("o:2",), ("p:3",)], "id string")
    found = traverse.reach(adjacency(spark, d).steps(), start, 5)
    return nodes(spark, d).select("id").join(found, "id", "left").select("id", "depth", F.round(traverse.hop_score(F.col("depth")), 6).alias("score"))


@query("weighted_expansion", f"{R}r(id, w, k) AS (SELECT 'o:1', 1.0::DOUBLE, 0 UNION SELECT e.target, w * CASE e.type WHEN 'CALLS' THEN 0.9 WHEN 'IMPORTS' THEN 0.6 ELSE 1.0 END, k + 1 FROM r JOIN edges e ON e.source = r.id WHERE k < 8 AND w * CASE e.type WHEN 'CALLS' THEN 0.9 WHEN 'IMPORTS' THEN 0.6 ELSE 1.0 END >= 0.1) SELECT id, round(max(w), 6)::DOUBLE AS weight FROM r GROUP BY id")
def _(spark, d):
    return traverse.weighted(adjacency(spark, d), "o:1").select("id", F.round("weight", 6).alias("weight"))


@query("path_lengths", f"{R}r(id, distance) AS (SELECT DISTINCT target, 1 FROM edges WHERE source = 'o:3' UNION SELECT e.target, distance + 1 FROM r JOIN edges e ON e.source = r.id WHERE distance < 4) SELECT id, distance::INT AS distance FROM r")
def _(spark, d):
    return paths.path_lengths(adjacency(spark, d), "o:3", 4)


@query("dependents", f"{R}r(id, distance) AS (SELECT DISTINCT source, 1 FROM edges WHERE target = 's:1' UNION SELECT e.source, distance + 1 FROM r JOIN edges e ON e.target = r.id WHERE distance < 2) SELECT id, distance::INT AS distance FROM r")
def _(spark, d):
    return paths.path_lengths(adjacency(spark, d), "s:1", 2, reverse=True)


@query("shortest_path_len", f"{R}a AS (SELECT DISTINCT source AS a, target AS b FROM edges UNION SELECT DISTINCT target, source FROM edges), r(id, n) AS (SELECT 'r:0', 0 UNION SELECT a.b, n + 1 FROM r JOIN a ON a.a = r.id WHERE n < 4 AND NOT EXISTS (SELECT 1 FROM r WHERE id = 'p:7')) SELECT min(n)::INT AS n_steps, 'r:0' AS first, 'p:7' AS last FROM r WHERE id = 'p:7'")
def _(spark, d):
    path = traverse.shortest_path(adjacency(spark, d), "r:0", "p:7")
    return spark.createDataFrame([(len(path) - 1, path[0], path[-1])] if path else [], "n_steps int, first string, last string")


FG = "f AS (SELECT n.path, m.path AS by_path, e.type AS edge_type, n.ord AS node_ord, e.ord AS edge_ord FROM edges e JOIN nodes n ON e.target = n.id JOIN (SELECT id, arg_min(path, ord) AS path FROM nodes GROUP BY id) m ON e.source = m.id)"


@query("file_dependencies", f"WITH {G}, {FG} SELECT path, by_path, count(*) AS n FROM f GROUP BY ALL")
def _(spark, d):
    return file_graph(edges(spark, d), nodes(spark, d)).groupBy("path", "by_path").agg(F.count("*").alias("n"))


@query("impact_direct", f"WITH {G}, {FG}, g AS (SELECT *, CASE path WHEN 'n:1' THEN 1 ELSE 2 END AS k FROM f WHERE path IN ('n:1', 'n:2') AND by_path NOT IN ('n:1', 'n:2')), h AS (SELECT *, first_value(node_ord) OVER (PARTITION BY by_path ORDER BY k, node_ord, edge_ord) AS first FROM g) SELECT by_path AS path, list_sort(list(DISTINCT edge_type)) AS edge_types FROM h WHERE node_ord = first GROUP BY by_path")
def _(spark, d):
    return impact.direct(adjacency(spark, d), None, ["n:1", "n:2"])


CLOSURE = f"{R}{FG}, u AS (SELECT DISTINCT path AS a, by_path AS b FROM f WHERE by_path <> 'n:1'), c(path, distance) AS (SELECT 'n:1', 0 UNION SELECT u.b, distance + 1 FROM c JOIN u ON u.a = c.path WHERE distance < 4)"


@query("impact_transitive", f"{CLOSURE} SELECT path, min(distance)::INT AS distance FROM c WHERE path <> 'n:1' GROUP BY path")
def _(spark, d):
    return impact.closure(adjacency(spark, d), None, ["n:1"])


@query("impact_summary", f"{CLOSURE}, m AS (SELECT path, min(distance) AS distance FROM c WHERE path <> 'n:1' GROUP BY path) SELECT count(*) FILTER (WHERE distance = 1) AS n_direct, count(*) FILTER (WHERE distance > 1) AS n_transitive, coalesce(max(distance), 0)::INT AS farthest FROM m")
def _(spark, d):
    c = impact.closure(adjacency(spark, d), None, ["n:1"])
    return c.agg(F.count_if(F.col("distance") == 1).alias("n_direct"), F.count_if(F.col("distance") > 1).alias("n_transitive"), F.coalesce(F.max("distance"), F.lit(0)).alias("farthest"))


@query("pr_risk", f"WITH {G}, {FG}, d AS (SELECT DISTINCT path AS changed, by_path FROM f WHERE path <> by_path), t AS (SELECT DISTINCT d.changed, f.by_path FROM d JOIN f ON f.path = d.by_path WHERE f.by_path <> d.changed), a AS (SELECT changed, by_path FROM d UNION SELECT changed, by_path FROM t), n AS (SELECT changed, count(*) AS n FROM a GROUP BY changed) SELECT changed, n AS n_impacted, CASE WHEN n <= 5 THEN 'low' ELSE 'medium' END AS risk FROM n")
def _(spark, d):
    f = file_graph(edges(spark, d), nodes(spark, d)).where("path <> by_path")
    direct = cut(f.select(F.col("path").alias("changed"), "by_path").distinct(), "direct")
    n = impact.within_two(direct).groupBy("changed").agg(F.count("*").alias("n_impacted"), F.max(impact.critical(F.col("by_path"))).alias("critical"))
    return n.select("changed", "n_impacted", impact.pr_risk(F.col("n_impacted"), F.lit(1), F.col("critical")).alias("risk"))


@query("ci_reach", f"{R}{FG}, u AS (SELECT DISTINCT path AS a, by_path AS b FROM f), c(path) AS (SELECT 'r:2' UNION SELECT u.b FROM c JOIN u ON u.a = c.path) SELECT path FROM c")
def _(spark, d):
    return traverse.reach(adjacency(spark, d).file_steps(), spark.createDataFrame([("r:2",)], "id string")).select(F.col("id").alias("path"))


@query("impact_visual_split", f"{R}own AS (SELECT id FROM nodes WHERE path = 'r:1'), v(id, depth) AS (SELECT id, 0 FROM own UNION SELECT e.source, depth + 1 FROM v JOIN edges e ON e.target = v.id WHERE depth < 3 AND e.source NOT IN (FROM own)) SELECT id, CASE WHEN min(depth) = 1 THEN 'direct' ELSE 'indirect' END AS kind FROM v WHERE depth > 0 GROUP BY id")
def _(spark, d):
    own = nodes(spark, d).where("path = 'r:1'").select("id")
    steps = Picked((adjacency(spark, d).steps("incoming"), lambda met: met.join(own.withColumnRenamed("id", "b"), "b", "left_anti")))
    return traverse.reach(steps, own, 3).where("depth > 0").select("id", F.when(F.col("depth") == 1, "direct").otherwise("indirect").alias("kind"))


@query("imports_of_file", f"WITH {G}, f AS (SELECT id, arg_min(path, ord) AS path FROM nodes GROUP BY id) SELECT DISTINCT b.path AS target_path, e.line FROM edges e JOIN f a ON e.source = a.id JOIN f b ON e.target = b.id WHERE a.path = 'c:4'")
def _(spark, d):
    f = first_nodes(nodes(spark, d).select("id", "ord", "path"))
    src = f.where("path = 'c:4'").select(F.col("id").alias("source"))
    return edges(spark, d).join(src, "source", "left_semi").join(f.select(F.col("id").alias("target"), F.col("path").alias("target_path")), "target").select("target_path", "line").distinct()


@query("node_detail", f"WITH {G} SELECT 'in' AS side, source AS other, type FROM edges WHERE target = 'p:5' UNION ALL SELECT 'out', target, type FROM edges WHERE source = 'p:5'")
def _(spark, d):
    e = edges(spark, d)
    return e.where("target = 'p:5'").select(F.lit("in").alias("side"), F.col("source").alias("other"), "type").union(e.where("source = 'p:5'").select(F.lit("out"), "target", "type"))


@query("service_graph", f"WITH {G}, reg AS (SELECT id FROM nodes WHERE id LIKE 's:%' OR id LIKE 'n:%') SELECT e.source, e.target, max(e.line)::INT AS line FROM edges e WHERE source IN (FROM reg) AND target IN (FROM reg) GROUP BY ALL")
def _(spark, d):
    reg = nodes(spark, d).where("id LIKE 's:%' OR id LIKE 'n:%'")
    return induced(edges(spark, d), reg).groupBy("source", "target").agg(F.max_by("line", "ord").alias("line"))


@query("path_distance", """WITH p AS (SELECT doc_id, 'a/b' || (doc_id % 3) || CASE WHEN doc_id % 2 = 0 THEN '/c' ELSE '' END || '/f' || (doc_id % 4) || '.py::g' || (doc_id % 5) AS id FROM documents),
q AS (SELECT doc_id, id, string_split(string_split(id, '::')[1], '/') AS a, string_split('a/b1/c/f2.py', '/') AS b FROM p),
s AS (SELECT *, CASE WHEN a[1] IS DISTINCT FROM b[1] THEN 0 WHEN a[2] IS DISTINCT FROM b[2] THEN 1 WHEN a[3] IS DISTINCT FROM b[3] THEN 2 WHEN a[4] IS DISTINCT FROM b[4] THEN 3 ELSE 4 END AS common FROM q)
SELECT doc_id, (CASE WHEN id = 'a/b1/c/f2.py::g1' THEN 0 WHEN a = b THEN 1 ELSE least(10, greatest(2, 5 - common + abs(len(a) - len(b)))) END)::INT AS distance FROM s""")
def _(spark, d):
    p = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "concat('a/b', doc_id % 3, CASE WHEN doc_id % 2 = 0 THEN '/c' ELSE '' END, '/f', doc_id % 4, '.py::g', doc_id % 5) AS id")
    return p.select("doc_id", path_distance(F.lit("a/b1/c/f2.py::g1"), F.col("id")).alias("distance"))


@query("plugin_impact_score", f"WITH {G}, i AS (SELECT target AS id, count(DISTINCT source) AS direct FROM edges GROUP BY 1) SELECT id, direct, (CASE type WHEN 'file' THEN 3 WHEN 'class' THEN 2 ELSE 1 END + 2 * direct)::BIGINT AS score, CASE WHEN CASE type WHEN 'file' THEN 3 WHEN 'class' THEN 2 ELSE 1 END + 2 * direct >= 15 THEN 'high' WHEN CASE type WHEN 'file' THEN 3 WHEN 'class' THEN 2 ELSE 1 END + 2 * direct >= 5 THEN 'medium' ELSE 'low' END AS level FROM nodes JOIN i USING (id)")
def _(spark, d):
    i = edges(spark, d).select("source", "target").distinct().groupBy(F.col("target").alias("id")).agg(F.count("*").alias("direct"))
    score = F.when(F.col("type") == "file", 3).when(F.col("type") == "class", 2).otherwise(1) + 2 * F.col("direct")
    n = nodes(spark, d).select("id", "type").join(i, "id").withColumn("score", score.cast("long"))
    return n.select("id", "direct", "score", F.when(F.col("score") >= 15, "high").when(F.col("score") >= 5, "medium").otherwise("low").alias("level"))
