"""Aggregates, window idioms and top-k."""

from pyspark.sql import functions as F

from ..functions.constants import COMPLEXITY_RANKS, DURATION_BUCKETS, HOT_COMPLEXITY
from ..functions.scalars import complexity_rank
from ..operators import usage
from ..operators.impact import ci_risk, plugin_risk
from ..sources.graph import G, edges, nodes
from .filters import FILES, files
from .registry import query


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("node_type_histogram", f"WITH {G} SELECT type, count(*) AS n FROM nodes GROUP BY type")
def _(spark, d):
    return nodes(spark, d).groupBy("type").agg(F.count("*").alias("n"))


@query("edge_type_counts", f"WITH {G} SELECT count(*) AS total, count(*) FILTER (WHERE type = 'IMPORTS') AS imports, count(*) FILTER (WHERE type = 'CALLS') AS calls, count(*) FILTER (WHERE type = 'EXTENDS') AS extends FROM edges")
def _(spark, d):
    return edges(spark, d).agg(F.count("*").alias("total"), *[F.count_if(F.col("type") == t).alias(t.lower()) for t in ("IMPORTS", "CALLS", "EXTENDS")])


@query("avg_complexity", f"WITH {G} SELECT round(avg(CASE WHEN type IN ('class', 'function') AND start_line IS NOT NULL THEN end_line - start_line + 1 ELSE 1 END), 6)::DOUBLE AS average FROM nodes")
def _(spark, d):
    loc = F.when(F.col("type").isin("class", "function") & F.col("start_line").isNotNull(), F.col("end_line") - F.col("start_line") + 1).otherwise(1)
    return nodes(spark, d).agg(F.round(F.avg(loc), 6).alias("average"))


@query("hot_spots", f"WITH {G}, deg AS (SELECT id, count(*) AS n FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id) SELECT count(*) AS hot FROM deg WHERE n > 1.5 * (SELECT avg(n) FROM deg)")
def _(spark, d):
    deg = edges(spark, d).select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    mean = deg.agg(F.avg("n").alias("m")).first().m or 0.0
    return deg.agg(F.count_if(F.col("n") > 1.5 * mean).alias("hot"))


@query("top_connected", f"WITH {G}, o AS (SELECT source AS id, count(*) AS n_out FROM edges GROUP BY 1), i AS (SELECT target AS id, count(*) AS n_in FROM edges GROUP BY 1) SELECT id, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM nodes LEFT JOIN o USING (id) LEFT JOIN i USING (id) ORDER BY coalesce(n_in, 0) + coalesce(n_out, 0) DESC, ord LIMIT 20")
def _(spark, d):
    e = edges(spark, d)
    deg = e.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(e.select("target", F.lit(0), F.lit(1))).groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    all_ = nodes(spark, d).select("id", "ord").join(deg, "id", "left").na.fill(0)
    return all_.orderBy(F.desc(F.col("n_in") + F.col("n_out")), "ord").limit(20).select("id", "n_in", "n_out")


@query("rank_distribution", "WITH r AS (SELECT CASE WHEN l_quantity <= 5 THEN 'A' WHEN l_quantity <= 10 THEN 'B' WHEN l_quantity <= 20 THEN 'C' WHEN l_quantity <= 30 THEN 'D' WHEN l_quantity <= 40 THEN 'E' ELSE 'F' END AS rank FROM lineitem) SELECT k.rank, count(r.rank) AS n FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E'), ('F')) k(rank) LEFT JOIN r USING (rank) GROUP BY k.rank")
def _(spark, d):
    r = _t(spark, d, "lineitem").select(complexity_rank(F.col("l_quantity")).alias("rank")).groupBy("rank").agg(F.count("*").alias("n"))
    ranks = spark.createDataFrame([(x,) for x in [*[a for a, _ in COMPLEXITY_RANKS], "F"]], "rank string")
    return ranks.join(r, "rank", "left").na.fill(0)


@query("complexity_summary", "SELECT count(*) AS total, round(avg(l_quantity), 6)::DOUBLE AS mean, max(l_quantity) AS most, count(*) FILTER (WHERE l_quantity >= 11) AS hot FROM lineitem")
def _(spark, d):
    q = F.col("l_quantity")
    return _t(spark, d, "lineitem").agg(F.count("*").alias("total"), F.round(F.avg(q), 6).alias("mean"), F.max(q).alias("most"), F.count_if(q >= HOT_COMPLEXITY).alias("hot"))


@query("file_complexity", "SELECT l_orderkey AS file, round(avg(l_quantity), 6)::DOUBLE AS mean, sum(l_quantity)::DOUBLE AS total, max(l_quantity) AS most, count(*) FILTER (WHERE l_quantity >= 11) AS hot FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    q = F.col("l_quantity")
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.round(F.avg(q), 6).alias("mean"), F.sum(q).alias("total"), F.max(q).alias("most"), F.count_if(q >= HOT_COMPLEXITY).alias("hot"))


@query("hot_functions", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 11 ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 10")
def _(spark, d):
    return _t(spark, d, "lineitem").where(F.col("l_quantity") >= HOT_COMPLEXITY).orderBy(F.desc("l_quantity"), "l_orderkey", "l_linenumber").limit(10).select("l_orderkey", "l_linenumber", "l_quantity")


@query("type_share", f"WITH {G} SELECT type, round(100.0 * count(*) / (SELECT count(*) FROM nodes), 6)::DOUBLE AS percent FROM nodes GROUP BY type")
def _(spark, d):
    n = nodes(spark, d).groupBy("type").agg(F.count("*").alias("n"))
    return n.select("type", F.round(100.0 * F.col("n") / F.expr("sum(n) OVER ()"), 6).alias("percent"))


@query("blame_primary", "WITH c AS (SELECT o_custkey % 40 AS file, o_orderpriority AS author, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL) SELECT file, arg_max(author, n * 1000000000 - first) AS primary_author, count(*) AS n_contributors FROM c GROUP BY file")
def _(spark, d):
    return usage.blame(_t(spark, d, "orders").select((F.col("o_custkey") % 40).alias("file"), F.col("o_orderpriority").alias("author"), F.col("o_orderkey").alias("ord"))).select("file", "primary_author", F.size("author_distribution").cast("long").alias("n_contributors"))


@query("change_frequency", "WITH l AS (SELECT max(o_orderdate) AS d FROM orders) SELECT o_custkey AS file, count(*) AS commits, count(*) > 10 AS hot FROM orders, l WHERE o_orderdate >= d - INTERVAL 900 DAY GROUP BY o_custkey")
def _(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderdate").alias("at"))
    return usage.change_frequency(o, o.agg(F.max("at").alias("m")).first().m, 900)


@query("usage_aggregate", "SELECT user_id, count(*) AS requests, coalesce(sum(floor(value)), 0)::BIGINT AS tokens, count(*) FILTER (WHERE event_type = 'click') AS context_requests, count(*) FILTER (WHERE event_type = 'view') AS semantic_searches, count(*) FILTER (WHERE event_type = 'signup') AS sync_events FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' GROUP BY user_id")
def _(spark, d):
    e = usage.events(spark, d).where("ts >= TIMESTAMP_NTZ '2024-01-03' AND ts < TIMESTAMP_NTZ '2024-01-20'")
    return usage.aggregate(e, ["user_id"])


@query("month_usage", "SELECT user_id, date_trunc('month', ts)::DATE AS month, count(*) AS requests, sum(floor(value))::BIGINT AS tokens FROM events GROUP BY ALL")
def _(spark, d):
    return usage.events(spark, d).groupBy("user_id", F.to_date(F.date_trunc("month", "ts")).alias("month")).agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"))


@query("daily_counters", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return usage.events(spark, d).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("quota_exceeded", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 3 + user_id % 5")
def _(spark, d):
    e = usage.events(spark, d).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return e.where(F.col("n") >= 3 + F.col("user_id") % 5)


@query("rate_windows", "SELECT user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS at, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 2")
def _(spark, d):
    w = usage.events(spark, d).groupBy("user_id", F.date_format(F.window("ts", "1 hour")["start"], "yyyy-MM-dd HH:mm").alias("at")).agg(F.count("*").alias("n"))
    return w.where("n > 2")


@query("snapshot_stats", "SELECT count(*) AS n, max(o_orderdate)::DATE AS last, round(avg(o_totalprice), 4)::DOUBLE AS mean, round(sum(o_totalprice), 2)::DOUBLE AS total FROM orders")
def _(spark, d):
    return _t(spark, d, "orders").agg(F.count("*").alias("n"), F.to_date(F.max("o_orderdate")).alias("last"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.sum("o_totalprice"), 2).alias("total"))


BUDGET = "b AS (SELECT o_custkey AS user_id, o_orderpriority AS strategy, floor(o_totalprice)::BIGINT AS used FROM orders)"


def _budget(spark, d):
    return _t(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("strategy"), F.floor("o_totalprice").cast("long").alias("used"), F.col("o_orderdate").alias("ts"))


@query("budget_analytics", f"WITH {BUDGET} SELECT user_id, count(*) AS n, round(avg(used), 6)::DOUBLE AS mean_used, 3 * sum(used)::BIGINT AS naive, 2 * sum(used)::BIGINT AS saved, CASE WHEN sum(used) > 0 THEN round(200.0 / 3, 4) ELSE 0 END::DOUBLE AS saved_percent FROM b GROUP BY user_id")
def _(spark, d):
    return usage.budget(_budget(spark, d), ["user_id"])


@query("strategy_histogram", f"WITH {BUDGET} SELECT strategy, count(*) AS n, median(used)::DOUBLE AS median_used, round(var_pop(used / 1000.0), 4)::DOUBLE AS variance FROM b GROUP BY strategy")
def _(spark, d):
    return _budget(spark, d).groupBy("strategy").agg(F.count("*").alias("n"), F.median("used").alias("median_used"), F.round(F.var_pop(F.col("used") / 1000.0), 4).alias("variance"))


@query("strategy_mode", f"WITH {BUDGET}, c AS (SELECT user_id, strategy, count(*) AS n FROM b GROUP BY ALL) SELECT user_id, arg_min(strategy, (-n)::VARCHAR || strategy) AS strategy FROM (SELECT user_id, strategy, 1000000 - n AS n FROM c) GROUP BY user_id".replace("(-n)::VARCHAR || strategy", "n::VARCHAR || strategy"))
def _(spark, d):
    c = _budget(spark, d).groupBy("user_id", "strategy").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "strategy"))["strategy"].alias("strategy"))


@query("overlapping_periods", "SELECT p AS period, user_id, count(*) AS n, sum(floor(value))::BIGINT AS tokens FROM events, (VALUES ('day', 1), ('week', 7), ('month', 30)) v(p, k) WHERE ts >= (SELECT max(ts) FROM events) - to_days(k) GROUP BY ALL")
def _(spark, d):
    e = usage.events(spark, d)
    return usage.periods(e, e.agg(F.max("ts").alias("m")).first().m)


@query("request_histogram", "WITH b(le) AS (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0])) SELECT event_type, le::DOUBLE AS le, count(*) FILTER (WHERE value / 10 <= le) AS n FROM events, b GROUP BY ALL")
def _(spark, d):
    e = _t(spark, d, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") / 10 <= b).alias(f"b{k}") for k, b in enumerate(DURATION_BUCKETS)])
    return e.select("event_type", F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(DURATION_BUCKETS)])).alias("x")).select("event_type", "x.le", "x.n")


@query("metrics_trend", "WITH r AS (SELECT date_trunc('day', o_orderdate)::DATE AS run, count(*) AS n FROM orders GROUP BY 1) SELECT run, n, n - lag(n) OVER (ORDER BY run) AS change FROM r")
def _(spark, d):
    return usage.trend(_t(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("run")).agg(F.count("*").alias("n")))


@query("graph_merge", "SELECT sum(n)::BIGINT AS total, round(avg(m), 6)::DOUBLE AS mean_of_means FROM (SELECT o_orderpriority, count(*) AS n, avg(o_totalprice) AS m FROM orders GROUP BY 1)")
def _(spark, d):
    parts = _t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m"))
    return parts.agg(F.sum("n").alias("total"), F.round(F.avg("m"), 6).alias("mean_of_means"))


@query("allocation_stats", "SELECT count(*) AS n, round(avg(floor(n_chars / 4)), 6)::DOUBLE AS mean_tokens, median(floor(n_chars / 4))::DOUBLE AS median_tokens, count(*) FILTER (WHERE floor(n_chars / 4) < 50) AS truncated FROM documents")
def _(spark, d):
    t = F.floor(F.col("n_chars") / 4)
    return _t(spark, d, "documents").agg(F.count("*").alias("n"), F.round(F.avg(t), 6).alias("mean_tokens"), F.median(t).alias("median_tokens"), F.count_if(t < 50).alias("truncated"))


@query("loc_totals", "SELECT source, sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')))::BIGINT AS loc, sum(floor(n_chars / 4))::BIGINT AS tokens FROM documents GROUP BY source")
def _(spark, d):
    loc = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return _t(spark, d, "documents").groupBy("source").agg(F.sum(loc).alias("loc"), F.sum(F.floor(F.col("n_chars") / 4)).alias("tokens"))


@query("risk_classes", f"WITH {G}, i AS (SELECT target, count(DISTINCT source) AS n FROM edges GROUP BY target), t AS (SELECT count(*) AS total FROM nodes) SELECT target AS id, n, CASE WHEN n <= 1 THEN 'low' WHEN n <= 5 THEN 'medium' ELSE 'high' END AS plugin, CASE WHEN 100 * n // total > 50 THEN 'critical' WHEN 100 * n // total > 20 THEN 'high' WHEN 100 * n // total > 10 THEN 'medium' WHEN 100 * n // total > 5 THEN 'low' ELSE 'minimal' END AS ci FROM i, t")
def _(spark, d):
    total = nodes(spark, d).count()
    i = edges(spark, d).select("source", "target").distinct().groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"))
    return i.select("id", "n", plugin_risk(F.col("n")).alias("plugin"), ci_risk(F.floor(100 * F.col("n") / total)).alias("ci"))


@query("ui_hot_functions", f"WITH {G}, o AS (SELECT source, count(*) AS n FROM edges GROUP BY source) SELECT id, n FROM nodes JOIN o ON id = source WHERE type = 'function' AND n > 5")
def _(spark, d):
    o = edges(spark, d).groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n")).where("n > 5")
    return nodes(spark, d).where("type = 'function'").select("id").join(o, "id")


@query("file_frequency", f"WITH {G} SELECT id, count(*) OVER (PARTITION BY path) AS freq FROM nodes WHERE type = 'class'")
def _(spark, d):
    n = nodes(spark, d).where("type = 'class'").select("id", "path")
    return n.join(n.groupBy("path").agg(F.count("*").alias("freq")), "path").select("id", "freq")


@query("latest_per_repo", "SELECT o_custkey AS repo, arg_max(o_orderkey, o_orderdate::DATE::VARCHAR || lpad(o_orderkey::VARCHAR, 20, '0')) AS snapshot FROM orders GROUP BY o_custkey")
def _(spark, d):
    return _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("repo")).agg(F.max(F.struct(F.to_date("o_orderdate"), "o_orderkey"))["o_orderkey"].alias("snapshot"))


@query("stable_rank", "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 37 % 100) DESC, doc_id)::INT AS rank FROM documents QUALIFY rank <= 25")
def _(spark, d):
    x = _t(spark, d, "documents").selectExpr("doc_id", "source", "doc_id * 37 % 100 AS score")
    return x.selectExpr("doc_id", "row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank").where("rank <= 25")


@query("list_newest", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_custkey % 2 = 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def _(spark, d):
    return _t(spark, d, "orders").where("o_custkey % 2 = 0").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("prefix_budget", f"WITH {FILES}, r AS (SELECT doc_id, n_chars // 4 AS t, sum(n_chars // 4) OVER (PARTITION BY doc_id % 20 ORDER BY doc_id * 37 % 100 DESC, doc_id) AS upto FROM files) SELECT doc_id, t AS tokens FROM r WHERE upto <= 4000")
def _(spark, d):
    r = files(spark, d).selectExpr("doc_id", "n_chars div 4 AS tokens", "doc_id % 20 AS req", "doc_id * 37 % 100 AS score")
    return r.selectExpr("doc_id", "tokens", "sum(tokens) OVER (PARTITION BY req ORDER BY score DESC, doc_id) AS upto").where("upto <= 4000").select("doc_id", "tokens")


@query("type_cube", f"WITH {G} SELECT repo_id, type, count(*) AS n FROM nodes GROUP BY CUBE (repo_id, type)")
def _(spark, d):
    return nodes(spark, d).cube("repo_id", "type").agg(F.count("*").alias("n"))
