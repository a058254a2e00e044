"""Vector search, ranking, budgets, summaries and clusters."""

from pyspark.sql import functions as F

from ..functions.constants import CRITICALITY, PRESETS
from ..functions.scalars import criticality, estimated_tokens, snippet
from ..operators import budget, clustering, ranking, tokens, vector_index
from ..sources.graph import G, nodes
from .filters import FILES, files
from .registry import query


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


COS = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query("cosine_topk", f"SELECT vec_id, round({COS}, 4)::DOUBLE AS score FROM embeddings WHERE {COS} >= 0.7 ORDER BY {COS} DESC LIMIT 10")
def _(spark, d):
    v = _t(spark, d, "embeddings")
    q = v.where("vec_id = 0").first().embedding
    return ranking.cosine_topk(v, q, 10).select("vec_id", F.round("score", 4).alias("score"))


@query("vector_search_filtered", f"SELECT vec_id, label FROM embeddings WHERE label IN (1, 2) AND {COS} >= 0.0 ORDER BY {COS} DESC LIMIT 50")
def _(spark, d):
    v = _t(spark, d, "embeddings")
    q = v.where("vec_id = 0").first().embedding
    return ranking.cosine_topk(v.where("label IN (1, 2)"), q, 50, 0.0).select("vec_id", "label")


@query("hybrid_fusion", f"WITH s AS (SELECT vec_id AS fqn, {COS} AS s FROM embeddings WHERE {COS} >= 0.2), g AS (SELECT vec_id AS fqn, 1.0 AS g FROM embeddings WHERE label < 3) SELECT coalesce(s.fqn, g.fqn) AS fqn, round(0.4 * coalesce(g, 0.1) + 0.6 * coalesce(s, 0), 4)::DOUBLE AS score FROM s FULL JOIN g ON s.fqn = g.fqn")
def _(spark, d):
    v = _t(spark, d, "embeddings")
    q = v.where("vec_id = 0").first().embedding
    s = ranking.cosine_scored(v, q, 0.2).selectExpr("vec_id AS fqn", "score AS s")
    return ranking.fuse(v.where("label < 3").selectExpr("vec_id AS fqn", "1.0D AS g"), s).select("fqn", F.round("score", 4).alias("score"))


def _case(kind):
    patterns, default = CRITICALITY[kind]
    return f"WHEN type = '{kind}' THEN CASE " + " ".join(f"WHEN contains(lower(name), '{p}') THEN {w}" for p, w in patterns) + f" ELSE {default} END"


CRIT = f"CASE {' '.join(map(_case, CRITICALITY))} ELSE 0.5 END"


@query("criticality", f"WITH {G} SELECT id, ({CRIT})::DOUBLE AS criticality FROM nodes")
def _(spark, d):
    return nodes(spark, d).select("id", criticality(F.col("type"), F.col("name")).alias("criticality"))


@query(
    "five_factor_rank",
    f"""WITH {G}, n AS (SELECT *, (ord % 997)::BIGINT AS tokens FROM nodes), f AS (SELECT path, count(*) AS freq FROM n GROUP BY path), t AS (SELECT count(*) AS files FROM f),
s AS (SELECT 'o:' || doc_id AS fqn, (doc_id * 37 % 100) / 100.0 AS s FROM documents)
SELECT id, round(least(1.0, 0.4 * coalesce(s, 0) + 0.3 * 0.5 + 0.15 * ({CRIT}) + 0.1 * least(ln(freq + 1) / ln(files + 1), 1.0) + 0.05 * CASE WHEN tokens <= 0 THEN 0 ELSE least(2.0 / ln(tokens + 1), 1.0) END), 6)::DOUBLE AS score
FROM n JOIN f USING (path), t LEFT JOIN s ON s.fqn = CASE WHEN n.type = 'file' THEN n.path ELSE n.id END""",
)
def _(spark, d):
    s = _t(spark, d, "documents").selectExpr("concat('o:', doc_id) AS fqn", "(doc_id * 37 % 100) / 100.0D AS s")
    return ranking.five_factor(nodes(spark, d).withColumn("tokens", F.col("ord") % 997), s, None).select("id", F.round("score", 6).alias("score"))


N = "n AS (SELECT doc_id AS ord, doc_id % 20 AS req, (doc_id * 37 % 100) / 100.0::DOUBLE AS score, n_chars // 4 AS tokens FROM documents)"


def _candidates(spark, d):
    return _t(spark, d, "documents").selectExpr("doc_id AS ord", "doc_id % 20 AS req", "(doc_id * 37 % 100) / 100.0D AS score", "n_chars div 4 AS tokens")


@query("greedy_budget", f"""WITH RECURSIVE {N}, o AS (SELECT *, row_number() OVER (PARTITION BY req ORDER BY score DESC, ord) AS k FROM n),
w(req, k, ord, take, used, stop) AS (
  SELECT req, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, 0::BIGINT, false FROM (SELECT DISTINCT req FROM n)
  UNION ALL SELECT w.req, o.k, o.ord, CASE WHEN stop THEN NULL WHEN used + tokens <= 3000 THEN tokens WHEN used = 0 AND tokens > 3000 THEN 3000 END,
    used + coalesce(CASE WHEN stop THEN NULL WHEN used + tokens <= 3000 THEN tokens WHEN used = 0 AND tokens > 3000 THEN 3000 END, 0), stop OR (used = 0 AND tokens > 3000)
  FROM w JOIN o ON o.req = w.req AND o.k = w.k + 1)
SELECT req, ord, take AS tokens FROM w WHERE take IS NOT NULL""")
def _(spark, d):
    return budget.greedy(_candidates(spark, d), 3000)


@query("proportional_budget", f"WITH {N}, p AS (SELECT *, floor(20000 * (score / sum(score) OVER (PARTITION BY req)))::BIGINT AS share FROM n) SELECT req, ord, CASE WHEN tokens <= share THEN tokens ELSE share END AS tokens FROM p WHERE tokens <= share OR share > 100")
def _(spark, d):
    return budget.proportional(_candidates(spark, d), 20000)


@query("adaptive_choice", f"WITH {N} SELECT req, CASE WHEN sum(tokens) <= 30000 THEN 'greedy' WHEN count(*) > 100 THEN 'greedy' WHEN var_pop(score) < 0.1 THEN 'proportional' ELSE 'knapsack' END AS strategy FROM n GROUP BY req")
def _(spark, d):
    return budget.adaptive_choice(_candidates(spark, d), 30000)


@query("knapsack_budget")
def _(spark, d):
    return budget.knapsack(_candidates(spark, d), 3000)


@query("allocation_result", f"WITH {N}, p AS (SELECT *, floor(19500 * (score / sum(score) OVER (PARTITION BY req)))::BIGINT AS share FROM n), t AS (SELECT req, CASE WHEN tokens <= share THEN tokens WHEN share > 100 THEN share END AS take, tokens FROM p) SELECT req, count(take) AS nodes_included, coalesce(sum(take), 0)::BIGINT AS total_tokens, count(*) FILTER (WHERE take < tokens) AS nodes_truncated, count(*) - count(take) AS nodes_excluded FROM t GROUP BY req")
def _(spark, d):
    return budget.allocate(_candidates(spark, d), 20000, "proportional")[1].drop("budget_used_pct")


@query("token_estimates", "SELECT doc_id, floor(length(text) / 4.0)::BIGINT AS gpt, floor(length(text) / 3.5)::BIGINT AS claude FROM documents")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", estimated_tokens(F.length("text")).alias("gpt"), tokens.estimate(F.col("text"), "claude-3-opus").alias("claude"))


@query("truncated_nodes", "SELECT doc_id, substring(text, 1, 200) || chr(10) || '# ... truncated ...' AS content FROM documents WHERE floor(length(text) / 4.0) > 100")
def _(spark, d):
    x = _t(spark, d, "documents").where(tokens.estimate(F.col("text")) > 100)
    return x.select("doc_id", F.concat(tokens.truncate(F.col("text"), F.lit(50)), F.lit("\n# ... truncated ...")).alias("content"))


@query("snippets", "SELECT doc_id, CASE WHEN length(text) <= 100 THEN text WHEN contains(left(text, 100), chr(10)) AND 100 - strpos(reverse(left(text, 100)), chr(10)) > 70 THEN left(text, 100 - strpos(reverse(left(text, 100)), chr(10))) ELSE left(text, 100) || '...' END AS snippet FROM documents")
def _(spark, d):
    return _t(spark, d, "documents").select("doc_id", snippet(F.col("text")).alias("snippet"))


@query("summary_level", f"""WITH {FILES}, n AS (SELECT doc_id, 'x' || doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'class' ELSE 'function' END AS type, 'name_' || doc_id AS name, path, text AS content FROM files),
h AS (SELECT *, '# ' || path || ':' || (doc_id % 50) AS head FROM n),
s AS (SELECT *, head || chr(10) || content AS a, CASE type WHEN 'function' THEN head || chr(10) || 'def ' || name || '(...):' || chr(10) || '    ...' WHEN 'class' THEN head || chr(10) || 'class ' || name || ':' ELSE head END AS b, head || chr(10) || name AS c FROM h)
SELECT doc_id, CASE WHEN length(a) // 4 <= 60 THEN 'full' WHEN length(b) // 4 <= 60 THEN 'signature' WHEN length(c) // 4 <= 60 THEN 'stub' ELSE 'reference' END AS level, CASE WHEN length(a) // 4 <= 60 THEN a WHEN length(b) // 4 <= 60 THEN b WHEN length(c) // 4 <= 60 THEN c END AS summary FROM s""")
def _(spark, d):
    n = files(spark, d).selectExpr("doc_id", "concat('x', doc_id) AS id", "CASE doc_id % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'class' ELSE 'function' END AS type", "concat('name_', doc_id) AS name", "path", "doc_id % 50 AS start_line", "text AS content")
    return tokens.summarize(n, 60).select("doc_id", "level", "summary")


@query("presets", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v[0]}, {v[1]}, {v[2]}, {v[3]}::DOUBLE)" for k, v in PRESETS.items()) + ") v(model, context_window, recommended, most, chars_per_token)")
def _(spark, d):
    return spark.createDataFrame([(k, *v) for k, v in PRESETS.items()], "model string, context_window int, recommended int, most int, chars_per_token double")


@query("centroids", "SELECT label, i::INT AS i, round(avg(x::DOUBLE), 5)::DOUBLE AS mean FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings) GROUP BY ALL")
def _(spark, d):
    return clustering.centroids(_t(spark, d, "embeddings"), "label").select("label", F.posexplode("centroid").alias("i", "mean")).select("label", "i", F.round("mean", 5).alias("mean"))


@query("cluster_labels", f"WITH {FILES}, c AS (SELECT doc_id % 7 AS cluster, CASE WHEN doc_id % 3 = 0 THEN 'file' ELSE 'class' END AS type, count(*) AS n FROM files GROUP BY ALL) SELECT cluster, arg_max(type, n) AS dominant_type, 'src' AS common_path FROM c GROUP BY cluster")
def _(spark, d):
    return clustering.labels(files(spark, d).selectExpr("doc_id % 7 AS cluster", "CASE WHEN doc_id % 3 = 0 THEN 'file' ELSE 'class' END AS type", "path"))


@query("kmeans_clusters")
def _(spark, d):
    return clustering.kmeans(_t(spark, d, "embeddings"), 8).select("vec_id", "cluster")


@query("density_clusters")
def _(spark, d):
    return clustering.density(_t(spark, d, "embeddings"), None, "vec_id")


@query(
    "vector_index_topk",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS qid, e.vec_id, list_cosine_similarity(q.v, e.v) AS score FROM e q JOIN e ON q.vec_id % 100 = 0),
r AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, vec_id) AS rank, vec_id AS id, score FROM s)
SELECT qid, rank, id, round(score, 6)::DOUBLE AS score FROM r WHERE rank <= 10""",
)
def _(spark, d):
    v = _t(spark, d, "embeddings")
    index = vector_index.opened(v, "vec_id", "embeddings", [f"{d}/embeddings.parquet"])
    found = index.search(v.where("vec_id % 100 = 0"), "vec_id", 10, exact=True)
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


@query(
    "silhouette",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM e a, e b GROUP BY ALL),
x AS (SELECT vec_id, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6)::DOUBLE AS silhouette FROM x""",
)
def _(spark, d):
    return spark.createDataFrame([(round(clustering.silhouette(_t(spark, d, "embeddings"), "label"), 6),)], "silhouette double")
