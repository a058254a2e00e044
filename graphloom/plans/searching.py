"""Search by text, embedding, local context, metrics, sources in several shapes, and the knapsack's optimum."""

from pyspark.sql import functions as F

from ..api import CodeGraph
from ..operators import budget, embed, extract, formats, metrics, recalc, search, services, traverse, vector_index
from ..sources.graph import G, adjacency, edges, nodes
from .filters import PATHS
from .registry import query
from .retrieval import N, _candidates

#: The hashed words of each document: place and count; of document 5 as the text that is searched for.
WORDS = "w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM documents), c AS (SELECT doc_id, ('0x' || left(md5(w), 4))::INT % 64 AS i, count(*) AS n FROM w GROUP BY ALL)"
SCORES = f"{WORDS}, l AS (SELECT doc_id, sqrt(sum(n * n)) AS l FROM c GROUP BY 1), s AS (SELECT c.doc_id, round(sum(c.n * q.n)::DOUBLE / any_value(l.l) / (SELECT l FROM l WHERE doc_id = 5), 12) AS score FROM c JOIN c q ON q.doc_id = 5 AND q.i = c.i JOIN l ON l.doc_id = c.doc_id GROUP BY 1)"


def _documents(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _index(spark, d):
    return vector_index.opened(embed.embed(_documents(spark, d).select("doc_id", "text")), "doc_id", "document-words", [f"{d}/documents.parquet"])


def _text(spark, d):
    return _documents(spark, d).where("doc_id = 5").select("text").first().text


@query("document_vectors", f"WITH {WORDS} SELECT doc_id, count(c.i) AS places, coalesce(sum(c.n), 0)::BIGINT AS words, coalesce(sum((c.i + 1) * c.n), 0)::BIGINT AS weighted FROM documents LEFT JOIN c USING (doc_id) GROUP BY doc_id")
def _(spark, d):
    v = embed.embed(_documents(spark, d).select("doc_id", "text"))
    total = lambda f: F.aggregate(F.transform("embedding", f), F.lit(0.0), lambda a, x: a + x).cast("long")
    return v.select("doc_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("places"), total(lambda x, i: x).alias("words"), total(lambda x, i: x * (i + 1)).alias("weighted"))


KIND = "CASE WHEN doc_id % 5 = 0 THEN 'file' ELSE 'function' END"


@query(
    "search_semantic",
    f"""WITH {SCORES}, p AS (SELECT doc_id, {PATHS} AS path, {KIND} AS type, text FROM documents),
t AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 60), h AS (SELECT * FROM t JOIN p USING (doc_id) WHERE score >= 0.7 AND (ends_with(path, '.py') OR ends_with(path, '.rs')) AND contains(path, 'src/'))
SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, CASE WHEN type = 'file' THEN path ELSE path || '::f' || doc_id END AS fqn, round(score, 6)::DOUBLE AS score, CASE WHEN length(text) <= 100 THEN text WHEN contains(left(text, 100), chr(10)) AND 100 - strpos(reverse(left(text, 100)), chr(10)) > 70 THEN left(text, 100 - strpos(reverse(left(text, 100)), chr(10))) ELSE left(text, 100) || '...' END AS snippet
FROM h QUALIFY rank <= 30""",
)
def _(spark, d):
    chunks = _documents(spark, d).selectExpr("doc_id", f"{PATHS} AS file_path", f"{KIND} AS type", "concat('f', doc_id) AS name", "text AS content")
    found = search.semantic(chunks, "doc_id", _index(spark, d), _text(spark, d), 30, [".py", ".rs"], ["src/"])
    return found.select("rank", "fqn", F.round("score", 6).alias("score"), "snippet")


@query("search_graph", f"WITH {G} SELECT row_number() OVER (ORDER BY CASE WHEN contains(lower(name), 'get') THEN length(name) ELSE 0 END DESC, ord)::INT AS rank, id AS fqn, type, path AS file_path, 0.8::DOUBLE AS score, type || ': ' || name AS snippet FROM nodes WHERE contains(lower(name || ' ' || path), 'get') AND contains(path, 'c:1') AND type <> 'file' QUALIFY rank <= 50")
def _(spark, d):
    return CodeGraph.tables(spark, d).find("GET", "graph", 50, paths=["c:1"])


@query(
    "search_hybrid",
    f"""WITH RECURSIVE {G}, {SCORES}, r(id, depth) AS (SELECT 'c:5', 0 UNION SELECT CASE WHEN e.source = r.id THEN e.target ELSE e.source END, depth + 1 FROM r JOIN edges e ON e.source = r.id OR e.target = r.id WHERE depth < 1),
g AS (SELECT DISTINCT CASE WHEN type = 'file' THEN path ELSE id END AS fqn FROM nodes WHERE id IN (SELECT id FROM r)), t AS (SELECT 'o:' || doc_id AS fqn, score FROM s WHERE score >= 0.7 ORDER BY score DESC, doc_id LIMIT 50),
x AS (SELECT coalesce(g.fqn, t.fqn) AS fqn, round(0.4 * CASE WHEN g.fqn IS NULL THEN 0.1::DOUBLE ELSE 1.0 END + 0.6 * coalesce(score, 0), 12) AS score FROM g FULL JOIN t ON g.fqn = t.fqn)
SELECT row_number() OVER (ORDER BY score DESC, fqn)::INT AS rank, fqn, round(score, 6)::DOUBLE AS score FROM x QUALIFY rank <= 40""",
)
def _(spark, d):
    chunks = _documents(spark, d).selectExpr("doc_id", "concat('o:', doc_id) AS file_path", "'file' AS type", "concat('f', doc_id) AS name")
    g = CodeGraph(nodes(spark, d), edges(spark, d), adjacency(spark, d))
    found = g.find(_text(spark, d), "hybrid", 40, chunks, "doc_id", _index(spark, d), ["c:5"], 1)
    return found.select("rank", "fqn", F.round("score", 6).alias("score"))


@query(
    "local_context",
    f"""WITH {G}, m AS (SELECT id, min(depth) AS depth FROM (SELECT unnest(['c:5', 'n:3']) AS id, 0 AS depth UNION ALL SELECT target, 1 FROM edges WHERE source IN ('c:5', 'n:3') UNION ALL SELECT source, 1 FROM edges WHERE target IN ('c:5', 'n:3')) GROUP BY id)
SELECT id, type, path, CASE depth WHEN 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS relevance FROM m JOIN nodes USING (id) ORDER BY depth, ord LIMIT 50""",
)
def _(spark, d):
    return CodeGraph(nodes(spark, d), edges(spark, d), adjacency(spark, d)).local_context(["c:5", "n:3"])[0]


def _case(of):
    return "CASE event_id % 10 " + " ".join(f"WHEN {i} THEN {of(i, m, *metrics.METRICS[m])}" for i, m in enumerate(metrics.METRICS)) + " END"


#: A label's value: the event's type for the first, the user's remainder for further ones.
_LABELS = _case(lambda i, m, kind, labels: " || ',' || ".join(f"'{x}=\"' || {'event_type' if k == 0 else 'user_id % 3'} || '\"'" for k, x in enumerate(labels)) or "''")
_KINDS = _case(lambda i, m, kind, labels: f"'{kind}'")


@query(
    "metrics_exposition",
    f"""WITH x AS (SELECT {_case(lambda i, m, kind, labels: f"'{m}'")} AS metric, {_LABELS} AS labels, {_KINDS} AS kind, floor(value) / 8 AS v, ts, event_id FROM events WHERE value IS NOT NULL), b AS (SELECT unnest({metrics.BUCKETS}) AS le)
SELECT metric, labels, 'value' AS series, round(CASE WHEN any_value(kind) = 'counter' THEN sum(v) ELSE arg_max(v, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || lpad(event_id::VARCHAR, 12, '0')) END, 6)::DOUBLE AS value FROM x WHERE kind <> 'histogram' GROUP BY metric, labels
UNION ALL SELECT metric, labels, 'le=' || le::DOUBLE, count(*) FILTER (WHERE v <= le)::DOUBLE FROM x, b WHERE kind = 'histogram' GROUP BY metric, labels, le
UNION ALL SELECT metric, labels, unnest(['le=+Inf', 'sum', 'count']), unnest([count(*), round(sum(v), 6), count(*)])::DOUBLE FROM x WHERE kind = 'histogram' GROUP BY metric, labels""",
)
def _(spark, d):
    names = F.element_at(F.array(*map(F.lit, metrics.METRICS)), (F.col("event_id") % 10 + 1).cast("int"))
    first, second = F.col("event_type"), (F.col("user_id") % 3).cast("string")
    labels = sorted({x for _, own in metrics.METRICS.values() for x in own})
    place = lambda x: F.when(names.isin([m for m, (_, own) in metrics.METRICS.items() if own and own[0] == x]), first).otherwise(second)
    e = spark.read.parquet(f"{d}/events.parquet")
    samples = e.select(names.alias("metric"), F.create_map(*[c for x in labels for c in (F.lit(x), place(x))]).alias("labels"), (F.floor("value") / 8).alias("value"), "ts", F.col("event_id").alias("ord"))
    return metrics.exposition(samples).withColumn("value", F.round("value", 6))


#: Sources in five shapes, one for each part: many branches, a class with a method, one that can't be parsed, nested functions
#: with relative imports, an empty file; some are in hidden or ignored folders.
SHAPES = [
    r"concat('def f', k, '(x):\n', repeat('    if x:\n        x = g.step(x)\n', CAST(k % 23 AS INT)), '    return x\n')",
    r"concat('class K', k, '(base.B):\n    async def go(self, xs):\n        for x in xs:\n            while x and self.ok:\n                x = a.b.c(x)\n        return xs\n')",
    r"concat('def broken', k, '(:\n')",
    r"concat('from . import a\nfrom ..m import b as c\nimport os.path\n\ndef outer', k, '(x):\n    def inner(y):\n        return [z for z in y if z]\n    try:\n        return inner(x) or c(x)\n    except ValueError:\n        return a.run(x)\n')",
    "''",
]
SHAPED_PATH = "concat('src/d', k % 7, '/', CASE k % 11 WHEN 0 THEN '.hidden/' WHEN 1 THEN 'venv/' ELSE '' END, 'f', k, '.py')"
#: All functions of them, for the oracles.
SHAPED = f"k AS (SELECT p_partkey AS k FROM part), f AS (SELECT *, {SHAPED_PATH} AS path, k % 11 > 1 AS seen FROM k), fn AS (SELECT *, CASE k % 5 WHEN 0 THEN 'f' || k WHEN 1 THEN 'K' || k || '::go' ELSE 'outer' || k END AS id, CASE k % 5 WHEN 0 THEN 1 + k % 23 WHEN 1 THEN 4 ELSE 5 END AS complexity FROM f WHERE k % 5 IN (0, 1, 3))"


def shaped(spark, d):
    k = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey AS k")
    text = "CASE k % 5 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(SHAPES)) + " END"
    return k.selectExpr(f"{SHAPED_PATH} AS path", f"CAST({text} AS BINARY) AS content")


@query("shaped_functions", f"WITH {SHAPED} SELECT path, id, complexity::BIGINT AS complexity FROM fn")
def _(spark, d):
    return extract.nodes(extract.rows(shaped(spark, d))).where("type = 'function'").select("path", "id", "complexity")


@query("directory_functions", f"WITH {SHAPED} SELECT 'src/d' || (f.k % 7) AS dir, count(*) AS n_files, count(fn.id) AS n_functions, coalesce(sum(complexity), 0)::BIGINT AS total, round(coalesce(avg(complexity), 0), 6)::DOUBLE AS mean, coalesce(max(complexity), 0)::BIGINT AS most, count(*) FILTER (WHERE complexity >= 11) AS n_hot FROM f LEFT JOIN fn ON fn.k = f.k WHERE f.seen GROUP BY 1")
def _(spark, d):
    return recalc.directory_complexity(extract.rows(shaped(spark, d))).withColumn("mean", F.round("mean", 6))


_RANK = "CASE WHEN complexity <= 5 THEN 'A' WHEN complexity <= 10 THEN 'B' WHEN complexity <= 20 THEN 'C' WHEN complexity <= 30 THEN 'D' WHEN complexity <= 40 THEN 'E' ELSE 'F' END"


@query(
    "complexity_report",
    f"""WITH {SHAPED}, x AS (SELECT *, {_RANK} AS rank FROM fn WHERE seen), h AS (SELECT * FROM x WHERE complexity >= 11 ORDER BY complexity DESC, path, id LIMIT 10)
SELECT (SELECT count(*) FROM f WHERE seen) AS n_files, (SELECT count(*) FROM x) AS n_functions, (SELECT round(avg(complexity), 2) FROM x)::DOUBLE AS average, (SELECT max(complexity) FROM x)::BIGINT AS most,
(SELECT string_agg(r || '=' || (SELECT count(*) FROM x WHERE rank = r), ' ' ORDER BY r) FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E', 'F']) AS r)) AS ranks,
(SELECT string_agg(complexity || ' ' || rank || ' ' || id || ' ' || path, ', ' ORDER BY complexity DESC, path, id) FROM h) AS hotspots""",
)
def _(spark, d):
    r = recalc.complexity_report(extract.rows(shaped(spark, d)))
    ranks = F.array_join(F.transform(F.array_sort(F.map_entries("ranks")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), " ")
    hot = F.array_join(F.transform("hotspots", lambda h: F.concat_ws(" ", h["complexity"].cast("string"), h["rank"], h["name"], h["file"])), ", ")
    return r.select("n_files", "n_functions", "average", "most", ranks.alias("ranks"), hot.alias("hotspots"))


@query(
    "recalculated_edges",
    f"""WITH {SHAPED}, e AS (
  SELECT unnest([path, id]) AS source, 'g.step' AS target, 'CALLS' AS type, 3 AS line FROM fn WHERE k % 5 = 0 AND k % 23 > 0
  UNION ALL SELECT unnest([path, 'K' || k]), 'base.B', 'EXTENDS', 1 FROM fn WHERE k % 5 = 1
  UNION ALL SELECT path, unnest(['.a', 'm.b', 'os.path']), 'IMPORTS', unnest([1, 2, 3]) FROM fn WHERE k % 5 = 3
  UNION ALL SELECT unnest([path, path, path, id, id, id]), unnest(['inner', 'c', 'a.run', 'inner', 'c', 'a.run']), 'CALLS', unnest([9, 9, 11, 9, 9, 11]) FROM fn WHERE k % 5 = 3)
SELECT source, target, type, line::INT AS line, true AS external FROM e""",
)
def _(spark, d):
    files = shaped(spark, d)
    e, missing = recalc.recalculated(files, extract.nodes(extract.rows(files)))
    return e.join(missing.select(F.col("id").alias("target"), F.lit(True).alias("out")), "target", "left").select("source", "target", "type", "line", F.coalesce("out", F.lit(False)).alias("external"))


@query(
    "knapsack_value",
    f"""WITH RECURSIVE {N}, o AS (SELECT req, tokens AS t, round(score * 100)::BIGINT AS s, row_number() OVER (PARTITION BY req ORDER BY ord) AS k FROM n),
b(req, k, best) AS (SELECT req, 0::BIGINT, list_transform(range(0, 3001), lambda j: 0::BIGINT) FROM (SELECT DISTINCT req FROM n)
  UNION ALL SELECT b.req, o.k, list_transform(range(0, 3001), lambda j: greatest(best[j + 1], CASE WHEN j >= t THEN best[j - t + 1] + s ELSE 0 END)) FROM b JOIN o ON o.req = b.req AND o.k = b.k + 1)
SELECT req, arg_max(best[3001], k) AS value FROM b GROUP BY req""",
)
def _(spark, d):
    """The optimum's score; which of several equal subsets is taken, SQL can't say."""
    n = _candidates(spark, d)
    taken = budget.knapsack(n, 3000).select("req", "ord").join(n, ["req", "ord"]).groupBy("req").agg(F.sum(F.round(F.col("score") * 100).cast("long")).alias("v"))
    return n.select("req").distinct().join(taken, "req", "left").select("req", F.coalesce("v", F.lit(0).cast("long")).alias("value"))


@query(
    "allocation_report",
    f"""WITH {N}, p AS (SELECT *, floor(19500 * (score / sum(score) OVER (PARTITION BY req)))::BIGINT AS share FROM n), t AS (SELECT req, tokens, CASE WHEN tokens <= share THEN tokens WHEN share > 100 THEN share END AS take FROM p)
SELECT req, coalesce(sum(take), 0)::BIGINT AS total_tokens, round(coalesce(sum(take), 0) * 100 / 20000, 1)::DOUBLE AS budget_used_pct, count(take) AS nodes_included, count(*) FILTER (WHERE take < 50) AS nodes_truncated, count(*) - count(take) AS nodes_excluded,
round(coalesce(avg(take), 0), 1)::DOUBLE AS mean_tokens, round(coalesce(median(take), 0), 1)::DOUBLE AS median_tokens, (sum(tokens) - coalesce(sum(take), 0))::BIGINT AS token_savings, coalesce(round(count(*) FILTER (WHERE take < 50) * 100 / nullif(count(take), 0), 1), 0)::DOUBLE AS truncation_rate FROM t GROUP BY req""",
)
def _(spark, d):
    n = _candidates(spark, d)
    return budget.allocation_report(n, budget.allocate(n, 20000, "proportional")[0], 20000)


@query(
    "shortest_path_nodes",
    f"""WITH RECURSIVE {G}, a AS (SELECT DISTINCT source AS a, target AS b FROM edges UNION SELECT DISTINCT target, source FROM edges), r(id, n) AS (SELECT 'r:0', 0 UNION SELECT a.b, n + 1 FROM r JOIN a ON a.a = r.id WHERE n < 4 AND NOT EXISTS (SELECT 1 FROM r WHERE id = 'p:7')),
l AS (SELECT id, min(n) AS n FROM r GROUP BY id), up AS (SELECT a.b AS id, min(a.a) AS parent FROM a JOIN l x ON x.id = a.a JOIN l y ON y.id = a.b AND y.n = x.n + 1 GROUP BY 1),
w(id, n) AS (SELECT id, n FROM l WHERE id = 'p:7' UNION ALL SELECT up.parent, w.n - 1 FROM w JOIN up ON up.id = w.id WHERE w.n > 0)
SELECT n::INT AS place, id FROM w""",
)
def _(spark, d):
    """The nodes of a shortest path in order; of several, the one of the smallest parents from its end."""
    path = traverse.shortest_path(adjacency(spark, d), "r:0", "p:7") or []
    return spark.createDataFrame(list(enumerate(path)), "place int, id string")


@query(
    "summary_tree",
    f"""WITH {G}, e AS (SELECT id, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT target AS id, 1 AS i, 0 AS o FROM edges UNION ALL SELECT source, 0, 1 FROM edges) GROUP BY id),
f AS (SELECT name, coalesce(n_in, 0)::BIGINT AS n_in, coalesce(n_out, 0)::BIGINT AS n_out, row_number() OVER (ORDER BY coalesce(n_in, 0) + coalesce(n_out, 0) DESC, ord) AS k, count(*) OVER () AS n FROM nodes LEFT JOIN e USING (id) WHERE type = 'file')
SELECT '📊 tables - Dependency Summary' || chr(10) || '   Total: ' || any_value(n) || ' files, ' || (SELECT count(*) FROM edges) || ' edges' || chr(10) || chr(10) || 'Top connected files:' || chr(10) || string_agg(CASE WHEN k = least(10, n) THEN '   └── ' ELSE '   ├── ' END || name || ' (' || n_in || '↓ ' || n_out || '↑)', chr(10) ORDER BY k) FILTER (WHERE k <= 10) || CASE WHEN any_value(n) > 10 THEN chr(10) || '   ... and ' || (any_value(n) - 10) || ' more files' ELSE '' END AS text FROM f""",
)
def _(spark, d):
    return formats.summary_lines(nodes(spark, d), edges(spark, d), "tables")


@query("prompt_files", f"WITH {G} SELECT path, '#### ' || path || chr(10) || string_agg('- **' || type || '**: ' || id || ' (relevance: ' || printf('%.2f', (ord % 4) / 4.0) || ')', chr(10) ORDER BY ord) || chr(10) AS text FROM nodes GROUP BY path")
def _(spark, d):
    n = nodes(spark, d).withColumns({"relevance": (F.col("ord") % 4) / 4, "content": F.lit(None).cast("string")})
    return formats.file_sections(n).select("path", "text")


@query("prompt_edges", f"WITH {G}, p AS (SELECT id, path FROM nodes WHERE type <> 'file') SELECT e.ord, '- `' || a.path || '` **' || e.type || '** `' || b.path || '`' || chr(10) || '  (line ' || line || ')' || chr(10) AS text FROM edges e JOIN p a ON a.id = source JOIN p b ON b.id = target")
def _(spark, d):
    return formats.edge_lines(edges(spark, d), nodes(spark, d).where("type <> 'file'"))


#: Lines of source that name services: for each kind of call, by language, with the service that it means (null: none).
CALLS = {
    "py": [
        ("http", "x = requests.get(\"http://user-service-#.local/x\")", "user-service-#"),
        ("http", "httpx.post('http://db#:5432/x')", "db#"),
        ("http", "urllib.request.urlopen(\"http://api-#.net/\")", "api-#"),
        ("grpc", "c = grpc.aio.secure_channel(\"grpc://pay#:50051\")", "pay#"),
        ("grpc", "c = grpc.aio.insecure_channel('cart#:1')", "cart#"),
        ("kafka", "producer.send(\"order-events#\")", "order"),
        ("kafka", "p = KafkaProducer(acks=1, topic=\"ship.done#\")", "ship"),
        ("import", "from api.users# import x", "users#"),
        ("import", "import billing#.client", "billing#"),
        ("http", "requests.get(\"http://plain#.com/\")", None),
        ("import", "import json.decoder#", None),
    ],
    "ts": [
        ("http", "await axios.put('http://auth-api#:80/x')", "auth-api#"),
        ("http", "fetch(\"http://gateway#.in/x\")", "gateway#"),
        ("http", "http.get('http://db#:5432')", "db#"),
        ("grpc", "const c = new grpc.Client(\"mail#:90\")", "mail#"),
        ("kafka", "producer.send('bill_paid#')", "bill"),
        ("kafka", "kafka.producer({ topic: \"stock.low#\" })", "stock"),
        ("import", "import { a } from '@acme#/lib'", "acme#"),
        ("import", "import b from \"shared#/lib\"", "shared#"),
        ("import", "import c from './local#'", None),
        ("http", "fetch('http://localhost:80/#')", None),
    ],
}


def _sql(text):
    return "'" + text.replace("'", "''") + "'"


def _calls(language):
    own = CALLS[language]
    parts = [f"SELECT p_partkey AS line, replace({_sql(s)}, '#', p_partkey::VARCHAR) AS service, '{kind}' AS kind FROM part WHERE p_partkey % {len(own)} = {i}" for i, (kind, _, s) in enumerate(own) if s]

    @query(f"service_kinds_{language}", " UNION ALL ".join(parts))
    def _(spark, d):
        text = F.replace(F.element_at(F.array(*[F.lit(t) for _, t, _ in own]), (F.col("p_partkey") % len(own) + 1).cast("int")), F.lit("#"), F.col("p_partkey").cast("string"))
        lines = spark.read.parquet(f"{d}/part.parquet").select(F.lit("a").alias("path"), F.col("p_partkey").alias("line"), text.alias("text"))
        return services.scan(lines, language, F.lit("web-app")).select("line", "service", "kind")


for _language in CALLS:
    _calls(_language)
