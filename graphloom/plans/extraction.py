"""Service scans and source parsing over texts made from the driver's tables."""

from pyspark.sql import functions as F

from ..operators import extract, services, traverse
from ..operators.lookup import valid_edges
from .registry import query

CALLS = """'requests.get("' || url || '")'"""
NAME = """CASE WHEN contains(u, '://') THEN CASE WHEN regexp_matches(lower(h), 'api|service|svc|gateway') THEN string_split(string_split(h, ':')[1], '.')[1] WHEN contains(h, ':') AND NOT starts_with(h, 'localhost') THEN string_split(h, ':')[1] END END"""


def _lines(spark, d):
    host = "CASE page_id % 4 WHEN 0 THEN replace(url, 'http', 'https') WHEN 1 THEN concat('http://user-service:', page_id, '/api') WHEN 2 THEN concat('http://db', page_id % 9, ':5432/x') ELSE url END"
    return spark.read.parquet(f"{d}/pages.parquet").selectExpr("page_id AS line", "'a.py' AS path", f"concat('x = requests.get(\"', {host}, '\")') AS text")


HOST = "CASE page_id % 4 WHEN 0 THEN replace(url, 'http', 'https') WHEN 1 THEN 'http://user-service:' || page_id || '/api' WHEN 2 THEN 'http://db' || (page_id % 9) || ':5432/x' ELSE url END"


@query("service_regex_scan", f"WITH u AS (SELECT page_id, {HOST} AS u FROM pages), h AS (SELECT *, string_split(string_split(u, '://')[2], '/')[1] AS h FROM u) SELECT page_id AS line, {NAME} AS service FROM h WHERE {NAME} IS NOT NULL AND {NAME} <> '' AND NOT contains(u, '\"') AND NOT contains(u, '''')")
def _(spark, d):
    return services.scan(_lines(spark, d), "py", F.lit("web-app")).select("line", "service")


@query("service_edges", f"WITH u AS (SELECT page_id, {HOST} AS u FROM pages), h AS (SELECT *, string_split(string_split(u, '://')[2], '/')[1] AS h FROM u) SELECT 'web-app' AS source, {NAME} AS service, max(page_id) AS line FROM h WHERE {NAME} IS NOT NULL AND {NAME} <> '' AND NOT contains(u, '\"') AND NOT contains(u, '''') GROUP BY ALL")
def _(spark, d):
    return services.dependencies(services.scan(_lines(spark, d), "py", F.lit("web-app")))


@query("kafka_topic_service", "WITH t AS (SELECT part.p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'order-events' WHEN 1 THEN 'ab-' || p_partkey WHEN 2 THEN 'pay.done_' || p_partkey ELSE 'plain' END AS topic FROM part) SELECT p_partkey, CASE WHEN contains(topic, '-') AND length(string_split(topic, '-')[1]) > 2 THEN string_split(topic, '-')[1] WHEN contains(topic, '.') AND length(string_split(topic, '.')[1]) > 2 THEN string_split(topic, '.')[1] WHEN contains(topic, '_') AND length(string_split(topic, '_')[1]) > 2 THEN string_split(topic, '_')[1] ELSE topic END AS service FROM t")
def _(spark, d):
    t = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey", "CASE p_partkey % 4 WHEN 0 THEN 'order-events' WHEN 1 THEN concat('ab-', p_partkey) WHEN 2 THEN concat('pay.done_', p_partkey) ELSE 'plain' END AS topic")
    return t.select("p_partkey", services.kafka_name(F.col("topic")).alias("service"))


def source_files(of, step=1, own="helper_"):
    """A small Python file for each k of ``of``: module m<k>, which imports and calls the one ``step`` before it."""
    k, prev = "CAST(k AS STRING)", f"CAST(k - {step} AS STRING)"
    text = f"concat('import pkg.m', {prev}, '\\nfrom os import path\\n\\nclass C', {k}, '(C', {prev}, '):\\n    \"\"\"doc\"\"\"\\n    def run(self, x):\\n        if x and x > 1:\\n            helper_', {prev}, '(x)\\n        return self.run(x)\\n\\ndef {own}', {k}, '(x):\\n    return helper_', {prev}, '(inner(x))\\n')"
    return of.selectExpr(f"concat('pkg/m', {k}, '.py') AS path", f"CAST({text} AS BINARY) AS content")


def sources(spark, d):
    """The files of all suppliers."""
    return source_files(spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_suppkey + 1 AS k"))


SUP = "sup AS (SELECT s_suppkey + 1 AS s_suppkey FROM supplier)"


@query("ast_nodes", f"WITH {SUP} SELECT 'pkg/m' || s_suppkey || '.py' AS path, unnest(['file', 'class', 'function', 'function']) AS type, unnest(['pkg/m' || s_suppkey || '.py', 'C' || s_suppkey, 'C' || s_suppkey || '::run', 'helper_' || s_suppkey]) AS id FROM sup")
def _(spark, d):
    return extract.nodes(extract.rows(sources(spark, d))).select("path", "type", "id")


@query("ast_edges", f"""WITH {SUP}, s AS (SELECT s_suppkey AS k, s_suppkey - 1 AS p FROM sup WHERE s_suppkey > (SELECT min(s_suppkey) FROM sup))
SELECT 'pkg/m' || k || '.py' AS source, 'pkg/m' || p || '.py' AS target, 'IMPORTS' AS type, 1 AS line FROM s
UNION ALL SELECT 'C' || k, 'C' || p, 'EXTENDS', 4 FROM s
UNION ALL SELECT 'C' || k || '::run', 'helper_' || p, 'CALLS', 8 FROM s
UNION ALL SELECT 'helper_' || k, 'helper_' || p, 'CALLS', 12 FROM s""")
def _(spark, d):
    parsed = extract.rows(sources(spark, d))
    return valid_edges(extract.edges(parsed), extract.nodes(parsed)).select("source", "target", "type", "line")


@query("ast_complexity", f"WITH {SUP} SELECT 'C' || s_suppkey || '::run' AS id, 3::BIGINT AS complexity FROM sup UNION ALL SELECT 'helper_' || s_suppkey, 1 FROM sup")
def _(spark, d):
    return extract.nodes(extract.rows(sources(spark, d))).where("type = 'function'").select("id", "complexity")


@query("predict_impacted", f"WITH {SUP}, m AS (SELECT min(s_suppkey) AS least, max(s_suppkey) AS most FROM sup) SELECT 'pkg/m' || (least + k) || '.py' AS path FROM m, (VALUES (1), (2), (3)) v(k) WHERE least + k <= most")
def _(spark, d):
    s = spark.read.parquet(f"{d}/supplier.parquet").agg(F.min(F.col("s_suppkey") + 1).alias("k")).first().k
    uses = extract.predicted_uses(extract.rows(sources(spark, d)).where("NOT (kind = 'call' AND ref = 'self.run')"))
    return traverse.reach(uses, spark.createDataFrame([(f"pkg/m{s}.py",)], "id string"), 3).where("depth > 0").select(F.col("id").alias("path"))


@query("code_chunks", f"WITH {SUP} SELECT 'pkg/m' || s_suppkey || '.py::helper_' || s_suppkey || '::11' AS id, 'helper_' || s_suppkey AS name FROM sup UNION ALL SELECT 'pkg/m' || s_suppkey || '.py::run::6', 'run' FROM sup UNION ALL SELECT 'pkg/m' || s_suppkey || '.py::C' || s_suppkey || '::4', 'C' || s_suppkey FROM sup")
def _(spark, d):
    return extract.rows(sources(spark, d)).where("kind = 'chunk'").select("id", "name")
