"""Service dependencies found in source lines by patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns by language and kind; the last group (imports: both) holds the address, topic or module.
PATTERNS = {
    "py": {
        "http": [r"""requests\.(get|post|put|delete|patch)\(["']([^"']*?)["']""", r"""urllib\.request\.urlopen\(["']([^"']*?)["']""", r"""httpx\.(get|post|put|delete|patch)\(["']([^"']*?)["']""", r"""fetch\(["']([^"']*?)["']"""],
        "grpc": [r"""grpc\.client\.stub\(["']([^"']*?)["']""", r"""\.stub\(["']([^"']*?)["']""", r"""grpc\.aio\.secure_channel\(["']([^"']*?)["']""", r"""grpc\.aio\.insecure_channel\(["']([^"']*?)["']"""],
        "kafka": [r"""KafkaProducer.*topic=["']([^"']*?)["']""", r"""KafkaConsumer.*topic=["']([^"']*?)["']""", r"""\.send\(.*topic=["']([^"']*?)["']""", r"""\.subscribe\(\["']([^"']*?)["']""", r"""producer\.send\(["']([^"']*?)["']""", r"""consumer\.subscribe\(\["']([^"']*?)["']"""],
        "import": [r"import\s+([a-zA-Z_][a-zA-Z0-9_]*)\.([a-zA-Z_][a-zA-Z0-9_]*)", r"from\s+([a-zA-Z_][a-zA-Z0-9_]*)\.([a-zA-Z_][a-zA-Z0-9_]*)\s+import"],
    },
    "ts": {
        "http": [r"""fetch\(["']([^"']*?)["']""", r"""axios\.(get|post|put|delete|patch)\(["']([^"']*?)["']""", r"""http\.(get|post|put|delete|patch)\(["']([^"']*?)["']"""],
        "grpc": [r"""grpc\.client\(["']([^"']*?)["']""", r"""new\s+grpc\.Client\(["']([^"']*?)["']"""],
        "kafka": [r"""producer\.send\(["']([^"']*?)["']""", r"""consumer\.subscribe\(\["']([^"']*?)["']""", r"""kafka\.producer.*topic:\s*["']([^"']*?)["']""", r"""kafka\.consumer.*topic:\s*["']([^"']*?)["']"""],
        "import": [r"""import\s+.*from\s+["']([^"']*?)["']""", r"""import\s*\*\s+as\s+.*from\s+["']([^"']*?)["']"""],
    },
}


def http_name(url: Column) -> Column:
    """Service part of an address: before the first dot for hosts that look like services, before the port for others; none for plain hosts."""
    host = F.split(F.split(url, "://")[1], "/")[0]
    bare = F.split(host, ":")[0]
    like = F.lower(host).rlike("api|service|svc|gateway")
    return F.when(url.contains("://"), F.when(like, F.split(bare, r"\.")[0]).when(host.contains(":") & ~host.startswith("localhost"), bare))


def grpc_name(address: Column) -> Column:
    return F.split(F.regexp_replace(address, "grpcs?://", ""), ":")[0]


def kafka_name(topic: Column) -> Column:
    tries = [F.when(topic.contains(s) & (F.length(F.split(topic, p)[0]) > 2), F.split(topic, p)[0]) for s, p in (("-", "-"), (".", r"\."), ("_", "_"))]
    return F.coalesce(*tries, topic)


def py_import_name(module: Column, sub: Column) -> Column:
    return F.when(module.isin("api", "client", "service", "grpc", "kafka"), sub).when(sub.isin("api", "client", "service"), module)


def ts_import_name(path: Column) -> Column:
    return F.when(path.startswith("@"), F.substring(F.split(path, "/")[0], 2, 1000)).when(path.contains("/") & ~path.startswith("."), F.split(path, "/")[0])


def scan(lines: DataFrame, language: str, source: Column) -> DataFrame:
    """source, service, kind, line, context of ``lines`` (path, line, text): a row for each match; a service isn't its own dependency."""
    found = []
    for kind, patterns in PATTERNS[language].items():
        for p in patterns:
            n = p.count("(") - p.count(r"\(") - p.count("(?")
            hit = lambda g: F.regexp_extract_all("text", F.lit(p), F.lit(g))  # noqa: B023, E731
            if kind == "import" and language == "py":
                pairs = F.arrays_zip(hit(1).alias("a"), hit(2).alias("b"))
                names = F.transform(pairs, lambda x: py_import_name(x["a"], x["b"]))
            else:
                name = {"http": http_name, "grpc": grpc_name, "kafka": kafka_name, "import": ts_import_name}[kind]
                names = F.transform(hit(max(n, 1)), name)
            found.append(F.transform(names, lambda s: F.struct(s.alias("service"), F.lit(kind).alias("kind"))))  # noqa: B023
    x = lines.select(source.alias("source"), "path", "line", "text", F.explode(F.flatten(F.array(*found))).alias("m"))
    return x.where("m.service IS NOT NULL AND m.service <> '' AND m.service <> source").select("source", "m.service", "m.kind", "path", "line", F.trim("text").alias("context"))


def dependencies(found: DataFrame) -> DataFrame:
    """SERVICE_CALLS edges: source, service, the last line of each."""
    return found.groupBy("source", "service").agg(F.max("line").alias("line"))
