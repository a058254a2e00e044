"""The webhook stream: events from files or a queue, normalised, deduplicated, dispatched in micro-batches."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "delivery_id string, repo_id string, event string, data string, received_at timestamp"
KNOWN = ("push", "pull_request", "create", "delete")


def signature_ok(secret: str, body: bytes, header: str) -> bool:
    """Whether ``header`` is ``sha256=`` and the body's HMAC."""
    return hmac.compare_digest("sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest(), header)


def normalize(raw: DataFrame, provider: str = "github") -> DataFrame:
    """repo, event, branch, before, after, author, commits (sha, message, files) of raw bodies (event, data)."""
    j = lambda p: F.get_json_object("data", p)
    if provider == "gitlab":
        kinds = F.create_map(*map(F.lit, ["push", "push", "tag_push", "create", "merge_request", "pull_request"]))
        head, repo, author = F.coalesce(kinds[j("$.object_kind")], "event"), j("$.project.path_with_namespace"), j("$.user_username")
    else:
        head, repo, author = F.col("event"), j("$.repository.full_name"), F.coalesce(j("$.pusher.name"), j("$.sender.login"))
    commits = F.from_json(j("$.commits"), "array<struct<id:string,message:string,added:array<string>,modified:array<string>,removed:array<string>>>")
    return raw.withColumns({"event": head, "repo": repo, "branch": F.regexp_replace(j("$.ref"), "^refs/(heads|tags)/", ""), "before": j("$.before"), "after": j("$.after"), "author": author, "commits": F.coalesce(commits, F.array().cast("array<struct<id:string,message:string,added:array<string>,modified:array<string>,removed:array<string>>>"))})


def read(spark: SparkSession, path: str, delay: str = "10 minutes") -> DataFrame:
    """The stream of webhook JSON files under ``path``, each delivery once."""
    return spark.readStream.schema(SCHEMA).json(path).withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["delivery_id"])


Handler = Callable[[DataFrame], DataFrame]


class Processor:
    """Dispatches each micro-batch by event. A handler takes the event's rows and returns (delivery_id, ok, detail, ...), one
    row or several for a delivery; one of which a row isn't ok, or that has no answer, goes again up to ``retries`` times,
    then to the dead letters. Rows without delivery_id, and null or unknown events, are dead letters at once: every row ends in one of
    the two. For retries after a while see ``delays``."""

    def __init__(self, done: str, dead: str, retries: int = 3):
        self.handlers: dict[str, Handler] = {}
        self.done, self.dead, self.retries = done.rstrip("/"), dead.rstrip("/"), retries

    def on(self, event: str) -> Callable[[Handler], Handler]:
        def add(f: Handler) -> Handler:
            self.handlers[event] = f
            return f

        return add

    def batch(self, df: DataFrame, batch_id: int) -> None:
        """A batch that runs again replaces all that it wrote: each has a folder of its own, emptied first."""
        spark = df.sparkSession
        for root in (self.done, self.dead):
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/batch={batch_id}")
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

        def put(rows: DataFrame, root: str, step: str) -> None:
            rows.write.mode("overwrite").parquet(f"{root}/batch={batch_id}/step={step}")

        df = df.persist()
        known = F.coalesce(F.col("event").isin(*self.handlers), F.lit(False)) & F.col("delivery_id").isNotNull()
        for event, f in self.handlers.items():
            rows, waiting = df.where(known & (F.col("event") == event)), []
            for attempt in range(1, self.retries + 1):
                if rows.isEmpty():
                    break
                out = f(rows).persist()
                answers = out.groupBy("delivery_id").agg(F.min(F.coalesce("ok", F.lit(False))).alias("all_ok"), F.max(F.when(~F.coalesce("ok", F.lit(False)), F.col("detail"))).alias("why"))
                good = answers.where("all_ok").select("delivery_id")
                put(out.join(good, "delivery_id", "left_semi").withColumn("attempt", F.lit(attempt)), self.done, f"{event}-{attempt}")
                rows = rows.join(good, "delivery_id", "left_anti")
                if attempt == self.retries:
                    why = F.when(F.col("all_ok").isNull(), "no answer").otherwise(F.coalesce("why", F.lit("failed"))).alias("detail")
                    put(rows.join(answers, "delivery_id", "left").select("delivery_id", why), self.dead, event)
                else:
                    rows = rows.persist()  # as the answers were: a handler may say something else when asked again
                    rows.count()
                    waiting.append(rows)
                out.unpersist()
            for r in waiting:
                r.unpersist()
        lost = df.where(~known)
        if not lost.isEmpty():
            detail = F.when(F.col("delivery_id").isNull(), "no delivery_id").otherwise(F.concat(F.lit("unknown event "), F.coalesce("event", F.lit("null"))))
            put(lost.select("delivery_id", detail.alias("detail")), self.dead, "unknown")
        df.unpersist()

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshots_of_push(rows: DataFrame) -> DataFrame:
    """repo, sha: one snapshot for each commit of the pushes, keyed so that a replay changes nothing."""
    return normalize(rows).select("delivery_id", "repo", F.explode("commits").alias("c")).select("delivery_id", "repo", F.col("c.id").alias("sha"), F.size(F.array_distinct(F.concat(F.coalesce("c.added", F.array()), F.coalesce("c.modified", F.array()), F.coalesce("c.removed", F.array())))).alias("n_files")).dropDuplicates(["repo", "sha"])


def running_counters(events: DataFrame, width: str = "1 day", delay: str = "7 days") -> DataFrame:
    """user_id, start, n by tumbling windows of event time; state older than ``delay`` is dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return e.groupBy("user_id", F.window("ts", width)).agg(F.count("*").alias("n")).select("user_id", F.col("window.start").alias("start"), "n")


def over_limit(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """Counts that reach their user's limit (user_id, most); -1 is no limit. ``limits`` is a static table."""
    return counts.join(limits, "user_id").where((F.col("most") >= 0) & (F.col("n") >= F.col("most")))


def next_state(state: Column, event: Column) -> Column:
    """Sync state after an event; anything else leaves it as it is."""
    return F.when(event == "start", "syncing").when(event == "done", "synced").when(event == "fail", "error").when((event == "behind") & (state == "synced"), "stale").otherwise(state)
