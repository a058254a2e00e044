"""Streams run to their end and compared with the batch result."""

import json

from pyspark.sql import functions as F

from graphloom.operators import usage
from graphloom.streaming import sync_state, webhooks


def test_counters_equal_batch(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    s = webhooks.running_counters(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user_id, str(r.start)[:10]): r.n for r in spark.table("counts").collect()}
    want = {(r.user_id, str(r.day)): r.n for r in usage.events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_webhooks_retry_dead_letters_and_replay(spark, tmp_path):
    body = lambda i: json.dumps({"ref": "refs/heads/main", "repository": {"full_name": "o/r"}, "pusher": {"name": "u"}, "commits": [{"id": f"c{i}", "added": ["a"], "modified": [], "removed": []}]})
    rows = [(f"d{i}", "r", e, body(i), f"2024-01-01T00:00:0{i}") for i, e in enumerate(["push", "push", "ping", "push"])]
    rows.append(rows[0])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(["delivery_id", "repo_id", "event", "data", "received_at"], r, strict=True))) for r in rows))
    p = webhooks.Processor(str(tmp_path / "done"), str(tmp_path / "dead"))

    @p.on("push")
    def _(df):
        return webhooks.snapshots_of_push(df).select("delivery_id", (F.col("sha") != "c3").alias("ok"), "sha", F.lit("failing commit").alias("detail"))

    for _ in range(2):  # the second run finds nothing new
        p.start(webhooks.read(spark, str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.sha for r in spark.read.parquet(str(tmp_path / "done")).collect()) == ["c0", "c1"]
    assert sorted((r.delivery_id, r.detail) for r in spark.read.parquet(str(tmp_path / "dead")).collect()) == [("d2", "unknown event ping"), ("d3", "failing commit")]


def test_no_row_is_lost(spark, tmp_path):
    """Null events, deliveries and answers, missing and mixed answers; a batch that runs again with less to say."""
    rows = [("a", "push"), ("b", "push"), ("c", "push"), ("d", "push"), (None, "push"), ("e", None), ("f", "ping"), ("g", "push")]
    df = spark.createDataFrame(rows, "delivery_id string, event string")
    p, calls = webhooks.Processor(str(tmp_path / "done"), str(tmp_path / "dead")), []

    @p.on("push")
    def _(df):
        calls.append(sorted(r.delivery_id for r in df.collect()))
        ok = F.when(F.col("delivery_id") == "a", True).when(F.col("delivery_id") == "b", False)
        one = df.where("delivery_id <> 'd'").select("delivery_id", ok.alias("ok"), F.lit("why").alias("detail"))
        two = df.where("delivery_id = 'g'").select("delivery_id", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("detail"))
        again = F.lit(len(calls) > 1)  # g is ok at the second attempt
        return one.withColumn("ok", F.when((F.col("delivery_id") == "g") & again, True).otherwise(F.col("ok"))).union(two)

    read = lambda name: sorted(((r.delivery_id, r.detail) for r in spark.read.parquet(str(tmp_path / name)).collect()), key=repr)
    p.batch(df, 7)
    assert calls == [["a", "b", "c", "d", "g"], ["b", "c", "d", "g"], ["b", "c", "d"]]
    assert read("done") == [("a", "why"), ("g", "why"), ("g", None)]
    assert read("dead") == [("b", "why"), ("c", "why"), ("d", "no answer"), ("e", "unknown event null"), ("f", "unknown event ping"), (None, "no delivery_id")]
    p.batch(df.where("delivery_id = 'a'"), 7)
    assert read("done") == [("a", "why")] and not (tmp_path / "dead" / "batch=7").exists()


def test_sync_states(spark, tmp_path):
    rows = [("a", 1, "start", None), ("a", 2, "done", "s1"), ("a", 3, "behind", None), ("b", 1, "start", None), ("b", 2, "fail", None), ("b", 3, "fail", None)]
    schema = "repo_id string, ord long, event string, sha string"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    q = sync_state.track(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("states").collect()} == {("a", "stale", 0, "s1", 3), ("b", "error", 2, None, 3)}


def test_next_state_and_signatures(spark):
    df = spark.createDataFrame([("synced", "behind"), ("error", "behind"), ("error", "start")], "s string, e string")
    assert [r.n for r in df.select(webhooks.next_state(F.col("s"), F.col("e")).alias("n")).collect()] == ["stale", "error", "syncing"]
    import hashlib
    import hmac

    good = "sha256=" + hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    assert webhooks.signature_ok("k", b"body", good) and not webhooks.signature_ok("k", b"body!", good)


def test_gitlab(spark):
    data = json.dumps({"object_kind": "merge_request", "project": {"path_with_namespace": "g/p"}, "user_username": "u", "ref": "refs/heads/x"})
    r = webhooks.normalize(spark.createDataFrame([("1", "any", data)], "delivery_id string, event string, data string"), "gitlab").first()
    assert (r.event, r.repo, r.branch, r.author, r.commits) == ("pull_request", "g/p", "x", "u", [])
