"""Locks that expire and deliveries that are tried again, with a clock that the test moves."""

import datetime as dt
import json

import pytest

from graphloom.streaming import delays


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    delays.use_rocksdb(spark)
    yield spark
    spark.conf.set(name, was)


def run(spark, tmp_path, schema, steps, query, moves=1):
    """One micro-batch for each of ``steps``: rows with seconds as ts. Then some that only move the clock; a timer set by another goes off in the next."""
    (tmp_path / "in").mkdir()
    names = [c.split()[0] for c in schema.split(", ")]
    out = []
    for k, rows in enumerate([*steps, *[[(None,) * (len(names) - 1) + (1_000_000 + k,)] for k in range(moves)]]):
        lines = [json.dumps(dict(zip(names, r, strict=True)) | {"ts": dt.datetime.fromtimestamp(r[-1], dt.UTC).isoformat()}) for r in rows]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(lines))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
        q = query(stream).writeStream.outputMode("append").format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    for f in sorted((tmp_path / "out").glob("*.json")):
        out += [json.loads(x) for x in f.read_text().splitlines()]
    return out


def test_a_lock_that_is_not_released_expires(rocksdb, tmp_path):
    steps = [[("r", "a", "acquire", 1000), ("s", "a", "acquire", 1000)], [("r", "b", "acquire", 1100), ("s", "a", "release", 1100), ("r", "b", "release", 1101)], [("r", "b", "acquire", 1300), ("s", "c", "acquire", 1310)]]
    out = run(rocksdb, tmp_path, "repo_id string, owner string, action string, ts timestamp", steps, delays.locks)
    own = lambda repo: sorted((r["at"], r["owner"], r["result"]) for r in out if r.get("repo_id") == repo)
    assert own("r") == [(1000, "a", "acquired"), (1100, "b", "refused"), (1101, "b", "ignored"), (1300, "a", "expired"), (1300, "b", "acquired"), (1600, "b", "expired")]
    assert own("s") == [(1000, "a", "acquired"), (1100, "a", "released"), (1310, "c", "acquired"), (1610, "c", "expired")]


def test_deliveries_wait_are_tried_again_and_none_is_lost(rocksdb, tmp_path):
    event = lambda d, kind, at: (d, "event", kind, f"body {d}", None, None, None, at)
    answer = lambda d, attempt, ok, at: (d, "answer", None, None, attempt, ok, "why", at)
    steps = [
        [event("a", "push", 1000), event("b", "push", 1000), event("c", "push", 1000), event("d", None, 1000), event("e", "ping", 1000), event(None, "push", 1000), event(None, "push", 1000)],
        [answer("a", 1, True, 1010), answer("b", 1, None, 1010), event("a", "push", 1011), answer("b", 7, True, 1011)],
        [answer("b", 2, False, 1075), answer("a", 1, False, 1076)],
        [answer("b", 3, True, 1140)],
        [answer("b", 3, True, 1141)],
    ]
    schema = "delivery_id string, kind string, event string, data string, attempt int, ok boolean, detail string, ts timestamp"
    out = run(rocksdb, tmp_path, schema, steps, lambda s: delays.deliveries(s, ("push",)), moves=5)
    own = lambda d: sorted((r["at"], r["step"], r["attempt"]) for r in out if r.get("delivery_id") == d)
    assert own("a") == [(1000, "run", 1), (1010, "done", 1)]
    assert own("b") == [(1000, "run", 1), (1070, "run", 2), (1135, "run", 3), (1140, "done", 3)]
    # no answer at all: 300 seconds, then 60 until the next attempt
    assert own("c") == [(1000, "run", 1), (1360, "run", 2), (1720, "run", 3), (2020, "dead", 3)]
    assert [r["detail"] for d in ("c", "d", "e") for r in out if r.get("delivery_id") == d and r["step"] == "dead"] == ["no answer", "unknown event null", "unknown event ping"]
    assert sum(r.get("delivery_id") is None and r.get("detail") == "no delivery_id" for r in out) == 2
