"""Results of requests, kept for a while: by a hash of the request and the version of the graph it was answered from.

A result is a folder of its repository; its entry, with the time until which it counts, is written after its rows. A new graph
version has other keys, so nothing old is ever answered; what has expired is deleted when it is met.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .adjacency import _fs, exists

#: Seconds that a result counts.
TTL = 300
ENTRY = "until double, data string, schema string"


def request_key(request: dict, version: str) -> str:
    """A hash that doesn't depend on the order of fields, nor of ``entry_points``."""
    own = request | {"entry_points": sorted(request.get("entry_points") or []), "graph_version": version}
    return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()[:32]


class ResultCache:
    """``clock`` gives the time in seconds."""

    def __init__(self, spark: SparkSession, root: str, ttl: float = TTL, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.ttl, self.clock = spark, root.rstrip("/"), ttl, clock

    def _folder(self, request: dict, version: str) -> str:
        repo = hashlib.sha256(str(request["repo_id"]).encode()).hexdigest()[:16]  # a name may hold any character
        return f"{self.root}/{repo}/{request_key(request, version)}"

    def _delete(self, path: str) -> bool:
        fs, p = _fs(self.spark, path)
        return fs.delete(p, True)

    def get(self, request: dict, version: str) -> DataFrame | None:
        """The rows of an equal request to the same graph version, if they are there and still count."""
        at = self._folder(request, version)
        if not exists(self.spark, f"{at}/entry/_SUCCESS"):
            return None
        entry = self.spark.read.schema(ENTRY).json(f"{at}/entry").orderBy("until").tail(1)[0]
        if entry.until <= self.clock():
            self._delete(at)
            return None
        return self.spark.read.schema(entry.schema).parquet(f"{at}/{entry.data}")

    def put(self, request: dict, version: str, rows: DataFrame) -> DataFrame:
        at, data = self._folder(request, version), f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{at}/{data}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self.spark.createDataFrame([(float(self.clock() + self.ttl), data, schema)], ENTRY).coalesce(1).write.mode("append").json(f"{at}/entry")
        return self.spark.read.schema(rows.schema).parquet(f"{at}/{data}")

    def get_or_run(self, request: dict, version: str, run: Callable[[], DataFrame]) -> DataFrame:
        found = self.get(request, version)
        return self.put(request, version, run()) if found is None else found

    def invalidate(self, repo_id: str) -> bool:
        """Forget all results of a repository; whether there were any."""
        return self._delete(f"{self.root}/{hashlib.sha256(str(repo_id).encode()).hexdigest()[:16]}")
