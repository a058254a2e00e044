"""Keeping graph and vectors in step with change streams, and snapshots of them."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import dealt

from .diff import upsert
from .lookup import first_nodes


class Conflict(RuntimeError):
    """Other writers were faster, each time."""


class Table:
    """A keyed table in a folder of versions: a write makes a new version, readers follow the newest.

    Parquet has no MERGE; a merge is an anti-join with the new rows, a union, and a new version. A version counts once its entry is in
    the log, ``versions/<n>.json``. An entry is put only if there is none of that number; whoever comes second
    reads again, and makes its change on top of the other's. So no write is lost, and a lost job leaves no half version to read."""

    TRIES = 10

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _at(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _numbers(self) -> list[int]:
        fs, p = self._at(f"{self.path}/versions")
        if not fs.exists(p):
            return []
        return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(p) if re.fullmatch(r"\d+\.json", f.getPath().getName()))

    def _entry(self, n: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/versions/{n:020d}.json").first().value)

    def _put(self, n: int, entry: dict) -> bool:
        """Whether entry ``n`` is now this one; False if there was one."""
        fs, p = self._at(f"{self.path}/versions/{n:020d}.json")
        fs.mkdirs(p.getParent())
        text = json.dumps(entry) + "\n"
        if fs.getScheme() == "file":  # Hadoop's local files have no create that fails; a link has
            whole = f"{p.getParent().toUri().getPath()}/.{uuid.uuid4().hex}"
            with open(whole, "w") as f:
                f.write(text)
            try:
                os.link(whole, p.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(whole)
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _table(self, n: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._entry(n)['version']}")

    def read(self, n: int | None = None) -> DataFrame | None:
        """The newest version, or version ``n``."""
        numbers = self._numbers()
        return self._table(numbers[-1] if n is None else n) if numbers else None

    def commit(self, change: Callable[[DataFrame | None], DataFrame | None]) -> int | None:
        """Make ``change`` of the newest version a new one, as often as it takes to be the first after it; its number. None for no
        change leaves all as it is."""
        for _ in range(self.TRIES):
            numbers = self._numbers()
            last = numbers[-1] if numbers else 0
            new = change(self._table(last) if numbers else None)
            if new is None:
                return None
            version = uuid.uuid4().hex
            new.write.parquet(f"{self.path}/{version}")
            if self._put(last + 1, {"n": last + 1, "version": version}):
                return last + 1
            fs, p = self._at(f"{self.path}/{version}")
            fs.delete(p, True)
        raise Conflict(f"{self.path}: {self.TRIES} times another writer came first")

    def write(self, df: DataFrame) -> None:
        self.commit(lambda _: df)

    def merge(self, new: DataFrame) -> None:
        def change(base: DataFrame | None) -> DataFrame:
            if base is not None:
                return upsert(base, new, self.keys)
            rest = [c for c in new.columns if c not in (*self.keys, "ord")]
            return new.groupBy(*self.keys).agg(F.max(F.struct("ord", *rest)).alias("n")).select(*self.keys, "n.*") if "ord" in new.columns else new

        self.commit(change)

    def delete(self, gone: DataFrame) -> int:
        """Rows deleted: those whose columns equal some row of ``gone``."""
        n = 0

        def change(base: DataFrame | None) -> DataFrame | None:
            nonlocal n
            n = 0 if base is None else base.join(gone, gone.columns, "left_semi").count()
            return base.join(gone, gone.columns, "left_anti") if n else None

        self.commit(change)
        return n

    def replace(self, column: str, rows: DataFrame) -> None:
        """All rows whose ``column`` has a value that ``rows`` has go, ``rows`` come: a graph by its id, for one."""

        def change(base: DataFrame | None) -> DataFrame:
            return rows if base is None else base.join(rows.select(column).distinct(), column, "left_anti").select(*base.columns).unionByName(rows, allowMissingColumns=True)

        self.commit(change)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the data of all but the newest ``keep`` versions, which readers may still follow; how many went."""
        old = self._numbers()[:-keep]
        gone = 0
        for n in old:
            for path in (f"{self.path}/{self._entry(n)['version']}", f"{self.path}/versions/{n:020d}.json"):
                fs, p = self._at(path)
                gone += fs.delete(p, True)
        return gone // 2


def touching(edges: DataFrame, node: str, outgoing_only: bool = False) -> DataFrame:
    """Edges to delete with a node."""
    return edges.where((F.col("source") == node) | (F.lit(not outgoing_only) & (F.col("target") == node)))


def without_touching(edges: DataFrame, node: str, outgoing_only: bool = False) -> tuple[DataFrame, int]:
    """The edges that stay when a node goes, and how many go."""
    gone = touching(edges, node, outgoing_only)
    stay = edges.where(~F.coalesce((F.col("source") == node) | (F.lit(not outgoing_only) & (F.col("target") == node)), F.lit(False)))
    return stay, gone.count()


def with_placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` and an ``external`` node for each edge target that is none."""
    missing = edges.select(F.col("target").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(missing.select("id", F.lit("external").alias("type"), F.col("id").alias("name")), allowMissingColumns=True)


def apply_changes(nodes: DataFrame, edges: DataFrame, changes: DataFrame, new_nodes: DataFrame, new_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after ``changes`` (path, change_type, old_path): what lived in a changed, deleted or renamed path
    goes, what was parsed from the new state comes; other files' edges into paths that still exist stay."""
    gone = changes.select(F.explode(F.array_compact(F.array("path", "old_path"))).alias("path")).distinct()
    kept = nodes.join(gone, "path", "left_anti")
    lost = nodes.join(gone, "path", "left_semi").select(F.col("id").alias("source")).distinct()
    after = kept.unionByName(new_nodes, allowMissingColumns=True)
    e = edges.join(lost, "source", "left_anti").unionByName(new_edges, allowMissingColumns=True)
    return after, e.join(after.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select(*edges.columns)


def change_counts(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: files by kind, nodes deleted and added."""
    c = changes.agg(*[F.count_if(F.col("change_type") == k).alias(f"files_{k}") for k in ("added", "modified", "deleted", "renamed")])
    a = before.select("id").exceptAll(after.select("id")).agg(F.count("*").alias("nodes_deleted"))
    b = after.select("id").exceptAll(before.select("id")).agg(F.count("*").alias("nodes_added"))
    return c.join(a, how="cross").join(b, how="cross")  # three one-row frames


def edge_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: added, removed and kept edges as sets of (source, target, type)."""
    key = ["source", "target", "type"]
    sides = old.select(*key, F.lit(1).alias("s")).union(new.select(*key, F.lit(2)))
    s = dealt(sides, sides.count(), *key).groupBy(*key).agg(F.bit_or("s").alias("s"))
    return s.agg(F.count_if(F.col("s") == 2).alias("added"), F.count_if(F.col("s") == 1).alias("removed"), F.count_if(F.col("s") == 3).alias("kept"))


def sync_vectors(chunks: DataFrame, changed_paths: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Chunks of changed paths go, the newly embedded ones come."""
    return chunks.join(changed_paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti").unionByName(new_chunks, allowMissingColumns=True)


def write_snapshot(nodes: DataFrame, edges: DataFrame, root: str, repo_id: str, sha: str) -> None:
    """Parts first, the header last: a snapshot without header doesn't exist. Writing it again deletes the old one first."""
    spark, at = nodes.sparkSession, f"repo_id={repo_id}/sha={sha}"
    delete_snapshot(spark, root, repo_id, sha)
    nodes.write.mode("overwrite").parquet(f"{root}/nodes/{at}")
    edges.write.mode("overwrite").parquet(f"{root}/edges/{at}")
    spark.createDataFrame([(nodes.count(), edges.count())], "n_nodes long, n_edges long").withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{root}/headers/{at}")


def list_snapshots(spark: SparkSession, root: str, repo_id: str | None = None) -> DataFrame:
    """Headers, newest first."""
    h = spark.read.parquet(f"{root}/headers")
    return (h.where(F.col("repo_id") == repo_id) if repo_id else h).orderBy(F.desc("created_at"), "repo_id", "sha")


def delete_snapshot(spark: SparkSession, root: str, repo_id: str, sha: str) -> bool:
    """Whether there was one. The header goes first: from then on the snapshot doesn't exist."""
    found = False
    for part in ("headers", "nodes", "edges"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{part}/repo_id={repo_id}/sha={sha}")
        gone = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        found |= gone and part == "headers"
    return found


def read_snapshot(spark: SparkSession, root: str, repo_id: str, sha: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; partition filters prune to the one snapshot."""
    own = (F.col("repo_id") == repo_id) & (F.col("sha") == sha)
    return spark.read.parquet(f"{root}/nodes").where(own), spark.read.parquet(f"{root}/edges").where(own)


def migrate(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both resolve, to the first node of each id."""
    f = first_nodes(nodes.select("id", "ord"))
    return edges.join(f.select(F.col("id").alias("source"), F.col("ord").alias("source_ord")), "source").join(f.select(F.col("id").alias("target"), F.col("ord").alias("target_ord")), "target")


def replace_services(base: DataFrame, saved: DataFrame) -> DataFrame:
    """``base`` after ``saved`` (with ``ord``) was saved row by row: service_id and repo_id are unique, and a row replaces
    whatever had either. So a row stays if no later one has its service_id or its repo_id, gone or not."""
    rows = base.withColumn("ord", F.lit(None).cast("long")).unionByName(saved, allowMissingColumns=True)
    rows = rows.withColumn("ord", F.coalesce("ord", F.lit(-1)))
    kept = rows
    for key in ("service_id", "repo_id"):
        kept = kept.join(rows.groupBy(key).agg(F.max("ord").alias("ord")), [key, "ord"], "left_semi")
    return kept.select(*base.columns)


class Services:
    """The registry of services (service_id, name, repo_id, description), in a folder of versions."""

    COLUMNS = "service_id string, name string, repo_id string, description string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, Table(spark, path, ["service_id"])

    def list(self) -> DataFrame:
        found = self.table.read()
        return (self.spark.createDataFrame([], self.COLUMNS) if found is None else found).orderBy("name", "service_id")

    def save(self, rows: DataFrame) -> None:
        """``rows`` in the order of ``ord``."""
        self.table.commit(lambda base: replace_services(self.list() if base is None else base, rows))

    def by_id(self, service_id: str) -> DataFrame:
        return self.list().where(F.col("service_id") == service_id)

    def by_repo(self, repo_id: str) -> DataFrame:
        return self.list().where(F.col("repo_id") == repo_id)

    def update(self, service_id: str, **values: str | None) -> bool:
        """Set the name or description given; whether there was such a service."""
        if self.by_id(service_id).isEmpty():
            return False
        own = F.col("service_id") == service_id
        self.table.write(self.list().withColumns({c: F.when(own, F.lit(values[c])).otherwise(F.col(c)) for c in ("name", "description") if values.get(c) is not None}))
        return True

    def delete(self, service_id: str) -> bool:
        if self.by_id(service_id).isEmpty():
            return False
        self.table.write(self.list().where(F.col("service_id") != service_id))
        return True


STATES = ("pending", "syncing", "synced", "error", "stale")


def latest_status(updates: DataFrame) -> DataFrame:
    """The last full row of each repository by ``ord``: columns an update leaves out fall to their defaults."""
    rest = [c for c in updates.columns if c not in ("repo_id", "ord")]
    last = updates.groupBy("repo_id").agg(F.max_by(F.struct(*rest), "ord").alias("n")).select("repo_id", "n.*")
    return last.na.fill({"state": "pending", "retry_count": 0, "commits_behind": 0})
