"""Jaccard join of texts' word n-grams as a join in a metric space (op 13).

``1 - Jaccard`` is a metric on sets, and so is the size of the symmetric difference. Texts link at a similarity of ``up / down``
or more; what is returned is exact: the components of all such links.

1. Regions. Nearly all texts are at distance 1 from any pivot, so pivots can't cut the space of whole texts. Its projections can be
   cut: the hashes of a set form a binary tree (by their leading bits), and if a pair is similar at a node, then it is similar at
   one of the node's children, as one of two ratios is at least that of their sums. Follow such a path to where
   the two have ``most`` elements or fewer in all: there a single differing element would break the threshold, so they are equal. The distinct
   projections of so few elements are pivots with Voronoi regions of radius 0; a text lies in about n / 6 of them, at 9/10. Nodes
   whose parent is at the boundary (one element fewer could have stopped there) are taken as well, so each linked pair has a region in common.
2. Pivots. The texts of a region, or of several with the same first text, go to that text as their pivot p: exact distances to it, links if
   near. Large regions that share texts are merged around one pivot. Two texts x, y of one pivot that link, and don't both link to it, must differ from p in a common element: else |x - y| would be
   |x - p| + |y - p|, by the triangle inequality no less than one of them, so both would be near p. So texts are moved: from here on a text is its
   difference from its pivot, which is short, and without what a family of texts has in common.
3. Recursion. A region whose texts are known to be in one component is done. One of ``SMALL`` texts and ``BYTES`` at most is
   joined at once, by products of incidence matrices. A larger one is cut by elements of the differences: by the triangle inequality a partner differs
   from p by no less than |x - p| less what a link allows, so the two share so many elements that the first few of each, in one order
   (what p lacks first, as it is rare), have one in common. Each part gets a pivot of its own, and so on; each step
   takes at least the pivot away.

No pairs are listed: a region returns links to one text of each component that it found.

Defined cases: letters A to Z are lower-cased, words are cut at ASCII white space; a text with fewer words than the n-gram has one
n-gram, the whole sequence; null texts and those without words have no n-grams and link with nothing, each its own component; equal sets are one, so
copies, repeated rows and ties link; a null id is never the smallest of a component unless all are null; very long texts are hashed
in lots of a few MB, one text at least; other columns are ignored; an empty table gives no rows. N-grams are told apart by 63 bits of their XXH64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, few, importable, keyed, lots, on_key
from .simhash_dedup import contract

WIDTH, UP, DOWN = 3, 9, 10
#: Texts and bytes of differences of a region that one task joins at once.
SMALL, BYTES = 2048, 8 << 20
#: Bytes of text hashed at once.
LOT = 4 << 20
#: Elements (columns of an incidence matrix) multiplied at once.
COLUMNS = 1024
#: Texts of a large region, about, that tell which elements are frequent in it, and how many such elements are put last.
SAMPLE, FREQUENT = 256, 512
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def ngrams(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the ``width``-word n-grams."""
    import xxhash

    w = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not w:
        return np.zeros(0, dtype=np.uint64)
    runs = map(b" ".join, zip(*[w[i:] for i in range(width)], strict=False)) if len(w) >= width else [b" ".join(w)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 7) for s in runs), dtype=np.uint64) >> np.uint64(1))


def most(up: int, down: int) -> int:
    """The largest union of two sets whose similarity can't be ``up / down`` unless they are equal."""
    return -(-down // (down - up)) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[0]
    return (x ^ (x >> np.uint64(29))) * _ODD[1]


def projections(sets: list[np.ndarray], up: int, down: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the set, value of a projection) for all sets' regions, by set."""
    size = most(up, down)
    again = -(-up * (size + 1) // down)  # so many elements can have a partner with which there are more than ``size``
    flat, own = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    held = np.repeat([len(s) >= again for s in sets], [len(s) for s in sets])
    flat, own = flat[held.astype(bool)], own[held.astype(bool)]
    mixed, of, values, depth = _mixed(flat), [], [], 0
    while len(flat) and depth < 63:
        depth += 1
        node = flat >> np.uint64(63 - depth)
        first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (own[1:] != own[:-1])]))
        count = np.diff(np.append(first, len(flat)))
        here = count <= size
        total = np.add.reduceat(mixed, first)[here] + node[first][here] * _ODD[2] + np.uint64(depth * int(_ODD[0]) % (1 << 64))
        of.append(own[first][here])
        values.append(_mixed(total))
        on = np.repeat(count >= again, count)
        flat, own, mixed = flat[on], own[on], mixed[on]
    of, values = np.concatenate([*of, np.zeros(0, dtype=np.int64)]), np.concatenate([*values, np.zeros(0, dtype=np.uint64)])
    order = np.argsort(of, kind="stable")
    return of[order], values[order]


def described(sets: list[np.ndarray], up: int, down: int) -> dict[str, pa.Array]:
    """node (a hash of the set), n (its size), regions (values of its projections)."""
    import xxhash

    of, values = projections(sets, up, down)
    ends = np.searchsorted(of, np.arange(len(sets) + 1)).astype(np.int32)
    return {
        "node": pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)),
        "n": pa.array([len(s) for s in sets], pa.int64()),
        "regions": pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64))),
    }


def signatures(docs: DataFrame, width: int, up: int, down: int) -> DataFrame:
    """doc_id, text_key, and what ``described`` says of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in lots(batch, LOT):
                sets = [ngrams(t, width) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text_key": b.column("text_key")} | described(sets, up, down))

    return _texts(docs, "doc_id", "text_key").mapInArrow(run, "doc_id long, text_key long, node long, n long, regions array<long>")


def _texts(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*columns, F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, n, d (the set, as bytes) of the nodes in ``wanted``; ``nodes`` has doc_id and text_key of one text of each."""
    at = few(cut(nodes.join(wanted, "node", "left_semi").select("node", "doc_id", "text_key"), "jaccard-wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in lots(batch, LOT):
                sets = [ngrams(t, width) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"node": b.column("node"), "n": pa.array([len(s) for s in sets], pa.int64()), "d": pa.array([s.tobytes() for s in sets], pa.binary())})

    d = docs.join(at, on_key(docs, at)).select("node", "text")
    return _texts(d, "node").mapInArrow(run, "node long, n long, d binary").dropDuplicates(["node"])


def similar(n: int, m: int, gap: int, up: int, down: int) -> bool:
    """Whether sets of ``n`` and ``m`` elements that differ in ``gap`` elements link."""
    both = (n + m - gap) // 2
    return down * both >= up * (n + m - both)


def _moved(rows: DataFrame, up: int, down: int) -> DataFrame:
    """``rows`` (region, node, n, d, root, lone, pivot, pivot_n, pivot_d, pivot_root) with d as the difference from the pivot,
    linked, and the root as far as it is known: texts of one root are in one component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            moved, linked = [], []
            for n, d, lone, m, p in zip(*[b.column(c).to_pylist() for c in ("n", "d", "lone", "pivot_n", "pivot_d")], strict=True):
                gap = np.setxor1d(np.frombuffer(d, dtype=np.uint64), np.frombuffer(p, dtype=np.uint64), assume_unique=True)
                linked.append(similar(n, m, len(gap), up, down))
                moved.append(b"" if lone else gap.tobytes())
            near = pa.array(linked, pa.bool_())
            root = pc.if_else(near, b.column("pivot_root"), b.column("root"))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("region", "node", "n", "pivot")], root, pa.array(moved, pa.binary()), near], ["region", "node", "n", "pivot", "root", "d", "linked"])

    columns = ["region", "node", "n", "d", "root", "lone", "pivot", "pivot_n", "pivot_d", "pivot_root"]
    return rows.select(*columns).mapInArrow(run, "region long, node long, n long, pivot long, root long, d binary, linked boolean")


def joined(nodes: np.ndarray, n: np.ndarray, d: list[np.ndarray], up: int, down: int) -> list[tuple[int, int]]:
    """(first, other): each text with the first of its component within this region."""
    flat, own = np.concatenate(d), np.repeat(np.arange(len(d)), [len(x) for x in d])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, own = np.unique(column[shared], return_inverse=True)[1], own[shared]
    common = np.zeros((len(d), len(d)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    column, own = column[order], own[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(d), COLUMNS), dtype=np.float32)
        part[own[low:high], column[low:high] - at] = 1
        common += part @ part.T
    size = np.array([len(x) for x in d])
    left, found = np.ones(len(d), dtype=bool), []
    for first in range(len(d)):
        if not left[first]:
            continue
        left[first], front = False, [first]
        while front:
            k = front.pop()
            gap = size[k] + size - 2 * common[k].astype(np.int64)
            both = (n[k] + n - gap) // 2
            near = np.flatnonzero(left & (down * both >= up * (n[k] + n - both)))
            left[near] = False
            front.extend(near.tolist())
            found.extend((int(nodes[first]), int(nodes[x])) for x in near)
    return found


def _direct(members: DataFrame, up: int, down: int) -> DataFrame:
    """a, b: links that connect each of these regions as its similar pairs do."""
    groups = members.groupBy("region").agg(F.collect_list(F.struct("node", "n", "d")).alias("m")).select("m.node", "m.n", "m.d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for nodes, n, d in zip(*[b.column(c) for c in ("node", "n", "d")], strict=True):
                found += joined(np.asarray(nodes.values), np.asarray(n.values), [np.frombuffer(x, dtype=np.uint64) for x in d.as_py()], up, down)
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return groups.mapInArrow(run, "a long, b long")


def _frequent(members: DataFrame) -> DataFrame:
    """region, often (elements that several of about SAMPLE of its texts have, as bytes), times (how many)."""
    some = members.where(F.pmod(F.xxhash64("node", "region"), F.ceil(F.col("members") / SAMPLE)) == 0).groupBy("region").agg(F.collect_list("d").alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            often, times = [], []
            for d in b.column("d").to_pylist():
                value, count = np.unique(np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in d]), return_counts=True)
                top = np.sort(np.argsort(-count, kind="stable")[: min(FREQUENT, int((count > 1).sum()))])
                often.append(value[top].tobytes())
                times.append(count[top].astype(np.int64).tobytes())
            yield pa.RecordBatch.from_pydict({"region": b.column("region"), "often": pa.array(often, pa.binary()), "times": pa.array(times, pa.binary())})

    return some.mapInArrow(run, "region long, often binary, times binary")


def _parts(members: DataFrame, up: int, down: int) -> DataFrame:
    """region, node, root, part: the parts of large regions that a text belongs to, by the first elements of its difference."""

    def first(d: bytes, often: bytes | None, times: bytes | None, n: int) -> np.ndarray:
        d, often = np.frombuffer(d, dtype=np.uint64), np.frombuffer(often or b"", dtype=np.uint64)
        count = np.zeros(len(d), dtype=np.int64)
        if len(often):
            at = np.minimum(np.searchsorted(often, d), len(often) - 1)
            count = np.where(often[at] == d, np.frombuffer(times, dtype=np.int64)[at], 0)
        return d[np.lexsort((_mixed(d), count))[: n * (down - up) // up + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [first(*x) for x in zip(*[b.column(c).to_pylist() for c in ("d", "often", "times", "n")], strict=True)]
            at = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
            region = np.asarray(b.column("region")).view(np.uint64)[at]
            part = _mixed(np.concatenate([*found, np.zeros(0, dtype=np.uint64)]) + region * _ODD[2])
            yield pa.RecordBatch.from_pydict({c: b.column(c).take(pa.array(at)) for c in ("region", "node", "root")} | {"part": pa.array(part.view(np.int64))})

    rows = members.join(_frequent(members), "region", "left")
    return rows.select("region", "node", "root", "n", "d", "often", "times").mapInArrow(run, "region long, node long, root long, part long")


def pivots(nodes: DataFrame) -> DataFrame:
    """region, node: each text of ``nodes`` (node, regions) with the first texts of its regions, by one order for all."""
    rows = nodes.select("node", F.explode("regions").alias("value"))
    first = rows.groupBy("value").agg(F.count("*").alias("members"), F.min("node").alias("region")).where("members > 1")
    return rows.join(first, "value").where("node <> region").select("region", "node").distinct()


def links(pairs: DataFrame, sets: DataFrame, up: int, down: int, given: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """a, b: links that connect texts exactly as all similar pairs within a region do. ``pairs``: what ``pivots`` returns;
    ``sets``: their node, n, d; ``given``: links that are known already, kept in the result."""
    of = lambda df, **names: df.select(*[F.col(c).alias(names.get(c, c)) for c in ("node", "n", "d")])

    def moved(pairs: DataFrame) -> DataFrame:
        alone = pairs.groupBy("region").agg((F.count("*") == 1).alias("lone"))
        rows = pairs.join(of(sets), "node").join(alone, "region").join(of(sets, node="region", n="pivot_n", d="pivot_d"), "region")
        return cut(_moved(rows.withColumns({"pivot": F.col("region"), "root": F.col("node"), "pivot_root": F.col("region")}), up, down), "jaccard-moved")

    def ends(m: DataFrame) -> DataFrame:
        return m.where("linked").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))

    def is_small(members: str, length: str) -> Column:
        return (F.col(members) <= (small or SMALL)) & (F.col(length) <= BYTES)

    members = moved(pairs)
    found = ends(members) if given is None else ends(members).union(given.select("a", "b"))
    sizes = cut(members.groupBy("region").agg(F.count("*").alias("members"), F.sum(F.length("d")).alias("bytes")).where(~is_small("members", "bytes")), "jaccard-large")
    if not sizes.isEmpty():
        # large regions that share texts become one, so that a text is in one of them only: the pivot of the largest serves all
        own = members.join(sizes, "region", "left_semi").select("region", "node")
        root = contract(own.select(F.col("region").alias("a"), F.col("node").alias("b")))
        root = cut(root.select(F.col("node").alias("of"), F.col("root").alias("group")).union(root.select(F.col("root"), F.col("root")).distinct()), "jaccard-groups")
        pivot = sizes.join(root, sizes["region"] == root["of"]).groupBy("group").agg(F.max(F.struct("members", "region"))["region"].alias("region"))
        merged = moved(root.join(pivot, "group").select("region", F.col("of").alias("node")).where("region <> node"))
        found = found.union(ends(merged))
        members = members.join(sizes, "region", "left_anti").select(*merged.columns).union(merged)
    while True:
        m = members.where("d <> X''").select("region", "node", "n", "d", "root")
        sizes = m.groupBy("region").agg(F.count("*").alias("members"), F.sum(F.length("d")).alias("bytes"), F.min("root").alias("low"), F.max("root").alias("high"))
        rest = cut(m.join(sizes.where("low < high").select("region", "members", "bytes"), "region"), "jaccard-rest")
        at_once = is_small("members", "bytes")
        found = found.union(cut(_direct(rest.where(at_once), up, down), "jaccard-links"))
        large = rest.where(~at_once).drop("bytes")
        if large.isEmpty():
            return found
        # equal differences to a pivot are no two sets, so each part loses its pivot, and only that can be without a difference
        parts = cut(_parts(large, up, down), "jaccard-parts")
        first = parts.groupBy("part").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("node", "region", "root")).alias("f"))
        first = cut(first.where("low < high").select("part", (F.col("c") == 2).alias("lone"), F.col("f.node").alias("pivot"), F.col("f.region").alias("region"), F.col("f.root").alias("pivot_root")), "jaccard-pivots")
        pivot = first.join(large.select("region", F.col("node").alias("pivot"), F.col("n").alias("pivot_n"), F.col("d").alias("pivot_d")), ["region", "pivot"]).drop("region")
        own = parts.join(first.select("part"), "part").join(large.select("region", "node", "n", "d"), ["region", "node"]).drop("region")
        rows = own.join(pivot, "part").where("node <> pivot").withColumnRenamed("part", "region")
        members = cut(_moved(rows, up, down), "jaccard-moved")
        found = found.union(ends(members))


def components(docs: DataFrame, width: int = WIDTH, up: int = UP, down: int = DOWN, small: int | None = None) -> DataFrame:
    """doc_id, n_shingles (distinct n-grams), component_id (the smallest doc_id reachable by links)."""
    importable(docs.sparkSession)
    d = keyed(docs.select(F.col("doc_id").cast("long"), "text"))
    signed = cut(signatures(d, width, up, down), "jaccard-signatures")
    one = signed.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("regions").alias("regions"))
    nodes = cut(one.select("node", "at.*", "regions"), "jaccard-nodes")
    pairs = cut(pivots(nodes), "jaccard-regions")
    wanted = pairs.select("region").union(pairs.select("node")).distinct().withColumnRenamed("region", "node")
    sets = cut(sets_of(d, nodes, wanted, width), "jaccard-sets")
    roots = contract(links(pairs, sets, up, down, small=small))
    root = F.when(F.col("n") > 0, F.coalesce("root", "node"))
    placed = cut(signed.select("doc_id", "n", "node").join(roots, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), root.alias("root")), "jaccard-roots")
    least = placed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    some = placed.where("root IS NOT NULL").join(least, "root").select("doc_id", "n_shingles", "component_id")
    return some.union(placed.where("root IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
