"""Density clusters (HDBSCAN) of groups of any size.

Exact, in blocks. Each pair of blocks meets once, in tiles, for every vector's list of its nearest others, which also has its core
distance; equal vectors are searched once. The lists' edges go by length through a union-find. An edge is sure if it is shorter
than all that the lists of one of its sides leave out: nothing that wasn't listed can replace it. The rest is left to Boruvka
rounds, in which only those vectors of a component meet all others whose lists end before the component's best listed edge, and the
largest component waits. Products tell which distances can count (in single precision first); those are worked out exactly.
Edges are ordered by (length, smaller id, larger id), so the tree is the only one. The time grows with the square of a group, a
task's memory with ``SIDE`` blocks. Only the tree (24 bytes an edge) and the ids of a group meet in one task, which sorts and
condenses it; the listed edges are sorted by Spark and pass through one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut

#: Vectors of a block: two blocks' products are a matrix of 4 MB. Blocks of a side of a tile, at most; bands of blocks of a group, at
#: least, where it has so many blocks; partitions of tiles, at most; others that a vector's list holds, at least.
BLOCK, SIDE, BANDS, TILES, LISTED = 1000, 32, 12, 2000, 16


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean, summed up dimension by dimension: the same to the last bit whatever the blocks."""
    out = np.zeros((len(x), len(y)))
    for d in range(x.shape[1] if x.ndim > 1 else 0):
        gap = x[:, d, None] - y[None, :, d]
        out += gap * gap
    return np.sqrt(out)


def of_pairs(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same distances, to the last bit, of single pairs of rows."""
    out = np.zeros(len(i))
    for at in range(0, len(i), 4096):
        gap, some = x[i[at : at + 4096]] - y[j[at : at + 4096]], out[at : at + 4096]
        gap *= gap
        for d in range(x.shape[1]):
            some += gap[:, d]
    return np.sqrt(out)


def about(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a matrix product, and for each row of ``x`` a bound of their error, and of the exact ones'."""
    sx, sy = (np.einsum("ij,ij->i", v, v) for v in (x, y))
    square = x @ y.T
    square *= -2
    square += sx[:, None]
    square += sy[None, :]
    return square, 8 * (x.shape[1] + 8) * np.finfo(float).eps * (sx + sy.max())


def euclidean(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances by a matrix product; those that it can't tell well, of nearly equal vectors, are worked out one by one."""
    square, error = about(x, y)
    if not np.isfinite(error).all():
        return distances(x, y)
    i, j = np.nonzero(square <= 1e4 * error[:, None])
    if len(i) > square.size // 8:
        return distances(x, y)
    np.maximum(square, 0, out=square)
    far = np.sqrt(square, out=square)
    far[i, j] = of_pairs(x, y, i, j)
    return far


def _candidates(square: np.ndarray, limit: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``square`` that may be within ``limit`` (by row, squared) if both are off by ``error``."""
    limit = np.where(np.isfinite(limit), limit * (1 + 1e-13) + 2 * error, -1.0)
    return np.nonzero(square <= limit[:, None])


def condensed(n: int, tree: list[tuple[float, int, int]], min_cluster_size: int) -> np.ndarray:
    """Cluster of each of ``n`` points, -1 for noise: the tree (ascending) condensed by ``min_cluster_size``, clusters by excess of mass."""
    if n < 2 * min_cluster_size:
        return np.full(n, -1)
    # single linkage, children of merge i are node n + i
    parent, kids, size, height = list(range(2 * n - 1)), {}, [1] * n, {}

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for d, a, b in tree:
        ra, rb, new = find(a), find(b), len(size)
        kids[new], height[new] = (ra, rb), d
        size.append(size[ra] + size[rb])
        parent[ra] = parent[rb] = new
    # condense
    stability, children, top = {0: 0.0}, {0: []}, {0: 2 * n - 2}
    stack, count = [(2 * n - 2, 0, 0.0)], 1  # node, its cluster, birth
    while stack:
        node, c, birth = stack.pop()
        while node >= n:
            lam = 1 / max(height[node], 1e-12)
            big = [k for k in kids[node] if size[k] >= min_cluster_size]
            stability[c] += (lam - birth) * sum(size[k] for k in kids[node] if size[k] < min_cluster_size)
            if len(big) == 2:
                stability[c] += (lam - birth) * size[node]
                for k in big:
                    stability[count], children[count], top[count] = 0.0, [], k
                    children[c].append(count)
                    stack.append((k, count, lam))
                    count += 1
                break
            if not big:
                break
            node = big[0]
    chosen: dict[int, bool] = {}
    for c in range(count - 1, 0, -1):
        below = sum(stability[k] for k in children[c])
        chosen[c] = not children[c] or stability[c] >= below
        stability[c] = max(stability[c], below)
    out, k, todo, at = np.full(n, -1), 0, list(children[0]), 0
    while at < len(todo):
        c = todo[at]
        at += 1
        if chosen[c]:
            nodes = [top[c]]
            while nodes:
                v = nodes.pop()
                if v < n:
                    out[v] = k
                else:
                    nodes += kids[v]
            k += 1
        else:
            todo += children[c]
    return out


def density_labels(x: np.ndarray, min_cluster_size: int = 5) -> np.ndarray:
    """Clusters of a small group, by all distances at once."""
    n = len(x)
    if n < 2 * min_cluster_size:
        return np.full(n, -1)
    dist = distances(x, x)
    core = np.sort(dist, axis=1)[:, min_cluster_size - 1]
    reach = np.maximum(dist, np.maximum(core[:, None], core[None, :]))
    inside, near, link, every = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), np.arange(n)
    tree, at = [], 0
    for _ in range(n - 1):
        inside[at] = True
        low, high = np.minimum(link, every), np.maximum(link, every)
        first = (np.minimum(at, every) < low) | ((np.minimum(at, every) == low) & (np.maximum(at, every) < high))
        closer = ~inside & ((reach[at] < near) | ((reach[at] == near) & first))
        near[closer], link[closer] = reach[at][closer], at
        best = np.flatnonzero(~inside & (near == near[~inside].min()))
        at = int(min(best, key=lambda v: (min(v, link[v]), max(v, link[v]))))
        tree.append((near[at], min(at, int(link[at])), max(at, int(link[at]))))
    return condensed(n, sorted(tree), min_cluster_size)


# --- blocks ---


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with an id that ascends in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32  # ids stay below 2^53
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + b.num_rows))], [*b.schema.names, "id"])
            at += b.num_rows

    return rows.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in rows.dtypes) + ", id long")


def _blocks(rows: DataFrame, size: int, *columns: str) -> DataFrame:
    """g, block (its first id), ``columns`` as arrays, x (packed), band, bands of rows (g, id, x, columns) in order of g: a group's
    blocks are in bands of ``SIDE`` at most."""
    kinds = dict(rows.dtypes)
    packed = "<f4" if kinds["x"] == "array<float>" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, first = b.column("g").to_pylist(), 0
            for k in range(1, len(g) + 1):
                if k == len(g) or g[k] != g[first] or k - first == size:
                    part = b.slice(first, k - first)
                    x = np.array(part.column("x").to_pylist(), dtype=packed)
                    own = {"g": part.column("g").slice(0, 1), "block": part.column("id").slice(0, 1)}
                    own |= {c: pa.array([part.column(c).to_pylist()], pa.list_(part.column(c).type)) for c in columns}
                    yield pa.RecordBatch.from_pydict(own | {"x": pa.array([x.tobytes()], pa.binary())})
                    first = k

    blocks = cut(rows.mapInArrow(run, f"g {kinds['g']}, block long, {', '.join(f'{c} array<{kinds[c]}>' for c in columns)}, x binary"), "density-blocks")
    each = blocks.select("g", "block", (F.row_number().over(Window.partitionBy("g").orderBy("block")) - 1).alias("at"), F.count("*").over(Window.partitionBy("g")).alias("n"))
    side = F.least(F.lit(SIDE), F.ceil(F.col("n") / BANDS))
    return blocks.join(each.select("block", F.floor(F.col("at") / side).cast("int").alias("band"), F.ceil(F.col("n") / side).cast("int").alias("bands")), "block")


def _tiles(blocks: DataFrame) -> int:
    """Partitions for the tiles of all groups."""
    n = blocks.select("g", "bands").distinct().agg(F.sum(F.col("bands") * (F.col("bands") + 1) / 2)).first()[0]
    return int(max(1, min(TILES, n or 0)))


def _matrix(x: bytes, n: int, packed: str) -> np.ndarray:
    return np.frombuffer(x, dtype=packed).reshape(n, -1).astype(float)


def _nearer(best: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``best`` (the least distances of each row so far, ascending) after rows of ``y`` have been met. A matrix product
    tells which distances can count, and only these are worked out."""
    k = best.shape[1]
    square, error = about(x, y)
    if np.isfinite(error).all():
        limit = best[:, -1] ** 2
        if len(y) >= k and not np.isfinite(limit).all():
            limit = np.minimum(limit, np.maximum(np.partition(square, k - 1, axis=1)[:, k - 1], 0))
        if np.isfinite(limit).all():
            i, j = _candidates(square, limit, error)
            if len(i) <= square.size // 8:
                far = of_pairs(x, y, i, j)
                order = np.lexsort((far, i))
                i, far = i[order], far[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                new = np.full_like(best, np.inf)
                new[i[rank < k], rank[rank < k]] = far[rank < k]
                return np.sort(np.concatenate([best, new], axis=1), axis=1)[:, :k]
    return np.sort(np.concatenate([best, distances(x, y)], axis=1), axis=1)[:, :k]


FOUND = np.dtype([("row", "<i4"), ("m", "<i4"), ("id", "<i8"), ("far", "<f8")])


def _first(found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` first of each row by (far, id), and their ranks."""
    found = found[np.lexsort((found["id"], found["far"], found["row"]))]
    rank = np.arange(len(found)) - np.searchsorted(found["row"], found["row"])
    return found[rank < k], rank[rank < k]


class _Side:
    """A block in a tile: its vectors, also as factors of products that are minus half of squared distances, and the ``k``
    nearest others of each, not beyond ``limit``, that it has met so far."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, x: np.ndarray, limit: np.ndarray, k: int) -> None:
        self.ids, self.m, self.x, self.limit, self.k = ids, m, x, limit.copy(), k
        self.square = np.einsum("ij,ij->i", x, x)
        half, one = -self.square[:, None] / 2, np.ones((len(x), 1))
        with np.errstate(over="ignore"):
            self.left, self.right = (np.concatenate(c, axis=1).astype(np.float32) for c in ((x, half, one), (x, one, half)))
        self.found, self.new = np.empty(0, FOUND), []

    def add(self, other: _Side, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> None:
        keep = np.flatnonzero((far <= self.limit[i]) & (self.ids[i] != other.ids[j]))
        new = np.empty(len(keep), FOUND)
        new["row"], new["m"], new["id"], new["far"] = i[keep], other.m[j[keep]], other.ids[j[keep]], far[keep]
        self.new.append(new)
        if sum(map(len, self.new)) > self.k * len(self.ids) or not np.isfinite(self.limit).all():
            self.fold()

    def fold(self) -> None:
        self.found, rank = _first(np.concatenate([self.found, *self.new]), self.k)
        self.new = []
        last = self.found[rank == self.k - 1]
        self.limit[last["row"]] = last["far"]

    def bound(self, p: np.ndarray, error: np.ndarray) -> np.ndarray:
        """What the products of rows that can count are at least."""
        square, none = self.limit**2, ~np.isfinite(self.limit)
        if none.any() and p.shape[1] > self.k:  # the vector itself may be among them
            square[none] = error[none] - 2 * np.partition(p[none], -self.k - 1, axis=1)[:, -self.k - 1].astype(float)
        return -(np.maximum(square, 0) * (1 + 1e-13) + error) / 2


def _places(may: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the few that are true, eight at a time."""
    flat = may.reshape(-1)
    if len(flat) % 8:
        at = np.flatnonzero(flat)
    else:
        some = np.flatnonzero(flat.view(np.uint64))
        eight, at = np.nonzero(flat.reshape(-1, 8)[some])
        at += some[eight] * 8
    return np.divmod(at, may.shape[1])


def _near(a: _Side, b: _Side, both: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows of ``a`` and ``b`` that may be within the limits of ``a``, or of one of ``both``, by products in single precision; None if these
    can't tell."""
    if a.square.max() + b.square.max() >= 1e36:
        return None
    eps = (a.x.shape[1] + 16) * float(np.finfo(np.float32).eps)
    p = a.left @ b.right.T
    may = p >= a.bound(p, eps * (a.square + b.square.max()) + 1e-36).astype(np.float32)[:, None]
    if both:
        may |= p >= b.bound(p.T, eps * (b.square + a.square.max()) + 1e-36).astype(np.float32)[None, :]
    return _places(may) if np.count_nonzero(may) <= may.size // 8 else None


def _meet(a: _Side, b: _Side) -> None:
    """Each of two blocks, or one with itself, meets the other's vectors."""
    near = _near(a, b, a is not b)
    if near is None:
        square, error = about(a.x, b.x)
        square -= 2 * error.max()
        may = square <= a.limit[:, None] ** 2 * (1 + 1e-13) if np.isfinite(error).all() else np.full(square.shape, True)
        may |= square <= b.limit[None, :] ** 2 * (1 + 1e-13)
        near = np.nonzero(may)
    i, j = near
    far = of_pairs(a.x, b.x, i, j) if len(i) <= len(a.ids) * len(b.ids) // 8 else distances(a.x, b.x)[i, j]
    a.add(b, i, j, far)
    if a is not b:
        b.add(a, j, i, far)


def _lists(blocks: DataFrame, k: int, listed: int, packed: str) -> DataFrame:
    """g, id, m, core (the distance to the ``k``-th nearest vector, itself included), to, far (the ``listed`` nearest others, by
    distance), bound (nothing else is nearer) of blocks of distinct vectors (id), of which there are ``m``."""

    def tile(t: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        for r in zip(*[t.column(c) for c in ("block", "side", "ids", "m", "x", "limit")], strict=True):
            ids, m = np.asarray(r[2].values), np.asarray(r[3].values)
            limit = np.asarray(r[5].values) if r[5].is_valid else np.full(len(ids), np.inf)
            sides[r[1].as_py()].append((r[0].as_py(), _Side(ids, m, _matrix(r[4].as_py(), len(ids), packed), limit, listed)))
        for i, (_, a) in enumerate(sides[0]):
            for j, (_, b) in enumerate(sides[1] or sides[0]):
                if sides[1] or i <= j:
                    _meet(a, b)
        out = sides[0] + sides[1]
        for _, a in out:
            a.fold()
        arrays = ([b for b, _ in out], [a.limit for _, a in out], [a.found.tobytes() for _, a in out])
        return pa.table([pa.array(c, kind) for c, kind in zip(arrays, (pa.int64(), pa.list_(pa.float64()), pa.binary()), strict=True)], ["block", "limit", "found"])

    def met(meets: DataFrame) -> DataFrame:
        return meets.repartition(_tiles(blocks), "g", "a", "b").groupBy("g", "a", "b").applyInArrow(tile, "block long, limit array<double>, found binary")

    own = blocks.withColumns({"a": F.col("band"), "b": F.col("band"), "side": F.lit(0), "limit": F.lit(None).cast("array<double>")})
    near = cut(met(own), "density-near")  # in their own bands: no list needs what is beyond these
    others = blocks.join(near.select("block", "limit"), "block").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("bands") - 1))).where("to != band")
    others = others.withColumns({"a": F.least("band", "to"), "b": F.greatest("band", "to"), "side": (F.col("band") > F.col("to")).cast("int")})
    parts = near.union(met(others)).groupBy("block").agg(F.collect_list("found").alias("found"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                ids, m = (np.asarray(b.column(c)[r].values) for c in ("ids", "m"))
                found, rank = _first(np.concatenate([np.frombuffer(f.as_py(), FOUND) for f in b.column("found")[r]]), listed)
                far, of = np.full((len(ids), listed), np.inf), np.zeros((len(ids), listed), dtype=np.int64)
                far[found["row"], rank], of[found["row"], rank] = found["far"], found["m"]
                reached = m[:, None] + of.cumsum(axis=1) >= k
                core = np.where(m >= k, 0.0, np.where(reached.any(axis=1), far[np.arange(len(ids)), reached.argmax(axis=1)], np.inf))
                ends = pa.array(np.r_[0, np.searchsorted(found["row"], np.arange(len(ids)), side="right")].astype("i4"))
                to, fars = (pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(found[c]))) for c in ("id", "far"))
                g = pa.array([b.column("g")[r].as_py()] * len(ids), b.column("g").type)
                yield pa.RecordBatch.from_arrays([g, pa.array(ids), pa.array(m), pa.array(core), pa.array(far[:, -1]), to, fars], ["g", "id", "m", "core", "bound", "to", "far"])

    kind = dict(blocks.dtypes)["g"]
    return cut(blocks.select("g", "block", "ids", "m").join(parts, "block").mapInArrow(merge, f"g {kind}, id long, m int, core double, bound double, to array<long>, far array<double>"), "density-lists")


def _listed_edges(lists: DataFrame, copies: DataFrame | None) -> DataFrame:
    """g, w, a, b: edges that hold the minimum spanning trees of all listed ones. Of copies (id, first), the first stands for all
    but where an edge is as long as the copies' own core distance: there the order of ids counts."""
    edge = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    each = lists.select("g", "id", "core", F.explode(F.arrays_zip("to", "far")).alias("e")).select("g", "id", "core", F.col("e.to").alias("to"), F.col("e.far").alias("far"))
    each = each.join(lists.select(F.col("id").alias("to"), F.col("core").alias("o_core")), "to").withColumn("w", F.greatest("core", "o_core", "far"))
    out = each.select("g", "w", *edge("id", "to"))
    if copies is not None:
        out = out.union(copies.select("g", F.col("core").alias("w"), *edge("first", "copy")))
        for mine, core, other in (("id", "core", "to"), ("to", "o_core", "id")):
            tied = each.where(F.col(core) == F.col("w")).select("g", F.col(mine).alias("first"), F.col(other).alias("end"), "w")
            out = out.union(tied.join(copies.select("first", "copy"), "first").select("g", "w", *edge("copy", "end")))
    return out.where(F.col("w") < float("inf"))


def _forest(points: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, w, sure: the minimum spanning forest of ``edges`` (g, w, a, b), and a row (a, b: its component by sure edges, w and sure
    null) for each of ``points`` (g, id, bound). A sure edge is in the tree of all edges, if those not listed are as long as both
    their ends' bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, low, ready = ["a", "b", "w", "sure"], [np.empty(0, np.int64)], [np.empty(0)], False

        def start() -> None:
            nonlocal ids, low, ready
            ids, low, ready = np.concatenate(ids), np.concatenate(low), True

        def roots(up: np.ndarray, v: np.ndarray) -> np.ndarray:
            while (up[v] != v).any():
                v = up[v]
            return v

        def root(up: np.ndarray, v: int) -> int:
            while up[v] != v:
                up[v] = v = up[up[v]]
            return v

        for batch in batches:
            n = batch.column("w").null_count  # points come first
            if n:
                ids.append(batch.column("a").slice(0, n).to_numpy())
                low.append(batch.column("bound").slice(0, n).to_numpy())
            if n == batch.num_rows:
                continue
            if not ready:
                start()
                up, sure_up, size = np.arange(len(ids)), np.arange(len(ids)), np.ones(len(ids), dtype=np.int64)
            rest = batch.slice(n)
            w, (a, b) = rest.column("w").to_numpy(), (np.searchsorted(ids, rest.column(c).to_numpy()) for c in ("a", "b"))
            some = np.flatnonzero(roots(up, a) != roots(up, b))
            kept, sure = [], []
            for e, x, y, d in zip(some.tolist(), a[some].tolist(), b[some].tolist(), w[some].tolist(), strict=True):
                p, q = root(up, x), root(up, y)
                if p == q:
                    continue
                kept.append(e)
                sure.append(bool(low[p] > d or low[q] > d))
                if sure[-1]:
                    r, s = root(sure_up, x), root(sure_up, y)
                    sure_up[max(r, s)] = min(r, s)
                if size[p] < size[q]:
                    p, q = q, p
                up[q], size[p], low[p] = p, size[p] + size[q], min(low[p], low[q])
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[kept]]), pa.array(ids[b[kept]]), pa.array(w[kept]), pa.array(sure)], names)
        if not ready:
            start()
            sure_up = np.arange(len(ids))
        for at in range(0, len(ids), 10_000):
            v = np.arange(at, min(at + 10_000, len(ids)))
            comp = ids[roots(sure_up, v)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[v]), pa.array(comp), pa.nulls(len(v), pa.float64()), pa.nulls(len(v), pa.bool_())], names)

    none = F.lit(None)
    rows = points.select("g", none.cast("double").alias("w"), F.col("id").alias("a"), none.cast("long").alias("b"), "bound").union(edges.withColumn("bound", none.cast("double")))
    return cut(rows.repartition("g").sortWithinPartitions(F.col("w").asc_nulls_first(), "a", "b").mapInArrow(run, "a long, b long, w double, sure boolean"), "density-forest")


def _leaving(x: np.ndarray, y: np.ndarray, core: np.ndarray, o_core: np.ndarray, comp: np.ndarray, o_comp: np.ndarray, theirs: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x``, the place in ``y`` of each one's first edge, in order, to another component, and its length; rows
    that have none, or a longer one than ``w``, may be missing."""
    square, error = about(x, y)
    if np.isfinite(error).all():
        np.maximum(square, (core**2)[:, None], out=square)
        np.maximum(square, (o_core**2)[None, :], out=square)
        square[comp[:, None] == o_comp[None, :]] = np.inf
        i, j = _candidates(square, np.minimum(square.min(axis=1), w**2), error)
        if len(i) <= square.size // 8:
            reach = np.maximum(of_pairs(x, y, i, j), np.maximum(core[i], o_core[j]))
            return _firsts(i, j, reach, theirs)
    reach = np.maximum(distances(x, y), np.maximum(core[:, None], o_core[None, :]))
    reach[comp[:, None] == o_comp[None, :]] = np.inf
    best, rows = reach.argmin(axis=1), np.arange(len(x))  # the first of equals has the smaller id
    return rows, best, reach[rows, best]


def _firsts(i: np.ndarray, j: np.ndarray, reach: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first of each row's edges, in order."""
    order = np.lexsort((theirs[j], reach, i))
    i, j, reach = i[order], j[order], reach[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else []
    return i[first], j[first], reach[first]


def _found(state: DataFrame, wanted: int, size: int, packed: str) -> DataFrame:
    """comp, w, a, b, other: the first edge, in order, from the wanted rows (``limit`` isn't null) of each component to another, if
    it isn't longer than the limit. ``state``: blocks with core, comp and limit."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                limit = b.column("limit")[r].values
                some = np.flatnonzero(limit.is_valid().to_numpy(zero_copy_only=False))
                if len(some):
                    own = {c: b.slice(r, 1).column(c) for c in ("g", "block", "bands")}
                    own |= {c: pa.array([b.column(c)[r].values.take(pa.array(some)).to_pylist()], b.column(c).type) for c in ("ids", "core", "comp", "limit")}
                    x = np.frombuffer(b.column("x")[r].as_py(), packed).reshape(len(limit), -1)[some]
                    yield pa.RecordBatch.from_pydict(own | {"x": pa.array([x.tobytes()], pa.binary())})

    def tile(t: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        for r in zip(*[t.column(c) for c in ("side", "ids", "core", "comp", "limit", "x")], strict=True):
            ids, core, comp, limit = (np.asarray(v.values) if v.is_valid else None for v in r[1:5])
            sides[r[0].as_py()].append((ids, core, comp, limit, _matrix(r[5].as_py(), len(ids), packed)))
        ids, core, comp, w, x = (np.concatenate(c) for c in zip(*sides[0], strict=True)) if sides[0] and sides[1] else (np.empty(0, np.int64),) * 5
        w, to, other = w.astype(float), np.full(len(ids), np.iinfo(np.int64).max), np.zeros(len(ids), dtype=np.int64)
        right = [(*r, _Side(r[0], r[0], r[4], np.empty(0), 1)) for r in sides[1]]
        for at in range(0, len(ids), size):
            part = slice(at, at + size)
            own = _Side(ids[part], ids[part], x[part], np.empty(0), 1)
            for theirs, o_core, o_comp, _, y, side in right:
                if comp[part].min() == comp[part].max() == o_comp.min() == o_comp.max():
                    continue
                own.limit = w[part]
                near = _near(own, side, False) if np.isfinite(own.limit).all() else None
                if near is None:
                    i, best, new = _leaving(x[part], y, core[part], o_core, comp[part], o_comp, theirs, w[part])
                else:
                    i, j = (v[comp[part][near[0]] != o_comp[near[1]]] for v in near)
                    i, best, new = _firsts(i, j, np.maximum(of_pairs(x[part], y, i, j), np.maximum(core[part][i], o_core[j])), theirs)
                i = i + at
                better = np.isfinite(new) & ((new < w[i]) | ((new == w[i]) & (theirs[best] < to[i])))
                i, best, new = i[better], best[better], new[better]
                w[i], to[i], other[i] = new, theirs[best], o_comp[best]
        some = np.flatnonzero(to != np.iinfo(np.int64).max)
        low, high = np.minimum(ids[some], to[some]), np.maximum(ids[some], to[some])
        order = np.lexsort((high, low, w[some], comp[some]))
        keep = order[np.flatnonzero(np.r_[True, comp[some][order][1:] != comp[some][order][:-1]])] if len(order) else order
        return pa.table([pa.array(c) for c in (comp[some][keep], w[some][keep], low[keep], high[keep], other[some][keep])], ["comp", "w", "a", "b", "other"])

    shape = "g, block, bands, ids, core, comp, limit, x".split(", ")
    kinds = dict(state.dtypes)
    left = cut(state.mapInArrow(pick, ", ".join(f"{c} {kinds[c]}" for c in shape)), "density-wanted")
    parts = max(1, -(-wanted // (SIDE * size)))
    left = left.withColumns({"a": F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("bands") - 1)), "side": F.lit(0)})
    right = state.withColumns({"a": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "b": F.col("band"), "side": F.lit(1), "limit": F.lit(None).cast("array<double>")})
    columns = ["g", "a", "b", "side", "ids", "core", "comp", "limit", "x"]
    tiles = left.select(columns).union(right.join(left.select("g").distinct(), "g", "left_semi").select(columns)).repartition(min(TILES, 2 * _tiles(state)), "g", "a", "b")
    return tiles.groupBy("g", "a", "b").applyInArrow(tile, "comp long, w double, a long, b long, other long")


def _merged(hooks: DataFrame, largest: int) -> DataFrame:
    """comp, root: components after each has joined its ``other``. Only two at a time can have chosen each other; the ``largest``
    has chosen none."""
    back = hooks.select(F.col("comp").alias("other"), F.col("other").alias("back"))
    up = hooks.join(back, "other", "left").select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("root"))
    up = cut(up.union(hooks.sparkSession.createDataFrame([(largest, largest)], "comp long, root long")), "density-up")
    while True:
        over = up.select(F.col("comp").alias("root"), F.col("root").alias("top"))
        new = cut(up.join(over, "root").select("comp", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "density-up")
        up = new.drop("moved")
        if new.where("moved").isEmpty():
            return up


def spanning_tree(points: DataFrame, min_cluster_size: int, block: int) -> DataFrame:
    """a, b, w: the minimum spanning trees of mutual reachability of points (g, id, x)."""
    k, listed = min_cluster_size, max(LISTED, 3 * min_cluster_size)
    packed = "<f4" if dict(points.dtypes)["x"] == "array<float>" else "<f8"
    classes = cut(points.groupBy("g", "x").agg(F.min("id").alias("id"), F.count("*").alias("n")), "density-classes")
    ordered = classes.withColumn("m", F.least("n", F.lit(k)).cast("int")).withColumn("h", F.xxhash64("x")).withColumnRenamed("id", "ids")
    ordered = ordered.repartitionByRange("g", "h").sortWithinPartitions("g", "h", "ids").select("g", F.col("ids").alias("id"), "ids", "m", "x")
    lists = _lists(_blocks(ordered, block, "ids", "m"), k, listed, packed)
    of = lists.select("g", "id", "core", "bound")
    copies = None
    if not (repeated := classes.where("n > 1")).isEmpty():
        mine = points.join(repeated.select(F.col("g").alias("h"), F.col("x").alias("y"), F.col("id").alias("first")), F.col("g").eqNullSafe(F.col("h")) & (F.col("x") == F.col("y"))).where("id != first")
        copies = cut(mine.select("id", "first").join(of.withColumnRenamed("id", "first"), "first").select("g", F.col("id").alias("copy"), "first", "core", "bound"), "density-copies")
        of = of.union(copies.select("g", F.col("copy").alias("id"), "core", "bound"))
    forest = _forest(of, _listed_edges(lists, copies))
    tree, open_edges = forest.where("sure").select("a", "b", "w"), forest.where("not sure").select("a", "b", "w")
    rest = forest.where("w is null").select(F.col("a").alias("id"), F.col("b").alias("comp")).join(of, "id")
    split = rest.groupBy("g").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least != most").select(F.col("g").alias("h"))
    if split.isEmpty():
        return tree
    state = cut(rest.join(split, F.col("g").eqNullSafe(F.col("h")), "left_semi").select("id", "comp", "core", "bound"), "density-points")
    blocks = _blocks(points.join(state.select("id"), "id", "left_semi").repartitionByRange("g", "id").sortWithinPartitions("g", "id").select("g", "id", F.col("id").alias("ids"), "x"), block, "ids")
    blocks = cut(blocks, "density-banded")
    at = cut(blocks.select("block", F.posexplode("ids").alias("pos", "id")), "density-places")
    while True:
        largest = state.groupBy("comp").count().orderBy(F.desc("count"), "comp").first()
        largest = largest.comp if largest else -1
        ends = open_edges
        for end in ("a", "b"):
            ends = ends.join(state.select(F.col("id").alias(end), F.col("comp").alias(f"{end}_comp")), end)
        ends = cut(ends.where("a_comp != b_comp"), "density-open")
        sides = ends.selectExpr("a_comp comp", "w", "a", "b", "b_comp other").union(ends.selectExpr("b_comp comp", "w", "a", "b", "a_comp other")).where(F.col("comp") != largest)
        limits = sides.groupBy("comp").agg(F.min("w").alias("limit"))
        limit = F.when((F.col("comp") != largest) & (F.col("core") < float("inf")), F.coalesce("limit", F.lit(float("inf"))))
        now = state.join(limits, "comp", "left").withColumn("limit", limit).withColumn("limit", F.when(F.col("bound") <= F.col("limit"), F.col("limit")))
        now = cut(now.join(at, "id"), "density-state")
        if wanted := now.where("limit is not null").count():
            arrays = now.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "comp", "core", "limit"))).alias("s"))
            arrays = arrays.select("block", "s.comp", "s.core", "s.limit")
            sides = sides.union(_found(blocks.join(arrays, "block"), wanted, block, packed))
        best = cut(sides.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "other")).alias("e")).select("comp", "e.*"), "density-best")
        if best.isEmpty():
            return tree
        tree = tree.union(best.select("a", "b", "w").distinct())
        state = cut(state.join(_merged(best, largest), "comp").select("id", F.col("root").alias("comp"), "core", "bound"), "density-points")


def density(vectors: DataFrame, group: str | None, key: str, min_cluster_size: int = 5, block: int = BLOCK) -> DataFrame:
    """group, key, cluster (-1: noise), by groups, or over all vectors as one group. Rows without a vector don't count."""
    x = F.col("embedding") if dict(vectors.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>")
    rows = vectors.where(F.col("embedding").isNotNull()).select((F.col(group) if group else F.lit(0)).alias("g"), F.col(key).alias("key"), x.alias("x"))
    points = cut(_numbered(rows.repartitionByRange("g", "key").sortWithinPartitions("g", "key")), "density-rows")
    ids = points.select("g", "id", "key")
    tree = spanning_tree(points.select("g", "id", "x"), min_cluster_size, block)
    kind, key_kind = dict(points.dtypes)["g"], dict(rows.dtypes)["key"]
    own = ids.select("g", "id", F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("w"))
    own = own.union(tree.join(ids.select("g", F.col("id").alias("a")), "a").select("g", "a", "b", "w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.sort(pdf.loc[pdf["b"].isna(), "id"].to_numpy())
        edges = pdf[pdf["b"].notna()].sort_values(["w", "id", "b"])
        place = lambda c: np.searchsorted(points, edges[c].to_numpy().astype(np.int64)).tolist()
        found = condensed(len(points), list(zip(edges["w"].tolist(), place("id"), place("b"), strict=True)), min_cluster_size)
        return pd.DataFrame({"id": points, "cluster": found.astype("int32")})

    labelled = own.groupBy("g").applyInPandas(run, "id long, cluster int")
    out = ids.join(labelled, "id")
    return out.select(F.col("g").cast(kind).alias(group), F.col("key").cast(key_kind).alias(key), "cluster") if group else out.select(F.col("key").alias(key), "cluster")
