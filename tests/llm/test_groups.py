"""SimHash components and sharding against plain Python."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest

from graphloom.llm import queries, sharding, simhash_dedup

import xxhash


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """value -> smallest value of its component."""
    at = {f: f for f in fps}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            at[y] = x
    return {f: find(f) for f in fps}


def test_components_match_brute_force(docs, rows, empty):
    fp = [brute_fp(r[1]) for r in rows]
    root = brute_components(set(fp))
    least = {}
    for r, f in zip(rows, fp, strict=True):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    want = sorted([(r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fp, strict=True)], key=repr)
    assert sorted(map(tuple, simhash_dedup.components(docs).collect()), key=repr) == want
    assert simhash_dedup.components(empty).count() == 0


def test_masks_cover_every_pair():
    ms = [m % (1 << 64) for m in simhash_dedup.masks()]
    assert len(ms) == 7
    for bits in itertools.chain([()], itertools.combinations(range(64), 1), itertools.combinations(range(64), 2)):
        x = sum(1 << b for b in bits)
        assert any(x & m == 0 for m in ms)


@pytest.mark.parametrize("small", [2, 32])
def test_links_lose_no_pair(spark, small):
    """Clusters around few centres, by the array path and by hubs."""
    rnd, fps = random.Random(3), set()
    for _ in range(4):
        c = rnd.getrandbits(64)
        fps |= {c, *(c ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(60))}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = simhash_dedup.links(df, small)
    assert all((r.a ^ r.b).bit_count() <= 2 for r in found.collect())
    roots = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash_dedup.contract(found).collect()}
    groups = {}
    for f, r in brute_components(fps).items():
        groups.setdefault(r, set()).add(f)
    ours = {}
    for f in fps:
        ours.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_contract_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {(r.node, r.root) for r in simhash_dedup.contract(df).collect()} == {(i, 0) for i in range(1, 301)}


def test_near_dedup_keeps_one(docs):
    left = simhash_dedup.dedup_fingerprints(docs)
    assert left.schema == docs.schema
    c = simhash_dedup.components(docs).collect()
    assert {r.doc_id for r in left.collect()} - {None} == {r.component_id for r in c} - {None}


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_differencing(n):
    rnd = np.random.default_rng(n)
    v = np.zeros((n, 4), dtype=np.int64)
    v[:, 0] = rnd.integers(1, 1000, n)
    place, bins = sharding.difference(v)
    assert all(sorted(p) == list(range(4)) for p in place)
    assert [v[:, 0][place[:, 0] == b].sum() for b in range(4)] == bins.tolist()
    if n == 100:
        assert bins.max() - bins.min() <= 3


def test_shards(docs, rows, empty):
    for per_bucket in (3, 1000):
        out = sharding.shard(docs, 4, per_bucket).collect()
        size = lambda t: len((t or "").encode()) + 1
        assert sorted([(r.doc_id, r.size, r.text_crc32) for r in out], key=repr) == sorted([(r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows], key=repr)
        of = {}
        for r in out:
            of.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        assert all(len(s) == 1 for s in of.values())
        for s in {r.shard for r in out}:
            slots = sorted(r.slot for r in out if r.shard == s)
            assert slots == list(range(len(slots)))
    assert sharding.shard(empty).count() == 0


@pytest.mark.parametrize("per_bucket", [50, 50_000])
def test_shards_are_balanced(docs, spark, sf_dir, per_bucket):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 2000") if per_bucket == 50 else spark.read.parquet(f"{sf_dir}/documents.parquet")
    total = [r[1] for r in sharding.shard(d, 8, per_bucket).groupBy("shard").sum("size").collect()]
    assert len(total) == 8 and max(total) - min(total) < sum(total) / 8 * (0.05 if per_bucket == 50 else 0.001)


def brute_differencing(sizes, k):
    """Sets of items, one for each bin: the two partial partitions of largest spread are combined until one is left."""
    parts = [(s, i, [(s, {i}), *((0, set()) for _ in range(k - 1))]) for i, s in enumerate(sizes)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p[0], p[1]))
        (_, _, x), (_, _, y), *parts = parts
        bins = sorted(((p[0] + q[0], p[1] | q[1]) for p, q in zip(x, reversed(y), strict=True)), key=lambda b: -b[0])
        parts.append((bins[0][0] - bins[-1][0], made, bins))
        made += 1
    return [items for _, items in parts[0][2]] if parts else []


def test_query_equals_brute_differencing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "coalesce(text, '') AS text")
    groups = docs.selectExpr("text", "xxhash64(text) AS id", "xxhash64(1, text) AS id2").distinct().orderBy("id", "id2").collect()
    copies = collections.Counter(r.text for r in docs.collect())
    bins = brute_differencing([copies[g.text] * (len(g.text.encode()) + 1) for g in groups], 8)
    want = {frozenset(groups[i].text for i in items) for items in bins if items}
    shard_of = {r.doc_id: r for r in queries.QUERIES["op7_sharding"](spark, sf_dir).collect()}
    got, rows = {}, docs.collect()
    for r in rows:
        own = shard_of[r.doc_id]
        got.setdefault(own["shard"], set()).add(r.text)
        assert (own["size"], own["text_crc32"], own["law"], own["grown_shard"]) == (len(r.text.encode()) + 1, zlib.crc32(r.text.encode()), "bytes", None)
    assert {frozenset(s) for s in got.values()} == want and len(shard_of) == len(rows)
