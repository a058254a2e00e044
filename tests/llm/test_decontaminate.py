"""Decontamination against windows at every place, and its parts."""

import itertools
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from graphloom.llm import decontaminate as dc

from .conftest import passage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def shingles(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def brute(docs, items, least=0.8, width=5):
    """(doc_id, item_id) -> best similarity over all windows of the item's size."""
    out = {}
    for (d, t), (i, s) in itertools.product(docs, items):
        w, own = tokens(t), tokens(s)
        k = min(width, len(own))
        if not own or len(w) < k:
            continue
        b = shingles(own, k)
        for at in range(max(1, len(w) - len(own) + 1)):
            a = shingles(w[at : at + len(own)], k)
            both = sum(min(a[x], b[x]) for x in a)
            sim = both / (sum(a.values()) + sum(b.values()) - both)
            if sim >= least and sim > out.get((d, i), 0):
                out[d, i] = sim
    return out


def cases():
    items = [(k, passage(100 + k, n)) for k, n in enumerate((20, 36, 59, 36, 3, 1, 12))] + [(7, None), (8, ""), (9, passage(101, 36)), (10, "Beta beta beta beta beta beta beta")]
    rnd, docs = random.Random(1), []
    for d in range(60):
        own = tokens(items[rnd.choice([0, 1, 2, 3, 6])][1])
        kind = d % 6
        if kind == 1:
            own[rnd.randrange(len(own))] = "changed"
        if kind == 2:
            own = own[rnd.randrange(4) :]
        if kind == 3:
            own.insert(len(own) // 2, "extra")
        if kind == 4:
            own = own[: len(own) // 2]
        if kind == 5:
            own = []
        docs.append((d, " ".join([passage(d, rnd.randrange(30)), *own, passage(1000 + d, rnd.randrange(30))]).upper() if d % 2 else "\n".join([passage(d, 9), " ".join(own)])))
    return [*docs, (60, None), (61, ""), (62, "beta " * 40), (63, tokens(items[5][1])[0]), (64, items[0][1] + "\n" + items[2][1])], items


def test_matches_are_those_of_all_windows(spark):
    docs, items = cases()
    d = spark.createDataFrame([(*x, "extra") for x in docs], "doc_id long, text string, size string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.matches(d, i).collect()}
    want = brute(docs, items)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert len(want) > 20
    clean = {r.doc_id for r in dc.clean(d, i).collect()}
    assert clean == {x[0] for x in docs} - {k[0] for k in want} and dc.clean(d, i).columns == d.columns


def test_blocks_cover_the_radius(spark):
    rnd, radius = random.Random(2), 16
    rows = []
    for _ in range(200):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randrange(radius + 1)):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long")
    both = df.select(F.arrays_overlap(dc._blocks(F.col("a"), radius + 1), dc._blocks(F.col("b"), radius + 1)).alias("hit"))
    assert both.where("NOT hit").count() == 0


def test_without_broadcast(spark, monkeypatch):
    docs, items = cases()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    with_ = sorted(map(tuple, dc.matches(d, i).collect()))
    monkeypatch.setattr(dc, "BROADCAST_SHINGLES", 0)
    assert sorted(map(tuple, dc.matches(d, i).collect())) == with_


def test_defined_cases(docs, empty, spark):
    items = spark.createDataFrame([(1, passage(1, 60)), (2, passage(1, 60))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.matches(docs, items).collect()}
    assert got and {i for _, i in got} == {1, 2}
    assert dc.matches(empty, items).count() == dc.matches(docs, empty.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
    assert dc.clean(docs, items).schema == docs.schema


def found_and_wanted(spark, docs, items):
    got = dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got.collect()}, {k: round(v, 9) for k, v in brute(docs, items).items()}


def test_best_window_between_two_alignments(spark):
    """Both ends altered and words put in the middle: neither alignment of a shared shingle reaches 0.8."""
    item = [f"w{k}" for k in range(100)]
    altered = ["x1", "x2", "x3", *item[3:50], *[f"new{k}" for k in range(6)], *item[50:97], "y1", "y2", "y3"]
    docs = [(n, " ".join([*(f"a{k}" for k in range(n)), *altered, *(f"b{k}" for k in range(n))])) for n in (0, 5, 40)]
    got, want = found_and_wanted(spark, docs, [(1, " ".join(item))])
    assert got == want and set(want) == {(0, 1), (5, 1), (40, 1)} and round(want[40, 1], 4) == 0.8113


def test_matches_beyond_sixteen_bits(spark):
    """Last words replaced: similarity over 0.8, but word SimHashes over 16 bits apart."""

    def simhash(w):
        hs = [xxhash.xxh64_intdigest(x, 42) for x in w]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    rnd, docs, items = random.Random(6), [], []
    while len(items) < 3:
        item = [f"w{rnd.getrandbits(40)}" for _ in range(100)]
        doc = [*item[:-10], *(f"n{rnd.getrandbits(40)}" for _ in range(10))]
        if (simhash(item) ^ simhash(doc)).bit_count() > 16:
            docs.append((len(docs), " ".join(doc)))
            items.append((len(items), " ".join(item)))
    got, want = found_and_wanted(spark, docs, items)
    assert got == want and set(want) == {(k, k) for k in range(3)}


def test_items_that_share_an_id_or_have_none(spark):
    a, b, c = (passage(k, 50) for k in (901, 902, 903))
    docs = [(1, a), (2, b), (3, c), (4, "a " * 300), (None, a)]
    items = [(7, a), (7, b), (7, b), (None, c), (8, "a " * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted([(r.doc_id, r.item_id, r.start, r.similarity) for r in dc.matches(df, it).collect()], key=repr)
    assert got == sorted([(1, 7, 0, 1.0), (2, 7, 0, 1.0), (3, None, 0, 1.0), (4, 8, 0, 1.0), (None, 7, 0, 1.0)], key=repr)
    assert dc.clean(df, it).count() == 0


def test_long_repetitive_text(spark):
    """A megabyte of five words over and over against an item of the same: few different windows, one row."""
    words = "lorem ipsum dolor sit amet ".split()
    text, item = " ".join(words * 40_000), " ".join(words * 12)
    docs = spark.createDataFrame([(1, text), (2, "other words " + passage(3, 200)), (3, passage(4, 100) + " " + item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, passage(5, 60))], "item_id long, text string")
    found = dc.matches(docs, items).select("doc_id", "item_id", "start", "n_words", "similarity").collect()
    assert sorted(map(tuple, found)) == [(1, 7, 0, 60, 1.0), (3, 7, 100, 60, 1.0)]
    assert sorted(r.doc_id for r in dc.clean(docs, items).collect()) == [2]
