"""Suffix-array dedup against plain sets of 50-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from graphloom.llm import suffix_dedup as sd


def brute(rows):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - 49):
                s = t[i : i + 50]
                first[s] = min(first.get(s, d), d)
    out = []
    for d, t in texts:
        gone = set()
        if d is not None:
            for i in range(len(t) - 49):
                if first[t[i : i + 50]] < d:
                    gone |= set(range(i, i + 50))
        left = bytes(b for i, b in enumerate(t) if i not in gone)
        out.append((d, len(t), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [2, 100_000])
def test_dedup(docs, rows, hot):
    got = sorted(map(tuple, sd.dedup(docs, hot).collect()), key=repr)
    assert got == brute([r[:2] for r in rows])


def test_empty(empty):
    assert sd.dedup(empty).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_spliced_texts(spark, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcd ") for _ in range(400)) for _ in range(4)] + ["x" * 300, "xy" * 120]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            b = rnd.choice(base)
            i = rnd.randrange(len(b))
            parts.append(b[i : i + rnd.randrange(20, 140)])
        rows.append((d * 7 % 61, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (4, 1000):
        assert sorted(map(tuple, sd.dedup(df, hot).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("alphabet", [1, 2, 5, 256])
def test_two_stage_sorts_suffixes(alphabet):
    rnd = np.random.default_rng(alphabet)
    for n in (1, 2, 3, 50, 400):
        t = rnd.integers(0, alphabet, n).astype(np.uint8)
        data = t.tobytes()
        order = sd.two_stage(t)
        assert sorted(order.tolist()) == list(range(n))
        keys = [data[i : i + 50] for i in order]
        assert keys == sorted(keys)
        lcp = sd.common_prefixes(t, order).tolist()
        for k in range(1, n):
            a, b = data[order[k - 1] :], data[order[k] :]
            assert min(lcp[k], len(a), len(b)) == min(next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))), 50)


def test_anchors_depend_on_the_window_alone():
    rnd = np.random.default_rng(0)
    for _ in range(50):
        s = rnd.integers(0, 4, 50).astype(np.uint8)
        found = []
        for k in (0, 7, 40):
            data = np.concatenate([rnd.integers(0, 4, k).astype(np.uint8), s, rnd.integers(0, 4, k).astype(np.uint8)])
            at, h = sd.anchors(data, np.array([len(data)]))
            found.append({(int(p) - k, int(x)) for p, x in zip(at, h, strict=True) if k <= p <= k + 30})
        assert found[0] and all(found[0] <= f for f in found)
