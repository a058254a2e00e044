"""Katz backoff against plain dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import katz_bigrams
from graphloom.llm import katz_lm as lm


def tokens(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), "\n"]


def is_held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 1


class Brute:
    def __init__(self, texts, order):
        self.order, self.counts = order, [None]
        for k in range(1, order + 1):
            c = defaultdict(Counter)
            for t in texts:
                t = [" "] * (order - 1) + tokens(t)
                for i in range(order - 1, len(t)):
                    c[tuple(t[i - k + 1 : i])][t[i]] += 1
            self.counts.append(c)
        self.d = [None, *(self.discount(c) for c in self.counts[1:])]
        self.n = sum(self.counts[1][()].values())
        self.v = len(self.counts[1][()])

    @staticmethod
    def discount(c):
        n = Counter(x for h in c.values() for x in h.values())
        out = {}
        for r in range(1, 6):
            d = -1
            if n[1] and n[r]:
                rest = 6 * n[6] / n[1]
                if rest < 1:
                    d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest)
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    def p(self, w, h):
        k = len(h) + 1
        c = self.counts[k].get(h)
        if not c:
            return self.p(w, h[1:])
        kept = {x: n * self.d[k].get(n, 1) for x, n in c.items()}
        total = sum(c.values())
        bottom = total if sum(kept.values()) < total else total + 1
        if w in c:
            return kept[w] / bottom
        free = 1 - sum(kept.values()) / bottom
        return free if k == 1 else free / (1 - sum(self.p(x, h[1:]) for x in c)) * self.p(w, h[1:])

    def score(self, text):
        t = [" "] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(t[i], tuple(t[i - self.order + 1 : i]))) for i in range(self.order - 1, len(t)))


@pytest.mark.parametrize(("chunk", "bucket", "hot"), [(20, 5, 1), (10**9, 3, 10**9)])
def test_bigrams_by_chunks_and_buckets(spark, monkeypatch, chunk, bucket, hot):
    monkeypatch.setattr(katz_bigrams, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(katz_bigrams, "BUCKET_TOKENS", bucket)
    monkeypatch.setattr(katz_bigrams, "HOT", hot)
    test_scores(spark, 2)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores(spark, order):
    texts = ["a b a b a c", "a b", "b c a b", "", None, "c c c d", "The the THE end", "x y z", "a b a b a b"] * 2
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    b = Brute([t for d, t in rows if not is_held(d)], order)
    for r in lm.score_table(df, order).collect():
        t = tokens(texts[r.doc_id])
        c = [b.counts[1][()][w] for w in t]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_held(r.doc_id), len(t), sum(x > 0 for x in c), b.n)
        assert math.isclose(r.base_score, sum(math.log10((x + 0.5) / (b.n + 0.5 * (b.v + 1))) for x in c), rel_tol=1e-9)
        assert math.isclose(r.score, b.score(texts[r.doc_id]), rel_tol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_sum_to_one(order):
    b = Brute(["a b a b a c", "b c a b", "c c c d", "a a a a a a a a a"], order)
    for k in range(1, order + 1):
        for h in b.counts[k]:
            assert math.isclose(sum(b.p(w, h) for w in [*b.counts[1][()], "unknown"]), 1)


def test_defined_cases(docs, rows, empty):
    got = lm.score_table(docs).collect()
    assert len(got) == len(rows)
    assert sum(not r.held_out for r in got) == sum(not is_held(r[0]) for r in rows)
    assert lm.score_table(empty).count() == 0
    only_held = docs.where(lm.held_out(F.col("doc_id")))
    assert all(r.score is None and r.n_known == 0 for r in lm.score_table(only_held).collect())
