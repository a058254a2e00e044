"""The pipeline's near-dedup stage against brute-force Jaccard of five-word shingles."""

import itertools
import random

import corpus_pipeline
from graphloom.llm import jaccard_join

from .conftest import passage


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_kept(docs):
    """doc_ids that are the smallest of their component."""
    root = {d: d for d, _ in docs}
    own = {d: sets(t) for d, t in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, _), (b, _) in itertools.combinations(docs, 2):
        if jaccard(own[a], own[b]) >= 0.8 - 1e-12:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d for d in root if find(d) == d}


def cases():
    rnd, docs = random.Random(3), []
    for group in range(25):
        base = passage(5000 + group, 300).split()
        for changed in (0, 1, 2, 3, 4, 5, 6, 7, 9, 30):
            w = list(base)
            for at in rnd.sample(range(len(w)), changed):
                w[at] = f"new{rnd.random()}"
            docs.append(" ".join(w))
    chain = passage(77, 400).split()
    docs += [" ".join(chain[k : k + 300]) for k in range(0, 100, 12)]  # neighbours are near, the ends are not
    docs += [None, "", "one two", "One  TWO", "one three"]
    rnd.shuffle(docs)
    return list(enumerate(docs))


def test_stage_equals_brute_force_jaccard(spark):
    docs = cases()
    df = spark.createDataFrame([(*x, "extra") for x in docs], "doc_id long, text string, node string").repartition(3)
    got = corpus_pipeline.near_copies(spark, df, "").collect()
    want = brute_kept(docs)
    assert {r.doc_id for r in got} == want and len(got) == len(want) < len(docs) // 2


def test_large_group_of_one_bucket(spark):
    rnd, docs = random.Random(4), []
    base = passage(9, 120).split()
    for d in range(300):  # each near the base; many not near each other
        w = list(base)
        for at in rnd.sample(range(len(w)), 2):
            w[at] = f"x{d}_{at}"
        docs.append((d, " ".join(w)))
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == brute_kept(docs)


def test_family_of_near_copies_makes_no_pairs(spark, monkeypatch):
    """Texts of one template, most pairs just under the threshold: rows grow with the texts, not with their square."""
    rnd, docs, made = random.Random(6), [], {}
    base = passage(11, 240).split()
    for d in range(600):
        w = list(base)
        for at in rnd.sample(range(len(w)), 5 + d % 3):
            w[at] = f"y{rnd.randrange(5000)}"
        docs.append((d, " ".join(w)))
    cut = jaccard_join.cut

    def counted(df, what, *more):
        out = cut(df, what, *more)
        made[what] = made.get(what, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "cut", counted)
    monkeypatch.setattr(jaccard_join, "SMALL", 400)
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == brute_kept(docs)
    rows = {k: n for k, n in made.items() if k in ("jaccard-moved", "jaccard-parts", "jaccard-links")}
    assert rows["jaccard-parts"] > 0 and max(rows.values()) < 80 * len(docs) < 600 * 599 / 2, rows


def test_every_similarity_near_the_threshold(spark):
    """Pairs of many lengths around similarity 0.8: found exactly if they reach it."""
    rnd, docs = random.Random(8), []
    for pair in range(150):
        w = passage(900 + pair, rnd.randrange(6, 200)).split()
        v = list(w)
        for at in rnd.sample(range(len(v)), max(1, round(len(v) * rnd.uniform(0.01, 0.04)))):
            v[at] = f"z{pair}_{at}"
        docs += [" ".join(w), " ".join(v)]
    docs = list(enumerate(docs))
    near = [jaccard(sets(docs[k][1]), sets(docs[k + 1][1])) for k in range(0, 300, 2)]
    assert sum(0.75 < s < 0.8 for s in near) > 10 and sum(0.8 <= s < 0.85 for s in near) > 10
    got = corpus_pipeline.near_copies(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == brute_kept(docs)
