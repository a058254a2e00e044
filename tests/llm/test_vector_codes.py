"""Vector codes against plain Python integers."""

import hashlib
import math

import numpy as np

from graphloom.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, own string"


def brute(rows, entries=256, rounds=4):
    """(vec_id, code, error, label_error, digest) of usable rows, in whole numbers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length = max([len(v) for _, v, _ in kept], default=0)
    length = max(4, -(-length // 4) * 4)
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v] + [0] * (length - len(v)), lab) for i, v, lab in kept]
    n = length // 4
    cut = lambda v: [v[k * n : k * n + n] for k in range(4)]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v)[k] for _, v, _ in start] for k in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for k in range(4):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(nearest(cut(v)[k], books[k])[1], []).append(cut(v)[k])
            for e, own in groups.items():
                books[k][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, lab in kept:
        found = [nearest(cut(v)[k], books[k]) for k in range(4)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab))
        by_label[lab] = by_label.get(lab, 0) + out[-1][2]
    return sorted([(i, code, error, by_label[lab], digest) for i, code, error, lab in out], key=repr)


def got(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(queries.QUERIES["op11_vector_codes"](spark, sf_dir)) == brute(rows)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in rng.normal(size=6).astype("f4")], k % 3 or None) for k in range(40)]
    rows += [(3, rows[3][1], None), (3, rows[4][1], 1), (None, rows[5][1], 2), (50, None, 1), (51, [1.0, None], 1), (52, [nan], 1), (53, [1.0, inf], None)]
    rows += [(54, [], 1), (55, [-0.0001, 0.5], 7), (56, [0.0] * 6, None), (57, [0.0] * 6, None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    assert got(vector_codes.code_table(df)) == brute(rows)
    assert vector_codes.code_table(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vector_codes.code_table(spark.createDataFrame([(1, None, 1, "", "")], SCHEMA)).count() == 0


def test_unused_entries_stay_and_ties_go_low(spark):
    rows = [(k, [float(k // 2)] * 4, 0) for k in range(8)]
    assert got(vector_codes.code_table(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))) == brute(rows)


def test_huge_values_stay_exact(spark):
    rows = [(1, [3e38, -3e38, 0.0, 1.0], 0), (2, [65536.0, -65536.0, 0.0, 1.0], 0)]
    codes = vector_codes.code_table(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r.error for r in codes} == {0} and {r.code for r in codes} == {"00000000"}
