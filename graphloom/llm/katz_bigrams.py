"""The bigram Katz model by blocks: what ``katz_lm`` defines, with a fraction of its shuffles.

Documents are cut into chunks of about ``CHUNK_BYTES`` of text, each with its own dictionary. Tokens never travel one by
one: a chunk sends each distinct word once, and each distinct bigram once, packed by history into buckets, and
gets back their counts in the order in which it sent them.

1. Chunks: tokens as local numbers, words' hashes, training counts.
2. Words: global counts by a group-by; each chunk gets those of its words. This is the unigram table.
3. Bigrams: each bucket adds up the counts of its bigrams, and for each history what its backoff weight needs: training
   count, types with counts 1 to K + 1, and the unigram probability of the types seen. This is the bigram table.
4. Histories: sums by a group-by give bottoms and backoff weights; each chunk gets those of its words.
5. Each chunk evaluates its tokens: a seen bigram by its discounted count, any other by its history's weight and the
   unigram below it.

A history that more than one in ``HOT`` training tokens follows is spread over buckets by bigram, so no bucket grows with it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, importable
from .katz_lm import K, discounts, good_turing, held_out

CHUNK_BYTES = 16_000_000
BUCKET_TOKENS = 4_000_000
HOT = 2_000
START, END = 0, 1


def _packed(a: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes of small numbers cost nothing."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return zlib.compress(planes.tobytes(), 1)


def _unpacked(b: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), dtype=np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def _chunks(docs: DataFrame) -> DataFrame:
    """chunk, doc_ids, held, lens, tokens (packed local numbers), hashes and train: the local words' hashes and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        first, n_chunks = TaskContext.get().partitionId() << 24, 0
        known: dict[bytes, int] = {b" ": START, b"\n": END}  # neither can be a word
        ids: list = []
        held: list[bool] = []
        parts: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal known, size, n_chunks
            lens = np.array([len(p) for p in parts], dtype=np.int32)
            tokens = np.concatenate(parts)
            train = np.bincount(tokens[np.repeat(~np.array(held), lens)], minlength=len(known))
            hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in known], dtype=np.uint64).view(np.int64)
            out = {
                "chunk": pa.array([first + n_chunks], pa.int64()),
                "doc_ids": pa.array([list(ids)], pa.list_(pa.int64())),
                "held": pa.array([list(held)], pa.list_(pa.bool_())),
                "lens": pa.array([lens], pa.list_(pa.int32())),
                "tokens": pa.array([_packed(tokens)], pa.binary()),
                "hashes": pa.array([hashes], pa.list_(pa.int64())),
                "train": pa.array([train], pa.list_(pa.int64())),
            }
            known, size, n_chunks = {b" ": START, b"\n": END}, 0, n_chunks + 1
            for x in (ids, held, parts):
                x.clear()
            return pa.RecordBatch.from_pydict(out)

        for b in batches:
            for d, h, t in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(d)
                held.append(h)
                parts.append(np.array([*[known.setdefault(w, len(known)) for w in t.lower().split()], END], dtype=np.int32))
                size += len(t) + 1
                if size >= CHUNK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "chunk long, doc_ids array<long>, held array<boolean>, lens array<int>, tokens binary, hashes array<long>, train array<long>")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _bigrams(tokens: np.ndarray, lens: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_buckets: int, hot: float):
    """History and word of each distinct bigram, which one each token ends, and the bigrams' buckets."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(lens) - lens] = START
    pairs, which = np.unique(before.astype(np.int64) * len(hashes) + tokens, return_inverse=True)
    h, w = pairs // len(hashes), pairs % len(hashes)
    spread = (counts[h] > hot) | (h == START)
    key = np.where(spread, _mixed(hashes[h] ^ _mixed(hashes[w])), _mixed(hashes[h]))
    return h, w, which, (key % np.uint64(n_buckets)).astype(np.int32)


def _columns(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    """tokens, lens, hashes, counts of row i."""
    value = lambda c: np.asarray(batch.column(c)[i].values)
    return _unpacked(batch.column("tokens")[i].as_py(), "<i4"), value("lens"), value("hashes").view(np.uint64), value("counts")


def _sent(chunks: DataFrame, n_buckets: int, hot: float) -> DataFrame:
    """bucket, chunk, payload: a chunk's distinct bigrams of a bucket, packed by history."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, lens, hashes, counts = _columns(batch, i)
                h, w, which, bucket = _bigrams(tokens, lens, hashes, counts, n_buckets, hot)
                held = np.repeat(np.asarray(batch.column("held")[i].values.to_numpy(zero_copy_only=False)).astype(bool), lens)
                n = np.bincount(which[~held], minlength=len(h)).astype("<u4")
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                for b in range(n_buckets):
                    of = order[cuts[b] : cuts[b + 1]]
                    if not len(of):
                        continue
                    new = np.flatnonzero(np.diff(h[of], prepend=-1))
                    runs = np.diff(np.append(new, len(of))).astype("<u4")
                    words = (hashes[w[of]] >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]  # 48 bits tell words apart after one history
                    fields = [hashes[h[of][new]].astype("<u8").tobytes(), _packed(runs), words.tobytes(), _packed(n[of]), _packed(counts[w[of]].astype("<i8"))]
                    head = np.array([len(f) for f in fields], dtype="<u8").tobytes()
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([b], pa.int32()), "chunk": batch.column("chunk").slice(i, 1), "payload": pa.array([head + b"".join(fields)], pa.binary())})

    return chunks.mapInArrow(run, "bucket int, chunk long, payload binary")


def _opened(payload: bytes) -> tuple[np.ndarray, ...]:
    """History hashes, word hashes (48 bits), training counts, unigram counts, one for each bigram."""
    sizes = np.frombuffer(payload, "<u8", 5).astype(np.int64)
    at = np.concatenate([[40], 40 + np.cumsum(sizes)])
    f = [payload[a:b] for a, b in zip(at, at[1:], strict=False)]
    h = np.repeat(np.frombuffer(f[0], "<u8"), _unpacked(f[1], "<u4"))
    w = np.zeros((len(f[2]) // 6, 8), dtype=np.uint8)
    w[:, :6] = np.frombuffer(f[2], np.uint8).reshape(-1, 6)
    return h, w.view("<u8").reshape(-1), _unpacked(f[3], "<u4").astype(np.int64), _unpacked(f[4], "<i8")


def discounted(c: np.ndarray, d: dict[int, float]) -> np.ndarray:
    out = c.astype(np.float64)
    for r, x in d.items():
        out[c == r] = r * x
    return out


TYPES = [f"t{r}" for r in range(1, K + 2)]


def _added(sent: DataFrame, d1: dict[int, float], bottom: float) -> DataFrame:
    """Rows of two kinds: chunk, bucket, reply (counts in the order sent); h, n, t1.., low: what a history's bigrams of this bucket amount to."""
    stats = [("h", pa.int64()), ("n", pa.int64()), *[(t, pa.int64()) for t in TYPES], ("low", pa.float64())]
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("reply", pa.binary()), *stats])

    def run(table: pa.Table) -> pa.Table:
        chunks, payloads = table.column("chunk").to_pylist(), [_opened(p) for p in table.column("payload").to_pylist()]
        h, w, n, c1 = (np.concatenate(x) for x in zip(*payloads, strict=True))
        order = np.lexsort((w, h))
        h, w = h[order], w[order]
        new = np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]))
        total = np.add.reduceat(n[order], np.flatnonzero(new))
        reply = np.empty(len(order), dtype="<i8")
        reply[order] = total[np.cumsum(new) - 1]
        at = np.cumsum([0, *[len(p[0]) for p in payloads]])
        k = len(chunks)
        out = {"chunk": chunks, "bucket": [table.column("bucket")[0].as_py()] * k, "reply": [_packed(reply[a:b]) for a, b in zip(at, at[1:], strict=False)]}
        replies = pa.table({f.name: pa.array(out[f.name], f.type) if f.name in out else pa.nulls(k, f.type) for f in schema}, schema=schema)
        seen = total > 0
        if not seen.any():
            return replies
        hs, c, p1 = h[new][seen], total[seen], discounted(c1[order][new][seen], d1) / bottom
        first = np.flatnonzero(np.append(True, hs[1:] != hs[:-1]))
        own = {"h": hs[first].view(np.int64), "n": np.add.reduceat(c, first), "low": np.add.reduceat(p1, first)} | {t: np.add.reduceat((c == r).astype(np.int64), first) for r, t in enumerate(TYPES, 1)}
        rows = pa.table({f.name: pa.array(own[f.name], f.type) if f.name in own else pa.nulls(len(first), f.type) for f in schema}, schema=schema)
        return pa.concat_tables([replies, rows])

    kinds = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.float64(): "double"}
    return sent.groupBy("bucket").applyInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def _scored(chunks: DataFrame, n_buckets: int, hot: float, total: int, known: int, d1: dict[int, float], bottom: float, unknown: float, d2: dict[int, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, lens, hashes, counts = _columns(batch, i)
                h, w, which, bucket = _bigrams(tokens, lens, hashes, counts, n_buckets, hot)
                replies = sorted(batch.column("replies")[i].as_py(), key=lambda r: r["bucket"])
                c2 = np.empty(len(h), dtype=np.int64)
                c2[np.argsort(bucket, kind="stable")] = np.concatenate([_unpacked(r["reply"], "<i8") for r in replies])
                below, alpha = np.asarray(batch.column("bottoms")[i].values), np.asarray(batch.column("alphas")[i].values)
                with np.errstate(divide="ignore", invalid="ignore"):
                    p1 = np.where(counts > 0, discounted(counts, d1) / bottom, unknown)
                    lp = np.where(c2 > 0, np.log10(discounted(c2, d2) / below[h]), np.log10(alpha[h]) + np.log10(p1[w]))
                at = np.cumsum(lens) - lens
                base = np.log10((counts + 0.5) / (total + 0.5 * (known + 1)))
                sums = lambda x: np.add.reduceat(x, at)  # noqa: B023, E731
                out = {
                    "doc_id": batch.column("doc_ids")[i].values,
                    "held_out": batch.column("held")[i].values,
                    "n_tokens": pa.array(lens, pa.int64()),
                    "n_known": pa.array(sums((counts > 0).astype(np.int64)[tokens]), pa.int64()),
                    "base_score": pa.array(sums(base[tokens]), pa.float64()),
                    "score": pa.array(sums(lp[which]), pa.float64()),
                }
                yield pa.RecordBatch.from_pydict(out)

    return chunks.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def _by_chunk(words: DataFrame, **values) -> DataFrame:
    """chunk and one array for each value, in the order of the chunk's words."""
    ordered = words.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pos", *[v.alias(k) for k, v in values.items()]))).alias("x"))
    return ordered.select("chunk", *[F.transform("x", lambda s: s[k]).alias(k) for k in values])  # noqa: B023


def score_bigrams(docs: DataFrame) -> DataFrame:
    importable(docs.sparkSession)
    chunks = cut(_chunks(docs), "lm-chunks")
    words = chunks.select("chunk", F.posexplode(F.arrays_zip("hashes", "train")).alias("pos", "x")).select("chunk", "pos", F.col("x.hashes").alias("w"), F.col("x.train").alias("train"))
    uni = cut(words.where("train > 0").groupBy("w").agg(F.sum("train").alias("c")), "lm-unigrams")
    total, known = uni.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    d1 = discounts(uni)
    freed = sum(r.n * r.c * (1 - d1[r.c]) for r in uni.where(F.col("c") <= K).groupBy("c").agg(F.count("*").alias("n")).collect())
    bottom = float(total if freed > 0 else total + 1)
    n_tokens = chunks.select(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    n_buckets, hot = max(1, -(-n_tokens // BUCKET_TOKENS)), max(1.0, total / HOT)

    counted = cut(_by_chunk(words.join(uni, "w", "left"), counts=F.coalesce("c", F.lit(0))), "lm-word-counts")
    full = chunks.select("chunk", "lens", "held", "tokens", "hashes").join(counted, "chunk")
    added = cut(_added(_sent(full, n_buckets, hot), d1, bottom), "lm-bigrams")
    hist = cut(added.where("h IS NOT NULL").groupBy("h").agg(*[F.sum(c).alias(c) for c in ("n", *TYPES, "low")]), "lm-histories")
    d2 = good_turing([x or 0 for x in hist.agg(*[F.sum(t) for t in TYPES]).first()])
    lost = sum(F.col(f"t{r}") * (r * (1 - d2[r])) for r in range(1, K + 1))
    below = F.when(lost > 0, F.col("n")).otherwise(F.col("n") + 1).cast("double")
    weights = hist.select(F.col("h").alias("w"), below.alias("below"), ((1 - (F.col("n") - lost) / below) / (1 - F.col("low"))).alias("alpha"))
    placed = cut(_by_chunk(words.join(weights, "w", "left"), bottoms=F.coalesce("below", F.lit(1.0)), alphas=F.coalesce("alpha", F.lit(1.0))), "lm-weights")
    replies = added.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "reply")).alias("replies"))
    rows = chunks.drop("train").join(counted, "chunk").join(placed, "chunk").join(replies, "chunk")
    scored = _scored(rows, n_buckets, hot, total, known, d1, bottom, freed / total if freed > 0 else 1 / (total + 1), d2)
    some = F.lit(total > 0)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.when(some, F.col("base_score")).alias("base_score"), F.when(some, F.col("score")).alias("score"))
