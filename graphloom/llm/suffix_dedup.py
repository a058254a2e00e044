"""Suffix-array dedup of 50-byte strings (op 9).

A byte goes if a 50-byte string over it also starts in a document with a smaller doc_id. Sorting every suffix of the
corpus would move each text fifty times, so the suffix arrays are built only where documents can agree:

1. Anchors. In each window of 50 bytes the 32-byte gram with the least hash is an anchor (winnowing). Equal
   windows have equal anchors, so a string that two documents share puts the same gram into both.
2. Only grams of two different texts go on. Anchors travel in lots, packed by bucket of the hash; a gram that a lot finds in
   two of its texts is settled there, and only its count goes to the bucket. Whole copies of a text need no grams: all but the
   first go.
3. Contexts. Around each remaining anchor the up to 68 bytes that a window over it can reach are cut out; equal
   contexts collapse, in each lot and again in each bucket, to one with its least doc_id.
4. A gram with one context is decided. The contexts of others are sorted: a bucket takes its grams in batches and builds a
   batch's suffix array by two-stage sorting: suffixes smaller than their successors are sorted directly, the others
   induced by bucket scans; runs of adjacent suffixes with a common prefix of 50 share a string, and its least
   doc_id decides. For a gram in very many places (``HOT``) each of its 50-byte windows is a context and
   travels by its own hash, so no bucket grows with one gram.
5. Decisions return to the lots, become intervals, and are cut out of the texts.

Hashes only choose what meets; strings are compared byte by byte, but for whole copies, which two 64-bit hashes tell.

Defined cases: null and empty texts have no bytes; texts under 50 bytes lose none; repeated rows (same id and text) get
the same result and don't remove each other, nor do different texts of one id; rows without id neither lose bytes nor make
others lose any; a very long text is a lot of its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, importable, lots

SPAN = 50
GRAM = 32
REACH = SPAN - GRAM
#: Anchors of a lot and of a bucket, contexts of a lot and of a bucket, contexts that are sorted together.
LOT_ANCHORS, BUCKET_ANCHORS = 400_000, 1_200_000
LOT_CONTEXTS, BUCKET_CONTEXTS, BATCH = 150_000, 200_000, 10_000
#: A gram with as many anchors is dealt out by windows; for huge inputs more, so that there are never over 5 million such grams.
HOT, HOT_SHARE = 20_000, 5_000_000


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over values[i:i + width] for every i; what lies beyond the end doesn't count."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        longer = out.copy()
        longer[:-step] = best(out[:-step], out[step:])
        out, have = longer, have + step
    return out


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[i:i + GRAM] for every i up to len(data) - GRAM."""
    h, n = _mix(data.astype(np.uint64) + np.uint64(1), np.zeros(1, dtype=np.uint64)), 1
    while n < GRAM:
        h, n = _mix(h[:-n], h[n:]), 2 * n
    return h


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of the texts laid end to end in ``data``, each up to ``ends``."""
    if len(data) < SPAN:  # so is each text
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = gram_hashes(data)
    least = _sliding(h, REACH + 1, np.minimum)[: len(data) - SPAN + 1]
    room = np.repeat(ends, np.diff(ends, prepend=0))[: len(least)] - np.arange(len(least))
    least = np.where(room >= SPAN, least, np.uint64(0))  # no window crosses texts
    # a gram is an anchor if it is the least of some window, thus of the one whose least is greatest
    padded = np.concatenate([np.zeros(REACH, dtype=np.uint64), least, np.zeros(len(h) - len(least), dtype=np.uint64)])
    greatest = _sliding(padded, REACH + 1, np.maximum)[: len(h)]
    at = np.flatnonzero((greatest == h) & (h != 0))
    return at, h[at]


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts], dtype=np.int64)


def two_stage(text: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Starts of all suffixes of ``text`` (uint8), ordered by at least their first ``depth`` bytes."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    at = np.arange(n)
    differs = np.append(text[:-1] != text[1:], True)
    upto = np.minimum.accumulate(np.where(differs, at, n)[::-1])[::-1]  # the last of each run of equal bytes
    small = np.append(text[:-1] < text[1:], False)[upto]  # smaller than the successor
    # directly: the suffixes that are smaller than their successors
    words = -(-depth // 8)
    padded = np.concatenate([text, np.zeros(8 * words + 8, dtype=np.uint8)]).astype(np.uint64)
    word = np.zeros(n + 8 * words, dtype=np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + len(word)]
    direct = np.flatnonzero(small)
    direct = direct[np.lexsort([word[direct + 8 * k] for k in range(words - 1, -1, -1)])]
    bounds = np.searchsorted(text[direct], np.arange(257))
    # by bucket scans: whoever precedes a suffix in place and isn't smaller than it follows in the order of these
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        parts = []
        while len(wave):
            parts.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
        parts.append(direct[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(parts)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > c]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            first, before = first[order], before[order]
            cuts = np.flatnonzero(np.diff(first)) + 1
            for part, symbol in zip(np.split(before, cuts), first[np.append(0, cuts)], strict=True):
                waiting[symbol].append(part)
        waiting[c] = []
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = SPAN) -> np.ndarray:
    """Bytes (``most`` at most) that each suffix of ``order`` shares with the one before it; 0 for the first."""
    padded = np.concatenate([text, np.zeros(most, dtype=np.uint8)])
    out = np.zeros(len(order), dtype=np.int64)
    live = np.arange(1, len(order))
    for k in range(most):
        live = live[padded[order[live] + k] == padded[order[live - 1] + k]]
        if not len(live):
            break
        out[live] = k + 1
    return out


def earlier(contexts: list[bytes], least: np.ndarray) -> list[list[int]]:
    """For each context, the offsets of its 50-byte strings that a context of a smaller ``least`` also has."""
    text, ends = _laid_out([c + b"\xff" for c in contexts])  # no UTF-8 text has this byte
    own = np.repeat(np.arange(len(contexts)), np.diff(ends, prepend=0))
    order = two_stage(text)
    order = order[ends[own[order]] - 1 - order >= SPAN]
    if not len(order):
        return [[] for _ in contexts]
    new = common_prefixes(text, order) < SPAN
    group = np.cumsum(new) - 1
    first = np.minimum.reduceat(least[own[order]], np.flatnonzero(new))
    hit = order[first[group] < least[own[order]]]
    out: list[list[int]] = [[] for _ in contexts]
    starts = np.concatenate([[0], ends[:-1]])
    for p in np.sort(hit):
        out[own[p]].append(int(p - starts[own[p]]))
    return out


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))


def _copies(rows: DataFrame) -> DataFrame:
    """doc_id, text_key: rows whose whole text, of a string's length at least, is that of a smaller doc_id."""
    keys = rows.select("doc_id", "text_key", F.xxhash64(F.lit(1), "text").alias("other"), F.length("text").alias("n")).where(F.col("n") >= SPAN)
    first = keys.groupBy("text_key", "other").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return keys.join(first, ["text_key", "other"]).where("doc_id > first").select("doc_id", "text_key").distinct()


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([a.nbytes for a in arrays], dtype="<u8").tobytes() + b"".join(a.tobytes() for a in arrays)


def _opened(payload: bytes, *kinds: str) -> list[np.ndarray]:
    at = np.cumsum([8 * len(kinds), *np.frombuffer(payload, "<u8", len(kinds)).tolist()])
    return [np.frombuffer(payload[a:b], k) for a, b, k in zip(at, at[1:], kinds, strict=False)]


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.zeros(0, dtype=np.int64)


_ENTRY = ("<u8", "<u4", "<u4", "<i8", "<i8", "<u8", "<u4")  # gram, document's number, position; documents' ids and text keys; grams settled in the lot, counts


def _anchor_lots(rows: DataFrame, n_buckets: int) -> DataFrame:
    """bucket, payload: a lot's anchors of a bucket; those that it has settled are a bucket of their own, ``n_buckets`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own_bucket = n_buckets + (TaskContext.get().partitionId() << 24)
        held: list[tuple[np.ndarray, ...]] = []
        size = docs = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal own_bucket, size, docs
            h, doc, pos, ids, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            size = docs = 0
            order = np.argsort(h, kind="stable")
            sorted_h, sorted_key = h[order], keys[doc[order]]
            first = _runs(sorted_h)
            several = np.minimum.reduceat(sorted_key, first) < np.maximum.reduceat(sorted_key, first)
            count = np.diff(first, append=len(h))
            settled = np.empty(len(h), dtype=bool)
            settled[order] = np.repeat(several, count)
            told, counts = sorted_h[first[several]], count[several].astype("<u4")

            def row(bucket: int, of: np.ndarray, tell: np.ndarray) -> pa.RecordBatch:
                used, number = np.unique(doc[of], return_inverse=True)
                payload = _pack(h[of], number.astype("<u4"), pos[of].astype("<u4"), ids[used], keys[used], told[tell], counts[tell])
                return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "payload": pa.array([payload], pa.binary())})

            none = np.zeros(0, dtype=np.int64)
            if settled.any():
                yield row(own_bucket, np.flatnonzero(settled), none)
            own_bucket += 1
            left = np.flatnonzero(~settled)
            to, tell_to = (h[left] % np.uint64(n_buckets)).astype(np.int64), (told % np.uint64(n_buckets)).astype(np.int64)
            left, tell = left[np.argsort(to, kind="stable")], np.argsort(tell_to, kind="stable")
            cuts, tell_cuts = (np.searchsorted(np.sort(x), np.arange(n_buckets + 1)) for x in (to, tell_to))
            for b in range(n_buckets):
                of, telling = left[cuts[b] : cuts[b + 1]], tell[tell_cuts[b] : tell_cuts[b + 1]]
                if len(of) or len(telling):
                    yield row(b, of, telling)

        for batch in batches:
            for part in lots(batch, 1 << 17):
                data, ends = _laid_out(part.column("text").to_pylist())
                at, h = anchors(data, ends)
                doc = np.searchsorted(ends, at, side="right")
                pos = at - np.concatenate([[0], ends])[doc]
                held.append((h, doc + docs, pos, *(np.asarray(part.column(c)) for c in ("doc_id", "text_key"))))
                size, docs = size + len(h), docs + part.num_rows
                if size >= LOT_ANCHORS:
                    yield from flush()
        if size:
            yield from flush()

    return rows.select("doc_id", "text_key", "text").mapInArrow(run, "bucket long, payload binary")


def _shared_anchors(lots_: DataFrame, n_buckets: int, hot: int) -> DataFrame:
    """group (of documents), n, found (packed): anchors whose gram is in two different texts; or ``hot``, a gram with so many."""
    schema = pa.schema([("group", pa.int64()), ("n", pa.int64()), ("found", pa.binary()), ("hot", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        parts = [_opened(p, *_ENTRY) for p in table.column("payload").to_pylist()]
        base = np.cumsum([0, *[len(p[3]) for p in parts]])
        doc = np.concatenate([p[1].astype(np.int64) + b for p, b in zip(parts, base, strict=False)])
        h, pos, ids, keys, told, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3, 4, 5, 6))
        frequent = np.zeros(0, dtype=np.uint64)
        if table.column("bucket")[0].as_py() < n_buckets:
            every = np.concatenate([h, told])
            order = np.argsort(every, kind="stable")
            first = _runs(every[order])
            low = np.concatenate([keys[doc], np.full(len(told), np.iinfo(np.int64).min)])[order]
            high = np.concatenate([keys[doc], np.full(len(told), np.iinfo(np.int64).max)])[order]
            shared = np.minimum.reduceat(low, first) < np.maximum.reduceat(high, first) if len(first) else np.zeros(0, dtype=bool)
            n = np.add.reduceat(np.concatenate([np.ones(len(h), dtype=np.int64), counts])[order], first) if len(first) else first
            frequent = every[order][first][n >= hot]
            keep = np.empty(len(every), dtype=bool)
            keep[order] = np.repeat(shared, np.diff(first, append=len(every)))
            of = np.flatnonzero(keep[: len(h)])
            h, doc, pos = h[of], doc[of], pos[of]
        group = (_mix(ids.view(np.uint64), keys.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)[doc]
        order = np.argsort(group, kind="stable")
        h, doc, pos, group = h[order], doc[order], pos[order], group[order]
        first = _runs(group)
        cuts, found = np.append(first, len(group)).tolist(), []
        for a, b in zip(cuts, cuts[1:], strict=False):
            used, number = np.unique(doc[a:b], return_inverse=True)
            found.append(_pack(h[a:b], number.astype("<u4"), pos[a:b], ids[used], keys[used]))
        none = pa.nulls(len(frequent), pa.int64())
        groups = pa.table({"group": pa.array(group[first]), "n": pa.array(np.diff(cuts), pa.int64()), "found": pa.array(found, pa.binary()), "hot": pa.nulls(len(found), pa.int64())}, schema=schema)
        return pa.concat_tables([groups, pa.table({"group": none, "n": none, "found": pa.nulls(len(frequent), pa.binary()), "hot": pa.array(frequent.view(np.int64))}, schema=schema)])

    return lots_.groupBy("bucket").applyInArrow(run, "group long, n long, found binary, hot long")


def _by_document(shared: DataFrame) -> DataFrame:
    """doc_id, text_key, at (packed grams and positions)."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_opened(p, *_ENTRY[:5]) for p in table.column("found").to_pylist()]
        base = np.cumsum([0, *[len(p[3]) for p in parts]])
        doc = np.concatenate([p[1].astype(np.int64) + b for p, b in zip(parts, base, strict=False)])
        h, pos, ids, keys = (np.concatenate([p[i] for p in parts]) for i in (0, 2, 3, 4))
        ids, keys = ids[doc], keys[doc]
        order = np.lexsort((pos, keys, ids))
        h, pos, ids, keys = h[order], pos[order], ids[order], keys[order]
        new = np.append(True, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))
        once = new | np.append(True, pos[1:] != pos[:-1])  # repeated rows say the same
        h, pos, ids, keys, first = h[once], pos[once], ids[once], keys[once], np.flatnonzero(new[once])
        cuts = np.append(first, len(h)).tolist()
        at = [_pack(h[a:b], pos[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return pa.table({"doc_id": pa.array(ids[first]), "text_key": pa.array(keys[first]), "at": pa.array(at, pa.binary())})

    return shared.groupBy("group").applyInArrow(run, "doc_id long, text_key long, at binary")


def _context_lots(rows: DataFrame, n_buckets: int, hot: np.ndarray) -> DataFrame:
    """lot, doc_ids, text_keys, places (packed: document's number, start, length, context's number), sent (bucket, payload: contexts).

    ``rows``: doc_id, text_key, text, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lot = TaskContext.get().partitionId() << 24
        docs: list[tuple[int, int]] = []
        held: list[tuple[np.ndarray, ...]] = []
        contexts: list[tuple[int, bytes]] = []

        def flush() -> pa.RecordBatch:
            nonlocal lot
            number: dict[tuple[int, bytes], int] = {}
            which = np.fromiter((number.setdefault(c, len(number)) for c in contexts), dtype=np.int64, count=len(contexts))
            doc, start, length = (np.concatenate(x) for x in zip(*held, strict=True))
            ids = np.array([d for d, _ in docs], dtype=np.int64)
            least = np.full(len(number), np.iinfo(np.int64).max)
            np.minimum.at(least, which, ids[doc])
            kinds = list(number)
            h = np.fromiter((k[0] for k in kinds), dtype=np.uint64, count=len(kinds))
            to = (h % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            sent, cuts = [], np.append(_runs(to[order]), len(order)).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                of = order[a:b]
                ctx = [kinds[k][1] for k in of.tolist()]
                sent.append({"bucket": int(to[of[0]]), "payload": _pack(h[of], np.array(list(map(len, ctx)), dtype="<u1"), least[of], np.frombuffer(b"".join(ctx), dtype=np.uint8))})
            out = {
                "lot": pa.array([lot], pa.int64()),
                "doc_ids": pa.array([ids.tolist()], pa.list_(pa.int64())),
                "text_keys": pa.array([[k for _, k in docs]], pa.list_(pa.int64())),
                "places": pa.array([_pack(doc.astype("<u4"), start.astype("<u4"), length.astype("<u1"), rank[which].astype("<u4"))], pa.binary()),
                "sent": pa.array([sent], pa.list_(pa.struct([("bucket", pa.int64()), ("payload", pa.binary())]))),
            }
            lot += 1
            for x in (docs, held, contexts):
                x.clear()
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                h, pos = _opened(batch.column("at")[i].as_py(), "<u8", "<u4")
                pos = pos.astype(np.int64)
                start, end = np.maximum(pos - REACH, 0), np.minimum(pos + SPAN, len(text))
                some = (end - start >= SPAN) & ~np.isin(h, hot)
                cold = (h[some], start[some], end[some])
                windows = [np.arange(a, b - SPAN + 1) for a, b in zip(start[~some].tolist(), end[~some].tolist(), strict=True) if b - a >= SPAN]
                warm = np.unique(np.concatenate(windows)) if windows else np.zeros(0, dtype=np.int64)
                contexts += [(g, text[a:b]) for g, a, b in zip(*(x.tolist() for x in cold), strict=True)]
                contexts += [(xxh64(w, 9), w) for a in warm.tolist() for w in [text[a : a + SPAN]]]
                start = np.concatenate([cold[1], warm])
                held.append((np.full(len(start), len(docs)), start, np.concatenate([cold[2], warm + SPAN]) - start))
                docs.append((batch.column("doc_id")[i].as_py(), batch.column("text_key")[i].as_py()))
                if len(contexts) >= LOT_CONTEXTS:
                    yield flush()
        if docs:
            yield flush()

    from xxhash import xxh64_intdigest as xxh64

    return rows.mapInArrow(run, "lot long, doc_ids array<long>, text_keys array<long>, places binary, sent array<struct<bucket:long,payload:binary>>")


def _decided(sent: DataFrame) -> DataFrame:
    """lot, bucket, reply (packed, for the contexts in the order sent): the smallest doc_id that has the context, how many of its strings start in a smaller one still, and their offsets."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_opened(p, "<u8", "<u1", "<i8", "<u1") for p in table.column("payload").to_pylist()]
        number: dict[tuple[int, bytes], int] = {}
        which = []
        for h, length, _, data in parts:
            ends = np.cumsum(length.astype(np.int64))
            data = data.tobytes()
            which.append([number.setdefault((g, data[a:b]), len(number)) for g, a, b in zip(h.tolist(), (ends - length).tolist(), ends.tolist(), strict=True)])
        least = np.full(len(number), np.iinfo(np.int64).max)
        np.minimum.at(least, np.concatenate(which).astype(np.int64), np.concatenate([p[2] for p in parts]))
        kinds = list(number)
        grams = np.fromiter((k[0] for k in kinds), dtype=np.uint64, count=len(kinds))
        order = np.argsort(grams, kind="stable")
        first = _runs(grams[order])
        several = np.diff(first, append=len(order)) > 1
        early: list[list[int]] = [[]] * len(kinds)
        batch: list[int] = []

        def sort_batch() -> None:
            for k, e in zip(batch, earlier([kinds[k][1] for k in batch], least[batch]), strict=True):
                early[k] = e
            batch.clear()

        for a, b in zip(first[several].tolist(), np.append(first, len(order))[1:][several].tolist(), strict=True):
            if batch and len(batch) + b - a > BATCH:
                sort_batch()
            batch += order[a:b].tolist()
        if batch:
            sort_batch()
        replies = [_pack(least[w], np.array([len(early[k]) for k in w], dtype="<u1"), np.array([i for k in w for i in early[k]], dtype="<u1")) for w in which]
        return pa.table({"lot": table.column("lot"), "bucket": table.column("bucket"), "reply": pa.array(replies, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(run, "lot long, bucket long, reply binary")


def _intervals(decided: DataFrame) -> DataFrame:
    """doc_id, text_key, spans (packed firsts and ends, merged); ``decided``: lot, doc_ids, text_keys, places, replies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.array(r["doc_ids"], dtype=np.int64)
                doc, start, length, kind = (x.astype(np.int64) for x in _opened(r["places"], "<u4", "<u4", "<u1", "<u4"))
                replies = [_opened(x["reply"], "<i8", "<u1", "<u1") for x in sorted(r["replies"], key=lambda x: x["bucket"])]
                least, n, offsets = (np.concatenate(x) for x in zip(*replies, strict=True))
                n, offsets = n.astype(np.int64), offsets.astype(np.int64)
                later = ids[doc] > least[kind]
                own = np.where(later, 0, n[kind])  # strings of contexts that have no smaller document
                which = np.repeat(np.arange(len(doc)), own)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(own) - own, own)
                begin = offsets[(np.cumsum(n) - n)[kind[which]] + nth] + start[which]
                d, a = np.concatenate([doc[later], doc[which]]), np.concatenate([start[later], begin])
                b = np.concatenate([start[later] + length[later], begin + SPAN])
                order = np.lexsort((a, d))
                d, a, b = d[order], a[order], b[order]
                if not len(d):
                    continue
                # documents side by side, so that one running maximum serves all
                room = int(b.max()) + 1
                upto = np.maximum.accumulate(d * room + b)
                new = np.append(True, d[1:] * room + a[1:] > upto[:-1])
                firsts = np.flatnonzero(new)
                a, d, b = a[firsts], d[firsts], (upto - d * room)[np.append(firsts[1:], len(new)) - 1]
                of = np.append(_runs(d), len(d)).tolist()
                spans = [_pack(a[i:j], b[i:j]) for i, j in zip(of, of[1:], strict=False)]
                keys = np.array(r["text_keys"], dtype=np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[d[of[:-1]]]), "text_key": pa.array(keys[d[of[:-1]]]), "spans": pa.array(spans, pa.binary())})

    return decided.mapInArrow(run, "doc_id long, text_key long, spans binary")


def _cut_out(text: bytes, spans: list[bytes]) -> tuple[int, int, str]:
    """n_removed, n_spans, kept_sha256."""
    if not spans:
        return 0, 0, hashlib.sha256(text).hexdigest()
    edge = np.zeros(len(text) + 1, dtype=np.int32)
    for s in spans:
        a, b = _opened(s, "<i8", "<i8")
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), runs, hashlib.sha256(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()).hexdigest()


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    importable(docs.sparkSession)
    rows = _rows(docs)
    with_id = rows.where("doc_id IS NOT NULL")
    copies = cut(_copies(with_id), "suffix-copies")
    # a text of n bytes has two anchors in each 20 bytes, about
    about = 2 * (with_id.agg(F.sum(F.length("text"))).first()[0] or 0) // (REACH + 2)
    n_buckets = max(1, -(-about // BUCKET_ANCHORS))
    shared = cut(_shared_anchors(_anchor_lots(with_id, n_buckets), n_buckets, max(hot, about // HOT_SHARE)), "suffix-anchors", "zstd")
    frequent = np.array([r.hot for r in shared.where("hot IS NOT NULL").select("hot").distinct().collect()], dtype=np.int64).view(np.uint64)
    n_shared = shared.agg(F.sum("n")).first()[0] or 0
    own = _by_document(shared.where("hot IS NULL"))
    about_text = with_id.join(copies, ["doc_id", "text_key"], "left_anti").join(own, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "at")
    placed = cut(_context_lots(about_text, max(1, n_shared // BUCKET_CONTEXTS), frequent), "suffix-contexts", "zstd")
    discard(shared)
    sent = placed.select("lot", F.explode("sent").alias("s")).select("lot", "s.*")
    replies = cut(_decided(sent), "suffix-decided", "zstd").groupBy("lot").agg(F.collect_list(F.struct("bucket", "reply")).alias("replies"))
    spans = _intervals(placed.drop("sent").join(replies, "lot")).groupBy("doc_id", "text_key").agg(F.collect_list("spans").alias("spans"))
    spans = cut(spans, "suffix-spans")
    discard(placed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            whole = [_pack(np.array([0]), np.array([len(t)])) if c else None for t, c in zip(texts, batch.column("copy").to_pylist(), strict=True)]
            done = [_cut_out(t, [w] if w else x or []) for t, w, x in zip(texts, whole, batch.column("spans").to_pylist(), strict=True)]
            removed, runs, sha = zip(*done, strict=True) if done else ((), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(map(len, texts), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    none = F.lit(None).cast("array<binary>")
    verdicts = spans.withColumn("copy", F.lit(False)).union(copies.select("doc_id", "text_key", none.alias("spans"), F.lit(True).alias("copy")))
    joined = rows.join(verdicts, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
