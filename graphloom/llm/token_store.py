"""Token ids in patched frame-of-reference blocks (op 5).

A store is a Parquet table of chunks in any file system that Spark writes to. Documents are ordered by id: a
range partition is a segment, and a segment is a run of chunks. A chunk's payload:

    magic "GLP1", n_ids u32, n_blocks u32, minima u32[n_blocks], widths u8[n_blocks], n_exceptions u16[n_blocks],
    starts u32[n_blocks] (the block index: offsets into the body), body

and each block of 256 ids in the body: ids minus the block's minimum, the low ``width`` bits of each packed;
then, for the values that are wider, positions u8[n_exceptions] and high parts u32[n_exceptions]. ``width`` is
that of the block's 90th percentile. The last block is padded with its minimum. A chunk also lists its
documents' ids and lengths, and the least and the largest id: a document is found by the statistics that Parquet keeps
of those two and decoded from its blocks alone.

Encoding uses the tokenizers library on distinct pieces: the vocabulary's pre-tokenizer always starts a token at
a space before a non-space character, and at one line break or each of two, so pieces encode alone as they do in
the text. Texts with a special token's string, or for other pre-tokenizers, are encoded whole.

Scale: texts are shuffled once, by range; the rest are sums over segments. A worker's piece memory is bounded in
bytes, and strings of over 200 characters don't enter it. Defined cases: a null or empty text is the end id alone; rows
of equal id keep an arbitrary order among each other; null ids come first; other columns are ignored; a very long text
is a lot and a chunk of its own; an empty table makes an empty store.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, lots, scratch
from .id_table import IdTable

MAGIC = b"GLP1"
BLOCK = 256
PERCENTILE = 90
CHUNK_IDS = 1 << 19


def _packed(rows: np.ndarray, width: int) -> np.ndarray:
    """(n, 256) unsigned values -> (n, 32 * width) bytes of their low ``width`` bits."""
    if not width:
        return np.zeros((len(rows), 0), dtype=np.uint8)
    bits = (rows[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")


def _unpacked(data: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(data), BLOCK), dtype=np.uint32)
    bits = np.unpackbits(data, axis=1, bitorder="little").reshape(len(data), BLOCK, width)
    out = np.zeros((len(data), BLOCK), dtype=np.uint32)
    for b in range(width):
        out |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
    return out


def pack(ids: np.ndarray) -> bytes:
    """A chunk's payload for unsigned 32-bit ``ids``."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    n = -(-len(ids) // BLOCK)
    full = np.zeros(n * BLOCK, dtype=np.uint32)
    full[: len(ids)] = ids
    if n and len(ids) < len(full):
        full[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    rows = full.reshape(n, BLOCK)
    low = rows.min(axis=1) if n else np.zeros(0, np.uint32)
    rows = rows - low[:, None]
    at = BLOCK * PERCENTILE // 100
    typical = np.partition(rows, at, axis=1)[:, at] if n else np.zeros(0, np.uint32)
    widths = np.frexp(typical.astype(np.float64))[1].astype(np.uint8)
    over = (rows >> widths[:, None].astype(np.uint64)).astype(np.uint32)
    wide = over > 0
    n_exc = wide.sum(axis=1)
    sizes = 32 * widths.astype(np.int64) + 5 * n_exc
    starts = np.cumsum(sizes) - sizes
    body = np.zeros(int(sizes.sum()), dtype=np.uint8)
    for w in np.unique(widths):
        of = np.flatnonzero(widths == w)
        body[starts[of][:, None] + np.arange(32 * int(w))] = _packed(rows[of], int(w))
    block, pos = np.nonzero(wide)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
    lists = starts[block] + 32 * widths[block].astype(np.int64)
    body[lists + nth] = pos
    highs = over[block, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
    body[(lists + n_exc[block] + 4 * nth)[:, None] + np.arange(4)] = highs
    head = np.array([len(ids), n], dtype="<u4").tobytes() + low.astype("<u4").tobytes() + widths.tobytes() + n_exc.astype("<u2").tobytes() + starts.astype("<u4").tobytes()
    return MAGIC + head + body.tobytes()


def unpack(payload: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``last`` (exclusive; default: all) of a payload; only their blocks are decoded."""
    if payload[:4] != MAGIC:
        raise ValueError("not a chunk of token ids")
    n_ids, n = np.frombuffer(payload, "<u4", 2, 4)
    n, at = int(n), 12
    last = int(n_ids) if last is None else min(last, int(n_ids))
    low = np.frombuffer(payload, "<u4", n, at)
    widths = np.frombuffer(payload, np.uint8, n, at + 4 * n)
    n_exc = np.frombuffer(payload, "<u2", n, at + 5 * n).astype(np.int64)
    starts = np.frombuffer(payload, "<u4", n, at + 7 * n).astype(np.int64)
    body = np.frombuffer(payload, np.uint8, offset=at + 11 * n)
    a, b = first // BLOCK, -(-last // BLOCK)
    if a >= b:
        return np.zeros(0, dtype=np.uint32)
    low, widths, n_exc, starts = low[a:b], widths[a:b], n_exc[a:b], starts[a:b]
    rows = np.empty((b - a, BLOCK), dtype=np.uint32)
    for w in np.unique(widths):
        of = np.flatnonzero(widths == w)
        rows[of] = _unpacked(body[starts[of][:, None] + np.arange(32 * int(w))], int(w))
    block = np.repeat(np.arange(b - a), n_exc)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
    lists = starts[block] + 32 * widths[block].astype(np.int64)
    pos = body[lists + nth]
    highs = np.ascontiguousarray(body[(lists + n_exc[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    rows[block, pos] |= highs << widths[block].astype(np.uint32)
    rows += low[:, None]
    return rows.reshape(-1)[first - a * BLOCK : last - a * BLOCK]


_W = r"\x{9}-\x{d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Runs of white space that aren't cut at each space and line break: all but one space, one line break or two.
_JOINED = rf"[ {_W}]\z|\n\n\n| [ {_W}]|[{_W.replace('x{9}', 'x{b}')}\t][ {_W}]|\n[{_W.replace('x{9}', 'x{b}')}\t ]"
_SPLIT = re.compile(r" (?=\S)")
#: Bytes of text that are encoded at once.
LOT = 4_000_000


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        added = [re.escape(t["content"]) for t in spec.get("added_tokens", ())]
        self.special = re.compile("|".join(added)) if added else None
        self.table = IdTable(self._pieces, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        # the characters that stand for bytes in the vocabulary: the printable ones for themselves, the others from 256 on
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        self.chars = dict(zip([*own, *(b for b in range(256) if b not in own)], map(chr, [*own, *range(256, 512 - len(own))]), strict=True))

    def _word(self, mapped: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(mapped)]

    def _pieces(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers. A key is a piece without its space; a piece that has none begins with a line break, or gets a space as its mark.

        The pre-tokenizer leaves words of letters whole and cuts them from a line break before or one sign after, so
        these go to the library's model as they are; whatever else goes through all of the library."""
        space, found, others = self.chars[32], [None] * len(keys), []
        line, signs = self._word(self.chars[10]), {s: self._word(s) for s in ".,"}
        model = self.tokenizer.model.tokenize
        for i, k in enumerate(keys):
            if k.isalpha() and k.isascii():
                found[i] = [t.id for t in model(space + k)]
                continue
            led, tail = k[:1] == "\n", signs.get(k[-1:])
            body = k[led : len(k) - (tail is not None)]
            if body.isalpha() and max(body) < "ɐ":
                mapped = body if body.isascii() else "".join([self.chars[b] for b in body.encode()])
                ids = [t.id for t in model(mapped if led else space + mapped)]
                found[i] = [*(line if led else ()), *ids, *(tail or ())]
            else:
                others.append(i)
        rest = [k[1:] if k[:1] == " " else k if k[:1] == "\n" else " " + k for k in (keys[i] for i in others)]
        for i, e in zip(others, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            found[i] = e.ids
        lens = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(lens.sum())), lens

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and the number of each."""
        strings = texts.to_pylist()
        whole = [i for i, t in enumerate(strings) if not self.by_piece or (self.special and self.special.search(t))]
        is_slow = pc.match_substring_regex(texts, _JOINED).to_numpy(zero_copy_only=False).astype(bool)
        is_slow[whole] = True
        # where every space and line break starts a piece, Arrow cuts
        fast = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~is_slow)), "\n", " \n"), " ")
        offsets, keys = np.asarray(fast.offsets), fast.flatten()
        first = np.zeros(len(keys), dtype=bool)
        first[offsets[:-1]] = True  # a split text has one piece at least
        marked = pc.binary_join_element_wise("", keys.filter(pa.array(first)), " ")
        fast = pa.ListArray.from_arrays(fast.offsets, pc.replace_with_mask(keys, pa.array(first), marked)) if len(keys) else fast
        skip = set(whole)
        slow = [[] if i in skip else self.keys(strings[i]) for i in np.flatnonzero(is_slow).tolist()]
        out, counts = self.table.by_text(fast, slow, is_slow)
        if whole:
            rows = np.split(out, np.cumsum(counts)[:-1])
            for i in whole:
                rows[i] = np.array(self.tokenizer.encode(strings[i], add_special_tokens=False).ids, dtype=out.dtype)
            out, counts = np.concatenate(rows), np.array([len(r) for r in rows], dtype=np.int64)
        return out, counts

    @staticmethod
    def keys(text: str) -> list[str]:
        p = _SPLIT.split(text)
        return [" " + p[0], *p[1:]]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


CHUNK_SCHEMA = "segment int, chunk int, first_id long, last_id long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def write(docs: DataFrame, vocabulary: str, path: str, end_id: int | None = 2, mode: str = "errorifexists") -> None:
    """Write the store of all texts of ``docs`` (doc_id, text) to ``path``, in ascending doc_id order."""
    importable(docs.sparkSession)
    ends = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, segment, chunk = encoder(vocabulary), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal chunk
            flat = np.concatenate(ids)
            given = [d for d in doc_ids if d is not None]
            row = {"segment": [segment], "chunk": [chunk], "first_id": [min(given, default=None)], "last_id": [max(given, default=None)], "n_ids": [len(flat)], "doc_ids": [list(doc_ids)], "lengths": [np.concatenate(counts).tolist()], "payload": [pack(flat)]}
            chunk += 1
            for x in (doc_ids, counts, ids):
                x.clear()
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("segment", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())]))

        for batch in batches:
            for part in lots(batch, LOT):
                flat, n = enc.encode(part.column("text"))
                if ends:
                    flat, n = np.insert(flat, np.cumsum(n), ends[0]), n + 1
                doc_ids += part.column("doc_id").to_pylist()
                counts.append(n)
                ids.append(flat)
                if sum(map(len, ids)) >= CHUNK_IDS:
                    yield flush()
        if doc_ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(run, CHUNK_SCHEMA).write.mode(mode).option("compression", "none").parquet(path)


def read(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, decoded from the store at ``path``."""
    importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                data = memoryview(unpack(r["payload"]).astype("<u4").tobytes())
                ends = np.cumsum(r["lengths"])
                starts = ends - r["lengths"]
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_pydict({"segment": pa.array([r["segment"]] * n, pa.int32()), "chunk": pa.array([r["chunk"]] * n, pa.int32()), "doc_id": pa.array(r["doc_ids"], pa.int64()), "local": pa.array(starts, pa.int64()), "n_tokens": pa.array(r["lengths"], pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    docs = chunks.mapInArrow(run, "segment int, chunk int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # first id of each chunk: prefix sums over segments, then inside each
    sizes = chunks.select("segment", "chunk", "n_ids")
    segments = sizes.groupBy("segment").agg(F.sum("n_ids").alias("n"))
    before = segments.selectExpr("segment", "sum(n) OVER (ORDER BY segment) - n AS before_segment")
    within = sizes.selectExpr("segment", "chunk", "sum(n_ids) OVER (PARTITION BY segment ORDER BY chunk) - n_ids AS before_chunk")
    at = within.join(before, "segment").select("segment", "chunk", (F.col("before_segment") + F.col("before_chunk")).alias("before"))
    return docs.join(at, ["segment", "chunk"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark, path: str, doc_id: int) -> list[list[int]]:
    """The ids of one document (of each row that has that id): its chunks by filter, its blocks by the index."""
    rows = spark.read.schema(CHUNK_SCHEMA).parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id) & F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    out = []
    for r in rows.collect():
        ends = np.cumsum(r["lengths"])
        out += [unpack(bytes(r["payload"]), int(e) - n, int(e)).tolist() for d, e, n in zip(r["doc_ids"], ends, r["lengths"], strict=True) if d == doc_id]
    return out


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    path = scratch(docs.sparkSession, "token-store")
    write(docs, vocabulary, path, end_id)
    return read(docs.sparkSession, path)
