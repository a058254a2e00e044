"""SentencePiece encoding and decoding by a Viterbi pass that words with a common prefix share (op 3).

Texts are cut into marked words (a word with the space marks before it); no piece spans two of them.
The distinct ones are sorted, which lays them out as a depth-first walk of their trie: a word reuses the
forward states of the prefix it shares with the one before, and only its own suffix is worked out.

A forward state says which piece ends the best segmentation of a prefix. For unigram models that is the usual
maximum of score sums. For merge (BPE) models a maximum of scores would give other pieces than the
merges do, so the state follows the merges exactly: the encoding of a prefix ends in the one piece that is
compatible with the last piece of the shorter prefix before it (two pieces are compatible if merging their
joined characters gives back just these two). Either way a state depends on its prefix alone. Characters
outside the vocabulary fall back to bytes, or to the unknown piece.

A pure map: no shuffle; a worker's memory of words is bounded. Defined cases: a null or empty text has no ids
and decodes to an empty text; the mark's own character encodes as a space, as in the library; repeated rows and
null ids are encoded one by one; words of over 200 characters are not remembered, and a very long text is a lot of its
own; other columns are ignored by ``encode_table``. Where no piece holds a line break, words are cut at those too.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, lots
from .id_table import IdTable

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Pairs of pieces that a worker remembers; beyond that it starts anew.
CACHE = 1_000_000
#: Bytes of text that are encoded at once.
LOT = 4_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


class Pieces:
    """A vocabulary: pieces' scores and ids, and how the model normalizes."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], kind: int, unknown: int, byte_ids: list[int] | None):
        self.scores, self.ids, self.kind, self.unknown, self.byte_ids = scores, ids, kind, unknown, byte_ids
        self.longest = max(map(len, scores), default=1)
        self.penalty = min(scores.values(), default=0.0) - 10

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = {n: v for n, v in _fields(sp.serialized_model_proto()) if n in (2, 3)}
        trainer, normalizer = dict(_fields(spec.get(2, b""))), dict(_fields(spec.get(3, b"")))
        if normalizer.get(2) or not normalizer.get(3, 1) or normalizer.get(4, 1) or not normalizer.get(5, 1):
            raise ValueError("only models with the identity normalizer and a dummy prefix are supported")
        kind = trainer.get(3, UNIGRAM)
        if kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        names = {i: sp.id_to_piece(i) for i in plain}
        ids = {p: i for i, p in names.items()}
        raw = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        out = cls({p: sp.get_score(i) for p, i in ids.items()}, ids, kind, sp.unk_id(), raw if all(map(sp.is_byte, raw)) else None)
        out.bytes_of = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else names[i].replace(MARK, " ").encode() if i in names else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" for i in range(n)]
        return out


class Viterbi:
    """Encodes marked words; keeps the forward states of the last word's prefixes, so sorted ones share the most."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Merge neighbours, best score first, leftmost among equals, while they form a piece."""
        parts, scores = list(text), self.p.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return found

    def _step_bpe(self, word: str, end: int, last: list) -> None:
        scores = self.p.scores
        for start in range(max(0, end - self.p.longest), end):
            piece = word[start:end]
            if (piece in scores or start == end - 1) and (self.merged(piece) == [piece] if not start else self.compatible(last[start], piece)):
                last.append(piece)
                return
        raise AssertionError("a prefix has no last piece")

    def _step_unigram(self, word: str, end: int, last: list, total: list) -> None:
        best, found = None, None
        for start in range(max(0, end - self.p.longest), end):
            s = self.p.scores.get(piece := word[start:end], self.p.penalty if start == end - 1 else None)
            if s is not None and (best is None or total[start] + s > best):
                best, found = total[start] + s, piece
        last.append(found)
        total.append(best)

    def segment(self, words: list[str]) -> Iterator[list[str]]:
        """Pieces of each of ``words``."""
        before, last, total = "", [None], [0.0]
        bpe = self.p.kind == BPE
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], total[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                if bpe:
                    self._step_bpe(word, end, last)
                else:
                    self._step_unigram(word, end, last, total)
            before, out, end = word, [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            yield out[::-1]

    def ids(self, segment: list[str]) -> list[int]:
        out: list[int] = []
        for piece in segment:
            i = self.p.ids.get(piece)
            out += [i] if i is not None else [self.p.byte_ids[b] for b in piece.encode()] if self.p.byte_ids else [self.p.unknown]
        return out


_RUNS = re.compile(" +[^ ]*")


class Codec:
    def __init__(self, path: str):
        self.pieces = Pieces.load(path)
        v = Viterbi(self.pieces)
        # keys lack their first mark; those that have none begin with a line break
        mark = lambda k: ("" if self.cuts_lines and k[:1] == "\n" else MARK) + k.replace(" ", MARK)
        self.cuts_lines = not any("\n" in p for p in self.pieces.scores if len(p) > 1)

        def ids(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [v.ids(s) for s in v.segment([mark(k) for k in keys])]
            lens = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            return np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(lens.sum())), lens

        self.table = IdTable(ids, np.uint16 if len(self.pieces.bytes_of) <= 1 << 16 else np.uint32)

    def keys(self, text: str) -> list[str]:
        runs = [m[1:] for m in _RUNS.findall(" " + text)] if text else []
        if not self.cuts_lines:
            return runs
        return [k for r in runs for first, *rest in [r.split("\n")] for k in (first, *map("\n".__add__, rest))]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and the number of each."""
        texts = pc.replace_substring(texts, MARK, " ")
        strings = texts.to_pylist()
        is_slow = np.array([not t or "  " in t or t[0] == " " or t[-1] == " " for t in strings], dtype=bool)
        slow = [self.keys(strings[i]) for i in np.flatnonzero(is_slow).tolist()]
        fast = texts.filter(pa.array(~is_slow))
        if self.cuts_lines:
            # a space before a line break is a mark alone
            fast = pc.replace_substring(fast, "\n", " \n")
        return self.table.by_text(pc.split_pattern(fast, " "), slow, is_slow)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        b = self.pieces.bytes_of
        return b"".join([b[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace").removeprefix(" ")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_table(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids, decoded_sha256 (of the text decoded from the ids), round_trip (it is the text, marks as spaces)."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            for part in lots(batch, LOT):
                texts = part.column("text").to_pylist()
                flat, n = c.encode(part.column("text"))
                offsets = np.concatenate([[0], np.cumsum(n)])
                back = [c.decode(flat[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_ids": pa.array(n, pa.int64()),
                        "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32))),
                        "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                        "round_trip": pa.array([a == b.replace(MARK, " ") for a, b in zip(back, texts, strict=True)], pa.bool_()),
                    }
                )

    schema = "doc_id long, n_ids long, ids array<int>, decoded_sha256 string, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
