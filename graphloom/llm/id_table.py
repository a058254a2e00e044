"""A worker's memory of how strings encode: hashes of strings to runs of ids in one flat array."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longer strings (texts without spaces) are encoded each time they come and are not remembered.
LONGEST = 200
#: Bytes that the memory takes at most, but for what one lot adds: a million strings, about.
MOST_BYTES = 100_000_000
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def hashes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string (of LONGEST bytes at most): polynomials over its bytes, mixed with its length."""
    offsets = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", dtype=np.uint8)
    lens = np.diff(offsets)
    order = np.argsort(-lens, kind="stable")
    start, lens = offsets[:-1][order], lens[order]
    found = [lens.astype(np.uint64) + np.uint64(1) for _ in _BASES]
    upto = np.searchsorted(-lens, -np.arange(lens[0] if len(lens) else 0), side="left")  # strings with more than j bytes
    for j, n in enumerate(upto.tolist()):
        byte = data[start[:n] + j]
        for h, base in zip(found, _BASES, strict=True):
            h[:n] *= base
            h[:n] += byte
    out = []
    for h in found:
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        back = np.empty_like(h)
        back[order] = h
        out.append(back)
    return out[0], out[1]


class IdTable:
    """Ids of strings, learned from ``encode`` (strings to all their ids and the number of each).

    A string is known by 128 bits of hashes, in an open-addressing table. Beyond ``most`` bytes all is forgotten at once."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: type, most: int = MOST_BYTES):
        self.encode, self.dtype, self.most = encode, dtype, most
        self._clear()

    def _clear(self) -> None:
        self.n = 0
        self._slots(1 << 16)
        self.flat = np.zeros(1 << 16, dtype=self.dtype)
        self.ends = np.zeros(1 << 14, dtype=np.int64)  # string k has flat[ends[k]:ends[k + 1]]

    def _slots(self, n: int) -> None:
        self.keys, self.slot = (np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)), np.full(n, -1, dtype=np.int32)

    def _find(self, h: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The number of each string, -1 for unknown ones."""
        out, mask = np.full(len(h[0]), -1, dtype=np.int64), np.uint64(len(self.slot) - 1)
        live, at = np.arange(len(h[0])), (h[0] & mask).astype(np.int64)
        while len(live):
            k = self.slot[at]
            same = (k >= 0) & (self.keys[0][at] == h[0][live]) & (self.keys[1][at] == h[1][live])
            out[live[same]] = k[same]
            on = (k >= 0) & ~same
            live, at = live[on], (at[on] + 1) & int(mask)
        return out

    def _put(self, h: tuple[np.ndarray, np.ndarray], numbers: np.ndarray) -> None:
        """Slots for distinct strings that have none."""
        mask = len(self.slot) - 1
        live, at = np.arange(len(numbers)), (h[0] & np.uint64(mask)).astype(np.int64)
        while len(live):
            free = self.slot[at] < 0
            self.slot[at[free]] = numbers[live[free]]  # of several that want a slot, the last gets it
            won = free & (self.slot[at] == numbers[live])
            for keys, own in zip(self.keys, h, strict=True):
                keys[at[won]] = own[live[won]]
            live, at = live[~won], (at[~won] + 1) & mask

    def _learn(self, lasting: pa.Array, h: tuple[np.ndarray, np.ndarray], passing: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths in ``flat`` of both lists' ids; the passing ones' last until the next call."""
        flat, lens = self.encode([*lasting.to_pylist(), *passing.to_pylist()])
        n, used = len(lasting), int(self.ends[self.n])
        if used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(flat), dtype=self.dtype)])
        self.flat[used : used + len(flat)] = flat
        ends = used + np.cumsum(lens)
        if self.n + n + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends) + n, dtype=np.int64)])
        self.ends[self.n + 1 : self.n + 1 + n] = ends[:n]
        if 2 * (self.n + n) > len(self.slot):
            old, full = self.keys, np.flatnonzero(self.slot >= 0)
            numbers = self.slot[full]
            self._slots(1 << (2 * (self.n + n) - 1).bit_length())
            self._put((old[0][full], old[1][full]), numbers)
        self._put(h, np.arange(self.n, self.n + n, dtype=np.int32))
        self.n += n
        return ends - lens, lens

    def gather(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``strings``, one after the other, and how many each has. Each distinct string is looked up once."""
        if sum(x.nbytes for x in (*self.keys, self.slot, self.ends, self.flat)) > self.most:
            self._clear()
        coded = strings.dictionary_encode()
        own, index = coded.dictionary, np.asarray(coded.indices)
        short = np.asarray(pc.binary_length(own)) <= LONGEST
        h = hashes(own if short.all() else own.filter(pa.array(short)))
        which = np.full(len(own), -1, dtype=np.int64)
        which[short] = self._find(h)
        first, count = self.ends[which], self.ends[which + 1] - self.ends[which]
        if len(new := np.flatnonzero(which < 0)):
            new = new[np.asarray(pc.sort_indices(own.take(pa.array(new))))]
            lasting, passing = new[short[new]], new[~short[new]]
            rank = np.cumsum(short)[lasting] - 1  # among the short ones
            both = np.concatenate([lasting, passing])
            first[both], count[both] = self._learn(own.take(pa.array(lasting)), (h[0][rank], h[1][rank]), own.take(pa.array(passing)))
        lens = count[index]
        total = np.cumsum(lens)
        return self.flat[np.arange(total[-1] if len(total) else 0) + np.repeat(first[index] - (total - lens), lens)], lens

    def by_text(self, fast: pa.Array, slow: list[list[str]], is_slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, in order, and how many each has; ``fast``: lists of the strings of those that aren't ``is_slow``."""
        counts = np.concatenate([np.diff(np.asarray(fast.offsets)), np.array(list(map(len, slow)), dtype=np.int64)]).astype(np.int64)
        strings = fast.flatten()
        if slow:
            strings = pa.concat_arrays([strings, pa.array([s for x in slow for s in x], strings.type)])
        ids, lens = self.gather(strings)
        upto = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)
        if not slow:
            return ids, np.diff(upto)
        place = np.empty(len(is_slow), dtype=np.int64)  # of each text among fast and slow ones
        place[np.flatnonzero(~is_slow)] = np.arange(len(is_slow) - len(slow))
        place[np.flatnonzero(is_slow)] = np.arange(len(is_slow) - len(slow), len(is_slow))
        return np.concatenate([ids[upto[k] : upto[k + 1]] for k in place.tolist()]), np.diff(upto)[place]
