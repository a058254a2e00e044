"""The token store against the tokenizers library, and its blocks by round trip."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from graphloom.llm import token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab  \n\t'sé漢.1\x1c  İ")) | st.characters(codec="utf-8"), max_size=40), max_size=6))
def test_pieces_encode_as_the_whole(texts):
    enc = token_store.encoder(PATH)
    lib = Tokenizer.from_file(PATH) if not hasattr(test_pieces_encode_as_the_whole, "lib") else test_pieces_encode_as_the_whole.lib
    test_pieces_encode_as_the_whole.lib = lib
    ids, n = enc.encode(pa.array(texts, pa.string()))
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [x for w in want for x in w]


def test_special_strings(library):
    texts = ["a <|endoftext|> b", "plain", "<|endoftext|>", "", "it's  we'll"]
    ids, n = token_store.encoder(PATH).encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [x for t in texts for x in library.encode(t, add_special_tokens=False).ids]


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 50_000, 2**32])
def test_blocks_round_trip(n, high):
    rnd = np.random.default_rng(n + high)
    ids = np.where(rnd.random(n) < 0.05, rnd.integers(0, high, n), rnd.integers(0, max(1, high // 50), n)).astype(np.uint32)
    data = token_store.pack(ids)
    assert (token_store.unpack(data) == ids).all() and len(token_store.unpack(data)) == n
    for a, b in [(0, 1), (n // 3, n // 2), (n - 1, n + 5)]:
        assert token_store.unpack(data, max(a, 0), b).tolist() == ids[max(a, 0) : b].tolist()


def test_outliers_become_exceptions():
    ids = np.full(256, 7, dtype=np.uint32)
    ids[5] = 2**31
    assert len(token_store.pack(ids)) < 64


def test_store(docs, rows, empty, library, tmp_path):
    texts = [(r[0], r[1] or "") for r in rows]
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, (_, t) in enumerate(texts)}
    crc = lambda x: zlib.crc32(np.array(x, dtype="<u4").tobytes())
    got = token_store.round_trip(docs, PATH).collect()
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=repr) == sorted([(d, len(ids[i]), crc(ids[i])) for i, (d, _) in enumerate(texts)], key=repr)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    assert token_store.round_trip(empty, PATH).count() == 0
    token_store.write(docs, PATH, str(tmp_path / "s"))
    assert token_store.lookup(docs.sparkSession, str(tmp_path / "s"), rows[9][0]) == [ids[9]]


def test_long_texts_and_forgetting(library, monkeypatch):
    enc = token_store.Encoder(PATH)
    enc.table.most = 2_000_000
    rnd = np.random.default_rng(3)
    letters = lambda n: "".join(map(chr, rnd.integers(97, 123, n)))
    texts = [letters(100_000), " ".join(letters(5) for _ in range(200_000)), "漢字" * 20_000, *[f"again and again {letters(6)}" for _ in range(300)]]
    for _ in range(2):
        ids, n = enc.encode(pa.array(texts))
        assert ids.tolist() == [x for t in texts for x in library.encode(t, add_special_tokens=False).ids] and len(n) == len(texts)
    enc.encode(pa.array(["x y"]))
    assert enc.table.n == 2
