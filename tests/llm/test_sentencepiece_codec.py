"""Shared-prefix encoding against the sentencepiece library, and unigram models against all segmentations."""

import itertools
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import sentencepiece_codec as codec

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from(list("aaabeeintr   \n\té漢▁<s>0xA")) | st.characters(codec="utf-8"), max_size=60))
def test_encode_and_decode_as_the_library(text):
    c = codec.codec(PATH)
    ids, n = c.encode(pa.array([text]))
    assert ids.tolist() == LIBRARY.encode(text)
    assert c.decode(ids) == LIBRARY.decode(ids.tolist())


def test_documents_as_the_library(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    ids, n = codec.codec(PATH).encode(pa.array(texts))
    want = LIBRARY.encode(texts, num_threads=1)
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_random_letters_as_the_library():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(1, 14))) for _ in range(20_000)]
    ids, n = codec.codec(PATH).encode(pa.array(words))
    want = LIBRARY.encode(words, num_threads=1)
    assert ids.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize("seed", range(5))
def test_unigram_is_the_best_segmentation(seed):
    rnd = random.Random(seed)
    scores = {"".join(c): -rnd.random() * 5 for n in (1, 2, 3) for c in itertools.product("ab", repeat=n) if n == 1 or rnd.random() < 0.6}
    p = codec.Pieces(scores, {s: i for i, s in enumerate(scores)}, codec.UNIGRAM, 0, None)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 9))) for _ in range(40)})

    def best(w):
        return max((scores[w[:k]] + best(w[k:]) for k in (1, 2, 3) if w[:k] in scores and len(w) >= k), default=0.0) if w else 0.0

    for w, s in zip(words, codec.Viterbi(p).segment(words), strict=True):
        assert "".join(s) == w and abs(sum(scores[x] for x in s) - best(w)) < 1e-9


def test_table(docs, rows, empty):
    got = sorted([(r.doc_id, r.ids, r.round_trip) for r in codec.encode_table(docs, PATH).collect()], key=repr)
    assert got == sorted([(r[0], LIBRARY.encode(r[1] or ""), True) for r in rows], key=repr)
    assert codec.encode_table(empty, PATH).count() == 0
