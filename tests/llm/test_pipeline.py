"""The pipeline against the stages' plain versions, on whole small tables."""

import public_tokenizers
import sentencepiece

import corpus_pipeline
from graphloom.llm.common import cut
from graphloom.llm.quality_rules import SYMBOLS

from .test_decontaminate import brute
from .test_near_copies import brute_kept
from .test_per_document import WORD, brute_lines, brute_quality


def passes(text):
    n_words, word_chars, n_symbols, n_dup, n_repeat = brute_quality(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    share = lambda n: 100 * n / max(1, len(lines))
    return not (
        n_words < 50
        or 100 * n_repeat > 50 * n_words
        or 4 * sum(c in SYMBOLS for c in text) > n_words
        or not 2 * n_words <= word_chars <= 20 * n_words
        or (n_dup > 2 and share(n_dup) > 30)
        or 5 * sum(c in "0123456789" for c in text) > word_chars
        or share(sum(x.lstrip(" \t")[:1] in ("-", "*", "•") for x in lines)) > 90
        or share(sum(x.endswith(("...", "…")) for x in lines)) > 30
    )


def plain(docs, items):
    """(doc_id, text) left after the first four stages."""
    docs = [(d, t) for d, t in docs if passes(t)]
    docs = [(r[0], r[4]) for r in brute_lines(docs)]
    kept = brute_kept(docs)
    docs = [(d, t) for d, t in docs if d in kept]
    bad = {d for d, _ in brute(docs, items)}
    return [(d, t) for d, t in docs if d not in bad]


def test_run_matches_plain_python(spark, sf_dir):
    table = lambda n, k: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{n}.parquet").select(k, "text").collect()]
    left = plain(table("documents", "doc_id"), table("benchmark", "item_id"))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {d: sp.encode(t) for d, t in left} and 20 < len(got) < 200


def test_stages_take_any_table(spark, docs, empty, sf_dir):
    for d in (docs, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            d = cut(stage(spark, d, sf_dir), name.replace(" ", "-"))
            assert d.columns == docs.columns
        assert "ids" in corpus_pipeline.STAGES[-1][1](spark, d, sf_dir).columns
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
