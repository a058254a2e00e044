"""Every operator on documents through its registered query, over texts of a megabyte: many words, one word, one line again and again."""

import hashlib
import time
import zlib

import pytest

from graphloom.llm import queries

from .conftest import passage
from .test_groups import brute_components, brute_fp
from .test_per_document import WORD, brute_lines, brute_quality

LIMIT = 150  # seconds for a query over eight such texts; most need a few


@pytest.fixture(scope="module")
def texts():
    words = passage(11, 140_000).split()
    big = "\n".join(" ".join(words[i : i + 50]) for i in range(0, len(words), 50))
    return {0: big, 1: big, 2: big + "\nand password = hunter2hunter2 at the end", 3: None, 4: "", 5: "short one", 6: "y" * 1_200_000, 7: "lorem ipsum dolor sit amet " * 45_000, 8: "one line\n" * 100_000}


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("long"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, " ".join(texts[0].split()[70_010:70_080])), (2, "lorem ipsum dolor sit amet " * 12)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


@pytest.fixture
def run(spark, folder):
    def go(name):
        began = time.monotonic()
        found = queries.QUERIES[name](spark, folder).collect()
        assert time.monotonic() - began < LIMIT
        return {r.doc_id: r for r in found} if name != "op2_decontaminate" else found

    return go


def test_simhash(run, texts):
    got = run("op1_simhash_dedup")
    fp = {i: brute_fp(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fp.items()}
    root = brute_components(set(fp.values()))
    assert {i: r.component_id for i, r in got.items()} == {i: min(j for j in fp if root[fp[j]] == root[fp[i]]) for i in fp}


def test_decontaminate(run):
    got = {(r.doc_id, r.item_id): r for r in run("op2_decontaminate")}
    assert set(got) == {(0, 1), (1, 1), (2, 1), (7, 2)}
    assert all((r.start, r.similarity) == (70_010 if r.item_id == 1 else 0, 1.0) for r in got.values())


def test_sentencepiece(run, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_bpe())
    got = run("op3_sentencepiece")
    assert all(r.round_trip for r in got.values())
    assert all(list(got[i].ids) == library.encode(texts[i] or "") for i in (0, 2, 3, 4, 5, 7, 8))
    assert set(got) == set(texts)


def test_lines(run, texts):
    got = run("op4_line_dedup")
    want = {r[0]: r[1:] for r in brute_lines([(i, t) for i, t in texts.items()])}
    assert {i: tuple(r)[1:] for i, r in got.items()} == want


def test_tokens(run, texts):
    import numpy as np
    from tokenizers import Tokenizer

    library, got, start = Tokenizer.from_file(queries.byte_bpe()), run("op5_token_store"), 0
    for i, t in texts.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4") if i != 6 else None  # one word takes the library minutes
        if ids is not None:
            assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        assert got[i].start == start
        start += got[i].n_tokens


def test_language_model(run, texts):
    got = run("op6_katz_lm")
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(WORD.findall(t or "")) + 1 for i, t in texts.items()}
    assert all(r.score < 0 and r.n_known <= r.n_tokens for r in got.values())


def test_shards(run, texts):
    got = run("op7_sharding")
    assert {i: (r.size, r.text_crc32) for i, r in got.items()} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts.items()}
    slots = sorted((r.shard, r.slot) for r in got.values())
    assert all(slot == sum(s == shard for s, _ in slots[:k]) for k, (shard, slot) in enumerate(slots))


def test_quality(run, texts):
    got = run("op8_quality_rules")
    for i, t in texts.items():
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == brute_quality(t)


def test_suffixes(run, texts):
    got, seen = run("op9_suffix_dedup"), set()
    for i, t in sorted(texts.items()):
        b = (t or "").encode()
        own = {hash(b[p : p + 50]) for p in range(len(b) - 49)}
        end, n, spans, kept = 0, 0, 0, []
        for p in range(len(b) - 49):
            if hash(b[p : p + 50]) in seen:
                if p > end or not n:
                    spans += 1
                    kept.append(b[end:p])
                    end = p
                n += p + 50 - end
                end = p + 50
        kept.append(b[end:])
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans) == (len(b), n, spans)
        assert got[i].kept_sha256 == hashlib.sha256(b"".join(kept)).hexdigest()
        seen |= own


def test_secrets(run, texts):
    got = run("op10_secret_scan")
    at = texts[2].index("password")
    assert {i: (r.n_assign, r.n_access, r.n_hex) for i, r in got.items()} == {i: (int(i == 2), 0, 0) for i in texts}
    assert got[2].base_sha256 == hashlib.sha256(f"assign:{at}:{at + len('password = hunter2hunter2')}".encode()).hexdigest()


def test_jaccard(run, texts):
    got = run("op13_jaccard_join")
    sets = {}
    for i, t in texts.items():
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[p : p + 3]) for p in range(len(w) - 2)} or ({tuple(w)} if w else set())
    link = lambda a, b: a and 100 * len(a & b) >= 90 * len(a | b)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == {i: min([i, *(j for j in sets if link(sets[i], sets[j]))]) for i in sets}
