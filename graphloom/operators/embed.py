"""Embedding of texts in batches by any embedder: a function from a list of texts to as many vectors.

Each task calls the embedder with ``batch`` texts at a time. A call that fails is made again after a growing wait; if it
goes on failing, the texts of the batch are tried alone, so that one bad text costs no other its vector. What fails for
good keeps its row, with the error in place of a vector.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Embedder = Callable[[list[str]], list[list[float]]]

#: Tokens that an embedder takes, texts of one call, calls for a batch, and the bounds of the wait between them in seconds.
MOST_TOKENS, BATCH, ATTEMPTS, WAIT, LONGEST_WAIT = 8191, 100, 3, 1.0, 30.0


class HashedWords:
    """The default embedder: words ``[a-z0-9_]+`` of the lower-case text, counted by a hash of each in ``dim`` places."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import re

        known: dict[str, int] = {}
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts, strict=True):
            for w in re.findall("[a-z0-9_]+", text.lower()):
                if w not in known:
                    known[w] = int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % self.dim
                row[known[w]] += 1
        return out.tolist()


class CharacterTruncation:
    """For embedders with a limit: at most ``most`` tokens of ``chars`` characters. Pass a function of your tokenizer for exact ones."""

    def __init__(self, most: int = MOST_TOKENS, chars: float = 4.0):
        self.most = int(most * chars)

    def __call__(self, text: str) -> str:
        return text[: self.most]


def _call(embedder: Embedder, texts: list[str], attempts: int, wait: float) -> tuple[list[list[float]] | None, str | None]:
    error = None
    for n in range(attempts):
        try:
            found = embedder(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return found, None
        except Exception as e:  # noqa: BLE001 - whatever an embedder raises is the row's error
            error = f"{type(e).__name__}: {e}"
            if n + 1 < attempts:
                time.sleep(min(LONGEST_WAIT, wait * 2**n))
    return None, error


def embed_texts(embedder: Embedder, texts: list[str], attempts: int = ATTEMPTS, wait: float = WAIT) -> list[tuple[list[float] | None, str | None]]:
    """A vector or an error for each text."""
    found, error = _call(embedder, texts, attempts, wait)
    if found is not None:
        return [(v, None) for v in found]
    if len(texts) == 1:
        return [(None, error)]
    alone = [_call(embedder, [t], attempts, wait) for t in texts]
    return [(v[0] if v else None, e) for v, e in alone]


def embed(df: DataFrame, text: str = "text", embedder: Embedder | None = None, truncate: Callable[[str], str] | None = None, batch: int = BATCH, attempts: int = ATTEMPTS, wait: float = WAIT) -> DataFrame:
    """``df`` with ``embedding`` and ``error``, one of which is null. A null text has neither. Partitions are calls side
    by side: repartition ``df`` to the number that the embedder's service bears. Texts are whole unless ``truncate`` cuts them."""
    embedder, truncate = embedder or HashedWords(), truncate or str
    kinds = {"embedding": pa.list_(pa.float64()), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                texts = b.column(text).to_pylist()
                given = [i for i, t in enumerate(texts) if t is not None]
                rows: list[tuple] = [(None, None)] * len(texts)
                if given:
                    for i, r in zip(given, embed_texts(embedder, [truncate(texts[i]) for i in given], attempts, wait), strict=True):
                        rows[i] = r
                for k, (name, kind) in enumerate(kinds.items()):
                    b = b.append_column(name, pa.array([r[k] for r in rows], kind))
                yield b

    if clash := {"embedding", "error"} & set(df.columns):
        raise ValueError(f"the table has {', '.join(sorted(clash))} already")
    added = [T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *added]))


def embed_query(text: str, embedder: Embedder | None = None, truncate: Callable[[str], str] | None = None, wait: float = WAIT) -> list[float]:
    """The vector of one text, such as a search's."""
    vector, error = embed_texts(embedder or HashedWords(), [(truncate or str)(text)], wait=wait)[0]
    if vector is None:
        raise RuntimeError(error)
    return vector


def query_frame(spark: SparkSession, text: str, embedder: Embedder | None = None) -> DataFrame:
    """One row (qid, embedding) for a vector index."""
    return spark.createDataFrame([(0, embed_query(text, embedder))], "qid long, embedding array<double>")
