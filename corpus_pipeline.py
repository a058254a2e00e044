"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's input.

SQL can't express near-duplicate groups or SentencePiece, so ``ORACLE_SQL`` is None; tests/llm/test_pipeline.py runs
``run`` against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import decontaminate, line_dedup, quality_rules, sentencepiece_codec, simhash_dedup
from graphloom.llm.common import cut, plain_reads, table
from graphloom.llm.queries import piece_bpe


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy prose-1. Null and empty texts fail; repeated rows and null ids are judged one by one."""
    plain_reads(spark)
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; ``n_chars`` follows the text. Null, empty and one-line texts stay as
    they are; ties go by doc_id, null ids first; repeated rows (same id and text) are one document."""
    return line_dedup.dedup(docs, "n_chars")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts at five-word Jaccard similarity 0.8 or more the smallest doc_id stays. Null and empty texts
    are one group; rows without id stay; repeated rows of the id that stays all stay."""
    return simhash_dedup.dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of ``benchmark`` go. Null and empty texts stay; without items all stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and a digest of the text decoded from them, for each row; null and empty texts have no ids."""
    return sentencepiece_codec.encode_table(docs, piece_bpe())


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("SentencePiece", encoding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
