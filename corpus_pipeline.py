"""The corpus pipeline: documents in, encoded documents out, in five stages.

1. ``language_id``: documents that resemble no language go: those without letters, and those no nearer to any language than chance.
2. ``ngram_join``: of each group of documents linked by five-word shingles from a similarity of 0.8, the smallest id stays.
3. ``suffix_dedup``: passages of 400 bytes and more that also start elsewhere are taken out; documents of which nothing is left go.
4. ``mixing``: documents are repeated, or left out, so that sources reach their targets.
5. ``sentencepiece``: texts become ids, with what the ids decode to.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of ``docs``. Scratch tables that a stage
leaves are in the folder of ``spark.checkpoint.dir``; those of earlier steps within a stage are removed by it.

Defined results: null texts have no letters and go in the first stage, as do empty ones; a null language trains nothing; a null source is one
source, the last; documents with a null id link with nothing and stay. Of rows that are repeats of each other one stays after the second
stage; rows of one id with different texts are documents of their own. Ties: as each operator's docstring states, so reruns agree. An
empty table gives an empty result. Extra columns, whatever their names, are carried to the last stage, which drops them. Texts are
taken whole, however long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from delspan.llm import language_id, mixing, ngram_join, sentencepiece_bpe, suffix_dedup
from delspan.llm.common import materialize


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(docs)


def weighed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("ngram_join", distinct),
    ("suffix_dedup", without_passages),
    ("mixing", weighed),
    ("sentencepiece", encoded),
]

#: Language profiles, suffix arrays and the piece model have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
