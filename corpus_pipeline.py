"""Corpus cleaning as a chain of stages; each stage's rows are written and read again as
the next one's documents.

1. language ID: documents go that have no letter or are mostly in none of the languages that are
   learned from the labelled ones;
2. SimHash near-dedup: of each group of near-duplicates the smallest doc_id stays;
3. suffix-array dedup: byte strings of 200 and more that repeat are cut out of the texts;
4. mixing: whole documents are taken by target weights within 90 % of the tokens, each once;
5. BPE: token counts and digests of what is left.

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import bpe, langid, mixing, simhash, suffix
from touchline.llm.common import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_foreign(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(spark, docs, sf_dir)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(spark, docs, sf_dir)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(spark, docs, sf_dir)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("mix", mix), ("encode", encode)]
#: No SQL for expectation-maximisation, suffix sorting or BPE; tests/llm/test_pipeline.py has the brute-force twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
