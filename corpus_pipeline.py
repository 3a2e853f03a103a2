"""From raw documents to token shards in five stages, each written and read again.

1. ``language``: documents without a language (no letter), or with a posterior below one half, go.
2. ``near_duplicates``: of each group of near-duplicates the document with the smallest doc_id stays.
3. ``decontaminate``: documents of which benchmark passages make a twentieth or more go; smaller hits are cut out.
4. ``mix``: documents in the order of a schedule that gives each source its target weight.
5. ``tokens``: token shards in this order; one row per document, as read back from the shards.

Stage 4 hands its order on as the order of the rows in its part files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from txnrisk.llm import decontaminate, langid, mixing, simhash, tokens
from txnrisk.llm.common import remainder, ship
from txnrisk.sources.scratch import materialise

#: A document stays if its best language has at least this posterior.
CERTAIN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    langs, probabilities = langid.fit(docs, model, remainder(5) != 0)
    return langid.certain(docs, model, langs, probabilities, CERTAIN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mixed(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return tokens.tokenized(docs, tokenizer, mixing.file_order())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mix),
    ("tokens", token_shards),
]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
