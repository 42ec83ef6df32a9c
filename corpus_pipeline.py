"""The corpus pipeline: five stages over documents, each over all that the stage before it kept.

toxicity: documents that the classifier chain rejects go. near_duplicates: of each group of documents linked by shared
five-word shingles (similarity 0.8 or more) the one of the smallest doc_id stays. pii: identifiers become their kind in
brackets. mixing: documents are drawn by probabilities that bring sources, languages and topics to the target weights,
at the highest rate up to RATE at which no probability exceeds 1. sentencepiece: the texts' token ids.

Each stage's rows are written as Parquet to the shared folder and read again, so a lost executor costs one stage at most.
What a stage wrote on its way, and the rows of the stage before, go when its own rows are written.

Defined results: every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables. Null
text is not toxic, no near duplicate, without identifiers, drawn as its cell is, and has null ids. Rows without words, or
without doc_id, are no duplicates of anything; rows of one doc_id all stay or all go. Ties: of equally good rows of a
group the smallest doc_id stays. Columns beside those of documents pass through all stages but the last, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import toxicity

    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import ngram_join

    return ngram_join.dedupe(docs, n=5, num=8, den=10)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import pii

    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import mixing, queries

    return mixing.sampled(docs, targets=queries.TARGETS, rate=queries.RATE, rounds=queries.ROUNDS, seed=queries.SEED)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import sentencepiece_codec

    return sentencepiece_codec.encode(docs).select("doc_id", "n_tokens", "ids_sha256", "round_trip", "ids")


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("pii", redact), ("mixing", mix_sources), ("sentencepiece", encode)]

#: The classifier and the encoder can't be put in SQL; tests/llm/test_pipeline.py has a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm.shared import documents, staged

    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage, spark, docs, sf_dir, name)
    return docs
