"""Corpus pipeline: language, near duplicates, benchmark, mix, shards.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and
returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankweave.llm import decontaminate, langid, mixing, sharding, simhash
from rankweave.llm.common import materialize, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a learned language go on. A null or empty text and one
    without a letter are of none, nor is a text whose margins, allowing for its
    length, are under a floor fitted on documents not learned from; short clean
    texts stay. Without labels or second family only letterless texts go.
    Repeated rows are judged alike; an empty table stays empty."""
    return langid.keep_identified(docs, langid.fit_corpus(docs, calibrated=True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component goes on: the smallest id, nulls
    last, then the smallest hash of the text. Null, empty and blank texts have
    fingerprint zero and are near-duplicates of each other; of repeated rows
    one stays; an empty table stays empty."""
    return simhash.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or re-parameterised, go
    on. A null or empty text holds none; equal texts, repeated rows included,
    are judged alike; with an empty benchmark or no documents all stay."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to twice. A null text has
    no words; null is a source of its own; repeated rows count and are taken
    like rows of their own; an empty table stays empty."""
    return mixing.mix(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document. A null text has size 16 and no group;
    equal texts, repeated rows included, form groups; an empty table stays
    empty. The columns beyond id and text are not returned."""
    return sharding.assign_shards(docs)


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("benchmark", drop_benchmark),
    ("mix", mix_sources),
    ("shards", assign_shards),
]

#: fitted machines, hash fingerprints and iterations are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is stored and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
