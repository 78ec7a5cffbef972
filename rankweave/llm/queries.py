"""Registered queries of this subpackage: (spark, sf_dir) -> DataFrame.

Each applies one operator with production parameters to its whole table and
derives the columns of its result from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, embeddings, hardneg, langid, linededup, mixing, packed, pii, prefixtrie, sharding, simhash,
               tokencount, urlfilter)
from .common import read_table, scratch_path

#: a deployment passes a secret of its own
PII_KEY = "rankweave"
#: folder of the public vocabulary files on every machine
TOKENIZERS = "/opt/tokenizers"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit_corpus(docs))
    return found.select("row.doc_id", langid.held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


@query
def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query
def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.remove_boilerplate(read_table(spark, sf_dir, "documents"))


@query
def op4_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(read_table(spark, sf_dir, "documents"))


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read_table(spark, sf_dir, "documents"))


@query
def op8_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(read_table(spark, sf_dir, "pages")).drop("words")


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(read_table(spark, sf_dir, "documents"), key=PII_KEY)


@query
def op11_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "packed")
    packed.write_packed(read_table(spark, sf_dir, "documents"), path, f"{TOKENIZERS}/{packed.VOCABULARY}")
    return packed.digests(packed.read_packed(spark, path))


@query
def op12_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(hardneg.prepared(table.withColumn("label", moved)), F.col("id") % 50 == 0)


@query
def op13_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefixtrie.ordered_turns(read_table(spark, sf_dir, "conversations"))
    return prefixtrie.prefix_trie(*prefixtrie.rebuild(turns))
