"""Ranking evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_hits(ranked: DataFrame, q_tokens: DataFrame, d_tokens_col: str = "doc_tokens",
              key: str = "query_id") -> DataFrame:
    """Distinct query terms present in each ranked doc.
    q_tokens: (key, q_tokens array)."""
    return ranked.join(q_tokens, key, "left").withColumn(
        "hits", F.size(F.array_intersect(F.coalesce("q_tokens", F.array().cast("array<string>")),
                                         F.col(d_tokens_col))).cast("long"))


def mean_hits(hits: DataFrame, lists: DataFrame, key: str = "query_id") -> DataFrame:
    """Mean hits per (query, ranking); a ranking with no docs gives 0.
    hits: (key, ranking, pos, hits); lists: (key, ranking), all that are judged."""
    means = hits.groupBy(key, "ranking").agg(F.avg("hits").alias("mean_hits"))
    return (lists.select(key, "ranking").distinct().join(means, [key, "ranking"], "left")
            .select(key, "ranking", F.coalesce("mean_hits", F.lit(0.0)).alias("mean_hits")))


def same_order(a: DataFrame, b: DataFrame, id_col: str = "item_pos", key: str = "query_id") -> DataFrame:
    """A9 + J6: full outer join of two top-k lists on (query, position);
    identical lists give true."""
    x = a.select(key, "pos", F.col(id_col).alias("a_id"))
    y = b.select(key, "pos", F.col(id_col).alias("b_id"))
    j = x.join(y, [key, "pos"], "full_outer")
    return j.groupBy(key).agg(F.bool_and(F.col("a_id").eqNullSafe(F.col("b_id"))).alias("same_order"))
