"""Recency decay (B7) and BM25 x recency re-rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed defaults: a missing date counts as one year old.
UNKNOWN_DATE_HOURS = 24.0 * 365
DECAY_LAMBDA = 0.01
TOP_K = 4


def hours_since(pub_date: Column, now: Column) -> Column:
    """Hours between ``pub_date`` and ``now``; future dates give 0 and a
    null date gives 8760. Timestamps are instants (session zone UTC)."""
    h = (F.unix_micros(now) - F.unix_micros(pub_date)) / 3.6e9
    # greatest() skips nulls, so the null date is decided first
    return F.when(pub_date.isNull(), F.lit(UNKNOWN_DATE_HOURS)).otherwise(F.greatest(h, F.lit(0.0)))


def recency_rerank(scored: DataFrame, now: Column, top_k: int = TOP_K,
                   decay_lambda: float = DECAY_LAMBDA, key: str = "query_id",
                   score_col: str = "bm25_score", bm25_pos_col: str = "bm25_pos",
                   date_col: str = "pub_date") -> DataFrame:
    """``final = bm25 * exp(-lambda * hours)``, sorted descending with ties
    in BM25 order, first ``top_k`` per query. A negative BM25 score rises
    with age (kept as in the formula)."""
    hours = hours_since(F.col(date_col), now)
    out = (scored.withColumn("age_hours", hours)
           .withColumn("recency_decay", F.exp(-decay_lambda * F.col("age_hours")))
           .withColumn("final_score", F.col(score_col) * F.col("recency_decay")))
    w = Window.partitionBy(key).orderBy(F.round(F.col("final_score"), 9).desc(), F.col(bm25_pos_col))
    return (out.withColumn("final_rank", F.row_number().over(w).cast("long"))
            .filter(F.col("final_rank") <= top_k))
