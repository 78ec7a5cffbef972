"""Relative relevance (B5) and relevance re-rank (B6), candidate-mode BM25.

Each query's own candidates form its corpus; all statistics are keyed by the
query id, so one job filters every query of a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, with_tokens
from ..session import cut_lineage
from . import bm25

# Fixed default ratios / sizes.
MIN_SCORE_RATIO = 0.15
RERANK_TOP_K = 6


def candidate_scores(cands: DataFrame, queries: DataFrame, id_col: str, text: F.Column,
                     key: str = "query_id", query_col: str = "query",
                     lexer: Tokenizer | None = None, materialize: bool = True) -> DataFrame:
    """Adds ``score`` (BM25 of the query against its candidates), ``best``
    (max score of the query) and ``has_terms`` (query tokenises to something).

    A query's candidates are a bounded corpus of their own, so their tokens
    are partitioned by the query once and every statistic (documents, mean
    length, document frequency, mean idf) is a window on that partitioning: no
    other exchange but the join back to the rows. With ``materialize`` the
    candidates are stored first, as tokens and result both read them."""
    if materialize:
        cands = cut_lineage(cands)
    texts = cands.select(key, id_col, text.alias("_text")).repartition(key)
    own, of_term = Window.partitionBy(key), Window.partitionBy(key, "term")
    docs = (with_tokens(texts, F.col("_text"), "tokens", lexer=lexer)
            .select(key, id_col, "tokens", F.size("tokens").alias("dl"), F.count(F.lit(1)).over(own).alias("n"))
            .withColumn("avgdl", F.avg("dl").over(own)))
    entries = (docs.select(key, id_col, "dl", "n", "avgdl", F.explode("tokens").alias("term"))
               .groupBy(key, id_col, "dl", "n", "avgdl", "term").agg(F.count(F.lit(1)).alias("tf")))
    raw = F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    # a term has df rows, so 1/df counts it once
    mean = F.sum(F.col("raw") / F.col("df")).over(own) / F.sum(1 / F.col("df")).over(own)
    weighed = (entries.withColumn("df", F.count(F.lit(1)).over(of_term)).withColumn("raw", raw)
               .withColumn("idf", bm25.idf_value(F.col("raw"), mean)))
    qsel = queries.join(cands.select(key).distinct(), key, "left_semi")
    qt = bm25.query_terms(qsel, query_col=query_col, key=key, lexer=lexer)
    tf = F.col("tf").cast("double")
    norm = tf + bm25.K1 * (1 - bm25.B + bm25.B * F.col("dl") / F.col("avgdl"))
    scores = (weighed.join(qt, [key, "term"])
              .select(key, id_col, (F.col("idf") * F.col("qtf") * tf * (bm25.K1 + 1) / norm).alias("c"))
              .groupBy(key, id_col).agg(F.sum("c").alias("score")))
    has_terms = qt.select(key).distinct().withColumn("has_terms", F.lit(True))
    return (cands.join(scores, [key, id_col], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
            .join(has_terms, key, "left")
            .withColumn("has_terms", F.coalesce("has_terms", F.lit(False)))
            .withColumn("best", F.max("score").over(own)))


def _signal(ratio: float) -> tuple[F.Column, F.Column]:
    signal = F.col("has_terms") & (F.round(F.col("best"), 9) > 0)
    passes = F.round(F.col("score"), 9) >= F.round(F.col("best"), 9) * ratio
    return signal, passes


def relevance_filter(cands: DataFrame, queries: DataFrame, id_col: str,
                     ratio: float = MIN_SCORE_RATIO, key: str = "query_id",
                     text: F.Column | None = None, lexer: Tokenizer | None = None) -> DataFrame:
    """Keep rows scoring at least ``ratio`` x the query's best; keep all
    rows of a query without tokens or whose best score is <= 0. Row order is
    untouched (it is data)."""
    text = text if text is not None else F.concat_ws(" ", F.col("title"), F.col("snippet"))
    scored = candidate_scores(cands, queries, id_col, text, key, lexer=lexer)
    signal, passes = _signal(ratio)
    return scored.filter(~signal | passes)


def relevance_rerank(links: DataFrame, queries: DataFrame, id_col: str, pos_col: str = "pos",
                     top_k: int = RERANK_TOP_K, ratio: float = MIN_SCORE_RATIO,
                     key: str = "query_id", text: F.Column | None = None,
                     lexer: Tokenizer | None = None) -> DataFrame:
    """As B5 but in score order (ties by original position), cut to
    ``top_k``; without a signal the first ``top_k`` in original order."""
    text = text if text is not None else F.concat_ws(" ", F.col("title"), F.col("snippet"))
    scored = candidate_scores(links, queries, id_col, text, key, lexer=lexer)
    signal, passes = _signal(ratio)
    order_key = F.when(signal, -F.round(F.col("score"), 9)).otherwise(F.lit(0.0))
    w = Window.partitionBy(key).orderBy(order_key, F.col(pos_col))
    return (scored.filter(~signal | passes)
            .withColumn("rerank", F.row_number().over(w).cast("long"))
            .filter(F.col("rerank") <= top_k))
