"""Okapi BM25 over a corpus as DataFrame jobs.

An index is four tables:
  postings(<id>, term, tf, dl)   one row per (document, distinct term)
  docs(<id>, dl)                 one row per document
  terms(term, df, idf)           one row per distinct term
  stats(n, avgdl, mean_idf)      one row
A stored index (:mod:`rankweave.operators.stored_index`) keeps the postings in
buckets by document, so scoring needs no exchange on (query, document).

Scoring joins the weighted query terms to postings on the term. Query terms are
the small side (a request batch); the join is an equi-join, never a cross
product, and only documents holding at least one query term produce rows.
Per-query corpora of candidates are scored in :mod:`rankweave.operators.relevance`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, tokenize, with_tokens
from ..session import cut_lineage, store

# Fixed BM25 parameters (Okapi, with the epsilon floor for negative idf).
K1 = 1.5
B = 0.75
EPSILON = 0.25


@dataclass
class BM25Index:
    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    stats: DataFrame
    id_col: str
    bounds: DataFrame | None = None  # term, length_class, max_tf, min_dl: kept by a stored index
    buckets: int | None = None       # of the postings by id, in a stored index


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-distribute by ``key`` only when the scan gives fewer partitions than
    the cluster can run at once (e.g. one large row group). Partitioning by the
    document key also satisfies the later (key, term) aggregation, so that
    aggregation adds no exchange. A well-split input is left alone."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par, key)
    return df


def document_entries(docs: DataFrame, id_col: str, text_col: str | None = None, tokens_col: str = "tokens",
                     lexer: Tokenizer | None = None) -> DataFrame:
    """(id, term, tf, dl) per distinct term of a document, and one row
    with a null term for a document without tokens (it still counts in N and the
    mean length)."""
    if text_col is not None:
        base = with_tokens(docs.select(id_col, text_col), F.col(text_col), "tokens", lexer=lexer).select(id_col, "tokens")
    else:
        base = docs.select(id_col, F.col(tokens_col).alias("tokens"))
    return (base.select(id_col, F.size("tokens").cast("long").alias("dl"), F.explode_outer("tokens").alias("term"))
            .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")))


def build_index(docs: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", materialize: bool = False,
                text_col: str | None = None, lexer: Tokenizer | None = None) -> BM25Index:
    """B1 + B2 without a stored layout. ``docs`` has the id and either
    ``tokens_col`` (array<string>) or ``text_col`` (tokenised here, after
    spreading). With ``materialize`` the entries are checkpointed, so the
    tokeniser runs once."""
    base = spread(docs.select(id_col, text_col), id_col) if text_col is not None else docs
    entries = document_entries(base, id_col, text_col, tokens_col, lexer)
    if materialize:
        entries = cut_lineage(entries)
    postings = entries.filter(F.col("term").isNotNull())
    doc_len = entries.groupBy(id_col).agg(F.max("dl").alias("dl"))
    counted = doc_len.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df_tab = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one side of these cross joins is a single row
    raw = df_tab.crossJoin(counted.select("n")).withColumn("idf_raw", raw_idf(F.col("n"), F.col("df")))
    mean = raw.agg(F.avg("idf_raw").alias("mean_idf"))
    terms = raw.crossJoin(mean).select("term", "df", idf_value(F.col("idf_raw"), F.col("mean_idf")).alias("idf"))
    return BM25Index(postings, doc_len, terms, counted.crossJoin(mean), id_col)


def raw_idf(n: Column, df: Column) -> Column:
    return F.ln(n - df + 0.5) - F.ln(df + 0.5)


def idf_value(idf_raw: Column, mean_idf: Column) -> Column:
    """Negative idf is replaced by epsilon x the corpus mean of the raw idf."""
    return F.when(idf_raw < 0, mean_idf * EPSILON).otherwise(idf_raw)


def impact(tf: Column, dl: Column, avgdl: Column) -> Column:
    """Part of a term's score that depends on the document; it grows with tf and falls with dl."""
    tf = tf.cast("double")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def query_terms(queries: DataFrame, query_col: str = "query", key: str = "query_id",
                lexer: Tokenizer | None = None, tokens_col: str | None = None) -> DataFrame:
    """(key, term, qtf): query tokens with repeats counted (a repeated query
    token adds its term score twice)."""
    toks = F.col(tokens_col) if tokens_col else tokenize(F.col(query_col), lexer=lexer)
    return (queries.select(key, F.explode(toks).alias("term"))
            .groupBy(key, "term").agg(F.count(F.lit(1)).alias("qtf")))


def contributions(index: BM25Index, weights: DataFrame, key: str) -> DataFrame:
    """(key, id, c, other columns of ``weights``): one row per matching (query
    term, document) for ``weights`` (key, term, weight, ...)."""
    avgdl = index.stats.select("avgdl").scalar()
    others = [x for x in weights.columns if x not in (key, "term", "weight")]
    c = F.col("weight") * impact(F.col("tf"), F.col("dl"), avgdl)
    return weights.join(index.postings, "term").select(key, index.id_col, c.alias("c"), "dl", *others)


def document_scores(found: DataFrame, key: str, id_col: str) -> DataFrame:
    """Sums of contributions, and the document's length. Partial sums are
    formed before the exchange; the buckets of a stored index need none."""
    return found.groupBy(key, id_col).agg(F.sum("c").alias("score"), F.max("dl").alias("dl"))


def term_weights(index: BM25Index, qterms: DataFrame) -> DataFrame:
    """(key, term, weight, ...) for the query terms that the corpus holds."""
    return qterms.join(index.terms, "term").withColumn("weight", F.col("idf") * F.col("qtf"))


def score(index: BM25Index, qterms: DataFrame, key: str = "query_id") -> DataFrame:
    """B3 for matching documents: (key, id, score). Documents sharing no term
    with the query are absent (their score is 0). The weights of a batch are
    stored first, so Spark knows their size when it chooses the join."""
    weights = store(term_weights(index, qterms).select(key, "term", "weight"), "weights")
    return document_scores(contributions(index, weights, key), key, index.id_col).select(key, index.id_col, "score")


def length_class(dl: Column) -> Column:
    """Half octave of a document's length (1 and more)."""
    return F.floor(2 * F.log2(dl)).cast("int")


def rank_order(score_col: str = "score", tie_cols: tuple[str, ...] = ("doc_id",)) -> list:
    """Score descending on a 9-digit rounding (sums are order dependent in the
    last bits), ties by original position."""
    return [F.round(F.col(score_col), 9).desc()] + [F.col(c).asc() for c in tie_cols]


def best_of(scores: DataFrame, k: int, key: str, id_col: str) -> DataFrame:
    """(key, id, score, rank): the k best rows of each query. ``row_number() <=
    k`` is planned as a partial WindowGroupLimit before the exchange on the key."""
    w = Window.partitionBy(key).orderBy(*rank_order("score", (id_col,)))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        key, id_col, "score", F.col("rank").cast("long").alias("rank"))


def top_k(index: BM25Index, qterms: DataFrame, queries: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """B4 in corpus mode: the k best documents per query among all documents;
    those sharing no term score 0 and come in order of their ids.

    The best k documents with a term are ranked first. Only queries with fewer
    than k scores above zero can have a document without a term among their k
    best: for them the first k + m documents by id are taken, m being the
    documents that hold a term, and those m removed, so that k remain for any
    corpus."""
    idc = index.id_col
    qterms = store(qterms, "query-terms")
    best = store(best_of(score(index, qterms, key), k, key, idc).drop("rank"), "best")
    above = best.groupBy(key).agg(F.sum((F.round("score", 9) > 0).cast("int")).alias("above"))
    short = cut_lineage(queries.select(key).distinct().join(above, key, "left")
                        .where(F.coalesce("above", F.lit(0)) < k).select(key))
    if not short.isEmpty():
        matched = store(score(index, qterms.join(short, key, "left_semi"), key).select(key, idc), "matched")
        m = matched.groupBy(key).agg(F.count(F.lit(1)).alias("m"))
        # places 0 .. k + m - 1 of the documents in order; a hit takes one of them at most
        limit = matched.groupBy(key).count().agg(F.coalesce(F.max("count"), F.lit(0)) + k)
        places = numbered(index.docs.select(idc), idc).where(F.col("place") < limit.scalar())
        wanted = short.join(m, key, "left").select(
            key, F.explode(F.sequence(F.lit(0), F.lit(k - 1) + F.coalesce("m", F.lit(0)))).alias("place"))
        first = Window.partitionBy(key).orderBy(idc)
        fill = (wanted.join(places, "place").join(matched, [key, idc], "left_anti")
                .withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k)
                .select(key, idc, F.lit(0.0).alias("score")))
        best = best.unionByName(fill)
    return best_of(best, k, key, idc).select(key, idc, "rank", "score")


def numbered(df: DataFrame, by: str, out: str = "place") -> DataFrame:
    """Add the row's place (from 0) in the order of ``by`` without one task
    for all rows: ranges are numbered apart and shifted by the counts before."""
    ranged = cut_lineage(df.repartitionByRange(by).sortWithinPartitions(by)
                         .withColumn("_range", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    ranges = ranged.groupBy("_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (ranged.join(ranges, "_range").withColumn(out, F.col("_row") - F.col("_first") + F.col("_before"))
            .drop("_range", "_row", "_first", "_before"))
