"""Result filters (P3-P7) and drop counters (A10).

Candidates carry ``query_id, engine, rank`` (1-based position in the source's
list); every list order of the reference is an explicit sort key here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_matching_keyword, looks_like_pdf
from .keywords import CHAIN, first_keyword, keyword_table

# Fixed default: rows read per source when keyword filtering is on.
OVERFETCH_COUNT = 10


def policy_text(df: DataFrame) -> F.Column:
    return F.concat_ws(" ", F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("snippet"), F.lit("")))


def with_excluded_keyword(df: DataFrame, keywords: list[str] | DataFrame, out_col: str = "keyword") -> DataFrame:
    """First excluded keyword (list order) found in ``title + ' ' +
    snippet``. A long list, or a table (pos, keyword), is joined by q-grams."""
    if isinstance(keywords, DataFrame):
        return first_keyword(df, policy_text(df), keywords, out_col)
    if len(keywords) > CHAIN:
        return first_keyword(df, policy_text(df), keyword_table(df.sparkSession, keywords), out_col)
    return df.withColumn(out_col, first_matching_keyword(policy_text(df), keywords))


def fetch_count(max_results: int, keywords: list[str], overfetch: int = OVERFETCH_COUNT) -> int:
    """Rows asked from a source."""
    return max(max_results, overfetch) if keywords else max_results


def overfetch_limit(cands: DataFrame, max_results: int, keywords: list[str],
                    overfetch: int = OVERFETCH_COUNT) -> DataFrame:
    """Keep the first fetch_count rows of each source list."""
    return cands.filter(F.col("rank") <= fetch_count(max_results, keywords, overfetch))


def exclusion_filter(raw: DataFrame, max_results: int, keywords: list[str],
                     group: tuple[str, ...] = ("query_id", "engine")) -> DataFrame:
    """Drop keyword hits, keep source order, keep the first ``max_results``.

    With keywords a row is appended before the limit is checked, so at least
    one row survives even when ``max_results <= 0``. Without keywords it is a
    Python slice (a negative bound drops rows from the end). Output ``rank`` is
    the new position; ``src_rank`` the source's. Rows that already carry their
    excluded keyword (``_kw``) need no texts.
    """
    g = list(group)
    w = Window.partitionBy(*g).orderBy("src_rank")
    base = raw.withColumnRenamed("rank", "src_rank")
    if keywords:
        marked = base if "_kw" in base.columns else with_excluded_keyword(base, keywords, "_kw")
        kept = marked.filter(F.col("_kw").isNull()).drop("_kw")
        limit = F.lit(max(max_results, 1))
        return kept.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)
    ranked = base.withColumn("rank", F.row_number().over(w).cast("long"))
    if max_results >= 0:
        return ranked.filter(F.col("rank") <= max_results)
    total = F.count(F.lit(1)).over(Window.partitionBy(*g))
    return (ranked.withColumn("_total", total).filter(F.col("rank") <= F.col("_total") + max_results)
            .drop("_total"))


def policy_status(requested: DataFrame, raw: DataFrame, kept: DataFrame,
                  group: tuple[str, ...] = ("query_id", "engine")) -> DataFrame:
    """P5: per requested source, ``policy_restricted`` when raw rows existed
    and none was kept, ``empty`` when there were no raw rows, else ``ok``."""
    g = list(group)
    n_raw = raw.groupBy(*g).agg(F.count(F.lit(1)).alias("n_raw"))
    n_kept = kept.groupBy(*g).agg(F.count(F.lit(1)).alias("n_kept"))
    out = (requested.select(*g).distinct().join(n_raw, g, "left").join(n_kept, g, "left")
           .select(*g, F.coalesce("n_raw", F.lit(0)).alias("n_raw"),
                   F.coalesce("n_kept", F.lit(0)).alias("n_kept")))
    status = (F.when((F.col("n_raw") > 0) & (F.col("n_kept") == 0), "policy_restricted")
              .when(F.col("n_raw") == 0, "empty").otherwise("ok"))
    return out.withColumn("status", status)


def pdf_filter(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Drop PDF-looking urls; null or empty urls stay."""
    return df.filter(~looks_like_pdf(F.col(url_col)))


def drop_counts(before_pdf: DataFrame, after_pdf: DataFrame, after_bm25: DataFrame,
                key: str = "query_id") -> DataFrame:
    """A10: rows in, dropped by the PDF filter and by the relevance filter."""
    a = before_pdf.groupBy(key).agg(F.count(F.lit(1)).alias("n_in"))
    b = after_pdf.groupBy(key).agg(F.count(F.lit(1)).alias("n_after_pdf"))
    c = after_bm25.groupBy(key).agg(F.count(F.lit(1)).alias("n_out"))
    j = a.join(b, key, "left").join(c, key, "left").fillna(0, ["n_after_pdf", "n_out"])
    return j.select(key, "n_in", (F.col("n_in") - F.col("n_after_pdf")).alias("n_pdf_dropped"),
                    (F.col("n_after_pdf") - F.col("n_out")).alias("n_bm25_dropped"), "n_out")
