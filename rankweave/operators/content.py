"""Content fallback (P11) and useful-content acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import looks_like_pdf
from ..sources.pages import MAX_CHARS, content_for_urls

# Fixed defaults of the content step.
TOP_N = 3
MIN_USEFUL_CHARS = 200


def content_or(fallback: Column, content: Column | None = None) -> Column:
    """``content`` when non-empty, else the snippet/description."""
    c = content if content is not None else F.col("content")
    return F.coalesce(F.nullif(c, F.lit("")), fallback)


def enrich_top_n(rows: DataFrame, pages: DataFrame, top_n: int = TOP_N, max_chars: int = MAX_CHARS,
                 min_useful_chars: int = MIN_USEFUL_CHARS, key: str = "query_id",
                 order_cols: tuple[str, ...] = ("sec_pos", "rank")) -> DataFrame:
    """Per query, walk non-PDF rows with a url in flat order; the first
    ``top_n`` whose cleaned page text has at least ``min_useful_chars``
    characters get ``content``; every other row gets null content."""
    if top_n <= 0:
        return rows.withColumn("content", F.lit(None).cast("string"))
    eligible = F.col("url").isNotNull() & (F.col("url") != "") & ~looks_like_pdf(F.col("url"))
    spots = rows.filter(eligible).select(key, *order_cols, "url")
    useful = content_for_urls(pages, spots.select("url"), max_chars, clean=True).where(F.length("content") >= min_useful_chars)
    # only the first rows of a query leave a task: the filter on the rank is a group limit
    w = Window.partitionBy(key).orderBy(*order_cols)
    picks = (spots.join(useful, "url").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top_n)
             .select(key, *order_cols, "content"))
    return rows.join(picks, [key, *order_cols], "left")
