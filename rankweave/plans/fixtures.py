"""Relations derived from the driver's tables for the registered queries.

Every relation is a plain expression over ``benchmark``, ``documents``,
``pages`` and ``events`` so the DuckDB oracle can repeat it (see
``plans/oracles.py``). All rows and whole texts are used: queries are the
whole benchmark texts, snippets are whole document texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens
from ..operators.bm25 import spread
from ..session import read_table

# Fixed values for the fixtures.
EXCLUDED_KEYWORDS = ["whst", "ación", "über"]
NOW = "2024-01-31 00:00:00"
N_ENGINES = 4
REQUEST_CYCLE = ["all", "e0", "e1, e2", "nope", "", "e3,nope"]
# engine, outcome and detail of a call that did not answer, by query_id % 5
OUTCOME_CYCLE = [("", "", ""), ("e0", "error", "connection reset"), ("e1", "timeout", "8"),
                 ("e2", "quota_exceeded", "all keys near their limit"), ("e3", "unavailable", "no key configured")]
# engine, registry position, default member of 'all', shared key group, endpoint, key of its calls if it needs none
SOURCES = [("e0", 0, True, None, None, "view"), ("e1", 1, True, "g", "news", None), ("e2", 2, True, "g", "webkr", None),
           ("e3", 3, False, "g", "blog", None)]
# key_name, idx, daily_limit, threshold
KEYS = [("k1", 0, 100, 0.8), ("k2", 1, 100, 0.8), ("k3", 2, 100, 0.8)]
KEYWORD_MIN_LEN = 6
TABLE_MIN_LEN = 9   # characters of a keyword of the table
SOURCE_PAGE = 10    # rows one source answers per request (the over-fetch count)
HOSTED_MAX = 8      # results asked from the hosted backend (context search default)
TODAY = "2024-01-15"  # the "today" of the counter views
# Boilerplate lines mixed into page text for the clean_text fixture.
NOISE_LINES = [
    "Copyright ⓒ Example News. All rights reserved. Contact desk@example.com for licensing and reuse terms today",
    "무단 전재 및 재배포 금지",
    "무단전재 금지",
    "AI 학습 및 이용 금지",
    "  댓글  ",
    "\n\n\n",
]


def queries_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): every benchmark item, whole text."""
    return read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def docs_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, engine, engine_pos, title, snippet, text, url, page_url, pub_date)."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"))
    events = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("pub_date"))
    n_pages = read_table(spark, sf_dir, "pages").select(F.count(F.lit(1))).scalar()
    src_no = F.expr("cast(substr(source, 4) as int)")
    pos = (src_no % N_ENGINES)
    m7 = F.col("doc_id") % 7
    url = (F.when(m7 == 0, F.concat("page_url", F.lit(".pdf")))
           .when(m7 == 1, F.concat("page_url", F.lit(".PDF?x=1")))
           .when(m7 == 2, F.concat("page_url", F.lit(".pdf#p")))
           .when(m7 == 3, F.concat("page_url", F.lit(".pdfx")))
           .when(m7 == 4, F.lit(None).cast("string"))
           .otherwise(F.col("page_url")))
    return (docs.withColumn("page_id", F.col("doc_id") % n_pages)
            .join(pages, "page_id", "left")
            .join(events, "doc_id", "left")
            .select("doc_id",
                    F.concat(F.lit("e"), pos.cast("string")).alias("engine"),
                    pos.cast("long").alias("engine_pos"),
                    F.substring_index("text", "\n", 1).alias("title"),
                    F.col("text").alias("snippet"), "text", url.alias("url"), "page_url", "pub_date"))


def keywords(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, term): distinct lexical tokens of at least KEYWORD_MIN_LEN chars."""
    return _long_tokens(df, key, text_col).distinct()


def _long_tokens(df: DataFrame, key: str, text_col: str) -> DataFrame:
    return (df.select(key, F.explode(F.array_distinct(lexical_tokens(text_col))).alias("term"))
            .filter(F.length("term") >= KEYWORD_MIN_LEN))


def keyword_table_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, keyword): tokens of at least TABLE_MIN_LEN characters of the
    benchmark, as written; the first 15 hexadecimal digits of their MD5 are their place."""
    words = F.explode(F.regexp_extract_all("query", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("keyword")
    found = queries_fx(spark, sf_dir).select(words).where(F.length("keyword") >= TABLE_MIN_LEN).distinct()
    return found.select(F.conv(F.substring(F.md5("keyword"), 1, 15), 16, 10).cast("long").alias("pos"), "keyword")


def matches_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light match table (no text): (query_id, doc_id, engine, engine_pos,
    n_shared, rank within the engine, news_rank within the query)."""
    q = queries_fx(spark, sf_dir)
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    pos = F.expr(f"cast(substr(source, 4) as int)") % N_ENGINES
    meta = docs.select("doc_id", F.concat(F.lit("e"), pos.cast("string")).alias("engine"),
                       pos.cast("long").alias("engine_pos"))
    # of the documents' terms only those that a query holds are made distinct
    asked = keywords(q, "query_id", "query")
    held = _long_tokens(docs, "doc_id", "text").join(asked.select("term").distinct(), "term", "left_semi").distinct()
    hits = (asked.join(held, "term")
            .groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n_shared")))
    w = Window.partitionBy("query_id", "engine").orderBy(F.col("n_shared").desc(), F.col("doc_id"))
    wn = Window.partitionBy("query_id").orderBy(F.col("n_shared").desc(), F.col("doc_id"))
    return (hits.join(meta, "doc_id")
            .withColumn("rank", F.row_number().over(w).cast("long"))
            .withColumn("news_rank", F.row_number().over(wn).cast("long")))


def candidates_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each simulated source returns for each query: documents of that
    engine sharing a keyword with the query, ranked by shared keywords then id.
    Texts are joined after ranking, so a bound on ``rank`` is applied before
    the text join.

    (query_id, engine, engine_pos, rank, n_shared, doc_id, title, url, snippet, pub_date, page_url)
    """
    d = docs_fx(spark, sf_dir).drop("engine", "engine_pos")
    return (matches_fx(spark, sf_dir).join(d, "doc_id")
            .select("query_id", "engine", "engine_pos", "rank", "n_shared", "doc_id", "title", "url",
                    "snippet", "pub_date", "page_url", "news_rank"))


def as_requests(items: DataFrame) -> DataFrame:
    """(query_id, query, engines) of benchmark items, engine lists cycling."""
    cycle = F.array(*[F.lit(s) for s in REQUEST_CYCLE])
    asked = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return asked.withColumn("engines", F.element_at(cycle, (F.col("query_id") % len(REQUEST_CYCLE) + 1).cast("int")))


def requests_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request per benchmark item."""
    return as_requests(read_table(spark, sf_dir, "benchmark"))


def outcomes_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, engine, outcome, detail): calls that did not answer, one
    source of most queries by query_id % 5."""
    said = F.element_at(F.array(*[F.struct(*[F.lit(x) for x in o]) for o in OUTCOME_CYCLE]),
                        (F.col("query_id") % len(OUTCOME_CYCLE) + 1).cast("int"))
    rows = queries_fx(spark, sf_dir).select("query_id", said.alias("o"))
    return rows.select("query_id", F.col("o.col1").alias("engine"), F.col("o.col2").alias("outcome"),
                       F.col("o.col3").alias("detail")).where("engine <> ''")


def sources_fx(spark: SparkSession) -> DataFrame:
    """Registry (engine, pos, is_default, shared_key_group, endpoint, call_key) — a configuration table."""
    return spark.createDataFrame(
        SOURCES, "engine string, pos long, is_default boolean, shared_key_group string, endpoint string, call_key string")


def keys_fx(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KEYS, "key_name string, idx long, daily_limit long, threshold double")


def calls_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, key): every event is one call; the key is the event type."""
    return read_table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"))


def now_lit() -> F.Column:
    return F.lit(NOW).cast("timestamp")
