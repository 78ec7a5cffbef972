"""End-to-end compositions: news search (B9), web search (B10) and
re-ranked context search (B11), each over a *table* of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK, Tokenizer, py_strip
from ..operators import bm25, content, filters, recency, relevance, render, routing
from ..session import cut_lineage
from ..sources.pages import MAX_CHARS, content_attach

CAND_ID_SHIFT = 4294967296  # rank fits 32 bits; sec_pos lives above it


@dataclass
class WebSearchResult:
    rows: DataFrame       # query_id, engine, sec_pos, rank, title, url, snippet, content, ...
    sections: DataFrame   # query_id, engine, sec_pos, status, message, n_rows
    resolved: DataFrame   # query_id, engine, req_pos, registered
    before_pdf: DataFrame
    after_pdf: DataFrame


def _round(raw: DataFrame, sections: DataFrame, max_results: int, keywords: list[str],
           overfetch: int) -> tuple[DataFrame, DataFrame]:
    """One routing round: source rows -> P6 -> P4; statuses per section."""
    reg = sections.filter("registered").select("query_id", "engine", "sec_pos")
    fetched = filters.overfetch_limit(raw.join(reg, ["query_id", "engine"]), max_results, keywords, overfetch)
    kept = filters.exclusion_filter(fetched, max_results, keywords)
    stat = filters.policy_status(reg, fetched, kept)
    status = (F.when(~F.col("registered"), "unknown")
              .when(F.col("status") == "policy_restricted", "skip").otherwise("ok"))
    message = (F.when(~F.col("registered"), routing.MSG_UNKNOWN)
               .when(F.col("status") == "policy_restricted", routing.MSG_POLICY))
    secs = (sections.join(stat, ["query_id", "engine"], "left")
            .select("query_id", "engine", "sec_pos", status.alias("status"), message.alias("message"),
                    F.coalesce("n_kept", F.lit(0)).alias("n_rows")))
    return kept, secs


def web_search(requests: DataFrame, registry: DataFrame, source_rows: DataFrame, pages: DataFrame,
               max_results: int = 3, keywords: list[str] | tuple = (), overfetch: int = filters.OVERFETCH_COUNT,
               relevance_on: bool = True, ratio: float = relevance.MIN_SCORE_RATIO,
               fetch_content: bool = True, top_n: int = content.TOP_N, max_chars: int = MAX_CHARS,
               min_useful_chars: int = content.MIN_USEFUL_CHARS, lexer: Tokenizer | None = None,
               materialize: bool = True, outcomes: DataFrame | None = None) -> WebSearchResult:
    """R1 -> per source P6/P4 -> R3 fallback -> P7 -> B5 -> P12.

    requests (query_id, query, engines); registry (engine, pos, is_default);
    source_rows (query_id, engine, rank, title, url, snippet, ...) is what each
    source would return for each query; pages (page_id, url, html); outcomes
    (query_id, engine, outcome, detail) the calls that did not answer: their
    sources give no rows, and the fallback follows from that.

    With ``materialize`` what is read more than once is stored in the shared
    folder: the bounded source rows and the filtered rows. Routing, fallback
    and statuses are joins of their keys with the small tables of the requests.
    """
    keywords = list(keywords)
    m = cut_lineage if materialize else (lambda d: d)
    # P6 first: no source is ever asked for more than fetch_count rows, so
    # only those rows are stored (the bound reaches the source scan). Their
    # texts are read once, for the excluded keyword; routing, statuses and
    # fallback work on keys, and the texts are joined to what is left.
    source_rows = m(filters.with_excluded_keyword(
        routing.answered(filters.overfetch_limit(source_rows, max_results, keywords, overfetch), outcomes), keywords, "_kw"))
    keys = source_rows.select("query_id", "engine", "rank", "_kw")
    requests = requests.select("query_id", "query", "engines")
    resolved = routing.resolve_sources(requests, registry)
    first = resolved.select("query_id", "engine", F.col("req_pos").alias("sec_pos"), "registered")
    kept1, secs1 = _round(keys, first, max_results, keywords, overfetch)
    fb = routing.fallback_sources(requests, resolved, kept1.select("query_id"), registry)
    kept2, secs2 = _round(keys, fb.withColumn("registered", F.lit(True)), max_results, keywords, overfetch)
    sections = routing.source_status(secs1.unionByName(secs2), outcomes)
    texts = source_rows.drop("_kw").withColumnRenamed("rank", "src_rank")
    rows = kept1.unionByName(kept2).drop("_kw").join(texts, ["query_id", "engine", "src_rank"])
    after_pdf = filters.pdf_filter(rows)
    out = after_pdf
    if relevance_on:
        out = out.withColumn("cand_id", F.col("sec_pos") * CAND_ID_SHIFT + F.col("rank"))
        out = relevance.relevance_filter(out, requests.select("query_id", "query"), "cand_id", ratio,
                                         lexer=lexer).drop("cand_id", "tokens", "has_terms", "best")
        out = m(out)
    if fetch_content:
        out = content.enrich_top_n(out, pages, top_n, max_chars, min_useful_chars)
    else:
        out = out.withColumn("content", F.lit(None).cast("string"))
    return WebSearchResult(out, sections, resolved, rows, after_pdf)


def web_search_text(requests: DataFrame, registry: DataFrame, source_rows: DataFrame, pages: DataFrame,
                    **kw) -> DataFrame:
    r = web_search(requests, registry, source_rows, pages, **kw)
    return render.answer_text(r.rows, r.sections, requests)


def links_of(rows: DataFrame) -> DataFrame:
    """(query_id, record, engine, title, url, snippet) of the rows of a search,
    in answer order; a body becomes one line."""
    lines = F.transform(F.split(F.coalesce(content.content_or(F.col("snippet")), F.lit("")), LINE_BREAK), py_strip)
    w = Window.partitionBy("query_id").orderBy("sec_pos", "rank")
    return rows.select("query_id", F.row_number().over(w).cast("long").alias("record"), "engine", "title",
                       F.coalesce("url", F.lit("")).alias("url"),
                       F.array_join(F.filter(lines, lambda x: x != F.lit("")), " ").alias("snippet"))


def context_search(requests: DataFrame, registry: DataFrame, source_rows: DataFrame, pages: DataFrame,
                   max_results: int = 8, top_k: int = relevance.RERANK_TOP_K, lexer: Tokenizer | None = None,
                   **kw) -> DataFrame:
    """Web search over the default sources, its rows as links, relevance
    re-rank (B6). Returns (query_id, rerank, engine, title, url, snippet). Rows
    stay structured; :func:`listing.parse_sections` reads links from an
    answer that is text."""
    all_req = requests.withColumn("engines", F.lit("all"))
    found = web_search(all_req, registry, source_rows, pages, max_results=max_results, lexer=lexer, **kw)
    links = links_of(found.rows).withColumn("link_id", F.col("record"))
    ranked = relevance.relevance_rerank(links, requests.select("query_id", "query"), "link_id", "record",
                                        top_k=top_k, lexer=lexer)
    return ranked.select("query_id", "rerank", "engine", "title", "url", "snippet", "score")


def news_rank(items: DataFrame, queries: DataFrame, pages: DataFrame | None,
              max_chars: int = MAX_CHARS, lexer: Tokenizer | None = None) -> DataFrame:
    """B9 core: (items + optional content) -> BM25 over each query's items.
    items: (query_id, item_pos, title, url, description, pub_date).
    Adds content, bm25_score, bm25_pos."""
    if pages is not None:
        items = content_attach(items, pages, max_chars, clean=False)
    else:
        items = items.withColumn("content", F.lit(""))
    text = F.concat_ws(" ", F.col("title"), content.content_or(F.col("description")))
    scored = relevance.candidate_scores(items, queries, "item_pos", text, lexer=lexer)
    w = Window.partitionBy("query_id").orderBy(*bm25.rank_order("score", ("item_pos",)))
    return (scored.withColumn("bm25_pos", F.row_number().over(w).cast("long"))
            .withColumnRenamed("score", "bm25_score"))


def news_search(items: DataFrame, queries: DataFrame, pages: DataFrame | None, now: Column,
                top_k: int = recency.TOP_K, decay_lambda: float = recency.DECAY_LAMBDA,
                max_chars: int = MAX_CHARS, lexer: Tokenizer | None = None) -> DataFrame:
    """News items -> content -> tokens -> BM25 -> recency re-rank."""
    ranked = news_rank(items, queries, pages, max_chars, lexer)
    return recency.recency_rerank(ranked, now, top_k, decay_lambda)
