"""Answer sinks and context assembly.

Every list is rebuilt from an explicit sort key with
``array_sort(collect_list(struct(key, value)))``, so the output does not
depend on shuffle order. Aggregation is per query (one row per query).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import routing as R
from .content import content_or

# Fixed formats of the context blocks (labels: title / URL / content).
CONTEXT_SEPARATOR = "\n\n---\n\n"
LABEL_TITLE = "제목: "
LABEL_URL = "URL: "
LABEL_BODY = "내용: "
EMPTY_BODY = "(내용 없음)"
# Our own prompt wording (no model is called; the prompt is a table column).
PROMPT_HEADER = "Search results (title, URL and page text for the top results):\n\n"
HOSTED_HEADER = "Search results of the hosted backend (title, URL and cleaned page text):\n\n"
PROMPT_INSTRUCTIONS = ("Answer only from the material above. Do not invent figures that it does "
                       "not state; say so plainly and summarise the relevant context instead. "
                       "Mention sources where they help.")
PROMPT_QUESTION = "Question: "


def ordered_join(order: Column, value: Column, sep: str) -> Column:
    """Aggregate: values joined by ``sep`` in ``order``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))),
                                    lambda s: s["v"]), sep)


def answer_text(rows: DataFrame, sections: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, answer). ``rows``: (query_id, sec_pos, rank, title, url,
    snippet, content); ``sections``: (query_id, engine, sec_pos, status, message)."""
    w = Window.partitionBy("query_id", "sec_pos").orderBy("rank")
    body = content_or(F.col("snippet"))
    item = F.concat(F.col("i").cast("string"), F.lit(". "), F.coalesce(F.col("title"), F.lit("None")),
                    F.lit("\n   "), F.coalesce(F.col("url"), F.lit("None")), F.lit("\n   "),
                    F.coalesce(body, F.lit("None")))
    per_section = (rows.withColumn("i", F.row_number().over(w))
                   .groupBy("query_id", "sec_pos").agg(ordered_join(F.col("i"), item, "\n\n").alias("items")))
    sec_body = (F.when(F.col("status") == "ok", F.coalesce(F.col("items"), F.lit(R.MSG_NO_RESULTS)))
                .otherwise(F.col("message")))
    sec_text = F.concat(F.lit("["), F.col("engine"), F.lit("]\n"), sec_body)
    per_query = (sections.join(per_section, ["query_id", "sec_pos"], "left")
                 .groupBy("query_id").agg(ordered_join(F.col("sec_pos"), sec_text, "\n\n").alias("answer")))
    return (queries.select("query_id").join(per_query, "query_id", "left")
            .select("query_id", F.coalesce("answer", F.lit(R.MSG_NO_RESULTS)).alias("answer")))


def answer_json(rows: DataFrame, sections: DataFrame, requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """(query_id, answer_json) with ``{query, engines, results[]}``;
    ``engines`` is the requested list (not the fallback); content is
    ``content or snippet``; null fields are kept."""
    res = (rows.join(sections.filter(F.col("status") == "ok").select("query_id", "sec_pos", "engine"),
                     ["query_id", "sec_pos", "engine"])
           .groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
               "sec_pos", "rank", F.struct("engine", "title", "url",
                                           content_or(F.col("snippet")).alias("content")).alias("r")))),
               lambda s: s["r"]).alias("results")))
    eng = resolved.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("req_pos", "engine"))), lambda s: s["engine"]).alias("engines"))
    j = (requests.select("query_id", "query").join(eng, "query_id", "left").join(res, "query_id", "left")
         .select("query_id", "query",
                 F.coalesce("engines", F.array().cast("array<string>")).alias("engines"),
                 F.coalesce("results", F.array().cast(
                     "array<struct<engine:string,title:string,url:string,content:string>>")).alias("results")))
    return j.select("query_id", F.to_json(F.struct("query", "engines", "results"),
                                          {"ignoreNullFields": "false"}).alias("answer_json"))


def context_blocks(links: DataFrame, order_col: str = "rerank", with_engine: bool = True) -> DataFrame:
    """A5: (query_id, context): ``[engine] title / URL / body`` blocks joined by
    a rule; an empty body shows a placeholder."""
    body = F.coalesce(F.nullif(F.col("snippet"), F.lit("")), F.lit(EMPTY_BODY))
    head = F.concat(F.lit("["), F.col("engine"), F.lit("] ")) if with_engine else F.lit("")
    block = F.concat(head, F.lit(LABEL_TITLE), F.coalesce("title", F.lit("")), F.lit("\n" + LABEL_URL),
                     F.coalesce("url", F.lit("")), F.lit("\n" + LABEL_BODY), body)
    return links.groupBy("query_id").agg(ordered_join(F.col(order_col), block, CONTEXT_SEPARATOR).alias("context"))


def hosted_blocks(hosted: DataFrame) -> DataFrame:
    """Context of the hosted backend: blocks without engine tag, full content."""
    block = F.concat(F.lit(LABEL_TITLE), F.col("title"), F.lit("\n" + LABEL_URL), F.col("url"),
                     F.lit("\n" + LABEL_BODY), F.col("content"))
    return hosted.groupBy("query_id").agg(ordered_join(F.col("rank"), block, CONTEXT_SEPARATOR).alias("context"))


def prompt_rows(requests: DataFrame, contexts: DataFrame, mode_col: str = "search_mode",
                header: str = PROMPT_HEADER) -> DataFrame:
    """(query_id, prompt). Header + context + instructions + question;
    requests whose mode is 'none' pass the message through unchanged.
    ``HOSTED_HEADER`` is the header for the hosted backend's context."""
    j = requests.join(contexts, "query_id", "left")
    prompt = F.concat(F.lit(header), F.coalesce("context", F.lit("")), F.lit("\n\n" + PROMPT_INSTRUCTIONS),
                      F.lit("\n\n" + PROMPT_QUESTION), F.col("query"))
    return j.select("query_id", F.when(F.col(mode_col) == "none", F.col("query")).otherwise(prompt).alias("prompt"))


def backend_compare(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Both backends' context for each question side by side."""
    return (ours.select("query_id", F.col("context").alias("context_ours"))
            .join(theirs.select("query_id", F.col("context").alias("context_hosted")), "query_id", "full_outer"))
