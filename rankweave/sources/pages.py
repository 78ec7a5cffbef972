"""Pages table -> article text (P8) and content attach by url.

Main-text contract (our own; a third-party extractor is not matched byte for
byte). A page is cut into blocks at block tags; a block knows its characters,
those of them inside links, and the part of the tree it lies in. Scripts,
styles, comments and head are no text, and blocks inside nav, header, footer,
aside, form or a container whose id or class names comments or ads are no
candidates. The main text is the connected run of blocks of the greatest sum
of ``characters - LINK_COST x link characters`` (link lists, menus and teasers
weigh against the text around them, less so inside an article), without the blocks of the run that weigh
less than nothing. Runs lie inside one article: the first whose best run weighs at
least half as much as that of any; without text in an article inside
``<main>``, then anywhere. A page without an article, main or paragraph has
no main text (empty). Inline tags vanish, entities are decoded, white-space
runs inside a line collapse to one space, lines are stripped, blank ones
dropped.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, truncate_text

MAX_CHARS = 3000
#: weight of a link character against one of text: inside an article or main, where a list of links may stand between
#: paragraphs, and elsewhere, where it parts the text from menus
LINK_COST = (1.2, 2.5)
#: an article counts as the main one from this share of the best article's weight
MAIN_SHARE = 0.5

# Fixed values of the extraction contract: tags, and class or id words of unwanted containers.
RAW_TAGS = ("script", "style", "noscript")
DROP_TAGS = frozenset(("head", "title", "nav", "header", "footer", "aside", "form"))
SCOPES = DROP_TAGS | {"article", "main", "body"}
CONTAINERS = SCOPES | {"div", "section", "ul", "ol", "table", "blockquote"}
BLOCK_TAGS = CONTAINERS | frozenset(("p", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "td", "th", "pre", "hr", "html"))
UNWANTED_TAGS = frozenset(("div", "section", "ul", "ol"))
UNWANTED = re.compile(r"\b(?:id|class)\s*=\s*[\"'](?:[^\"']*[\s_-])?(?:ad|ads|advert|advertisement|comment|comments|commentlist|"
                      r"reply|replies|disqus[a-z_]*)(?:[\s_-][^\"']*)?[\"']", re.I)
MARKUP = re.compile(rf"<!--.*?-->|<({'|'.join(RAW_TAGS)})\b[^>]*>.*?</\1\s*>|<(/?)([a-z][a-z0-9]*)\b([^>]*)>|<[^>]+>", re.I | re.S)
INLINE_SPACE = re.compile(r"[\t\x0b\f\r \xa0]+")
BLOCK_TYPE = pa.list_(pa.struct([("text", pa.string()), ("chars", pa.int64()), ("links", pa.int64()), ("part", pa.int32())]))
BLOCK_DDL = "array<struct<text:string,chars:bigint,links:bigint,part:int>>"
IN_MAIN, ELSEWHERE = -1, 0


def blocks_of(page: str | None) -> list[dict]:
    """Candidate blocks of a page in order, in one pass: text, characters,
    characters in links, and the part: the number of its article from 1, or
    IN_MAIN, or ELSEWHERE."""
    out: list[dict] = []
    stack: list[tuple[str, bool, int | None]] = []  # open containers: tag, dropped, part
    text: list[str] = []
    linked = articles = links = 0
    paragraph = False

    def part() -> int:
        return next((p for _, _, p in stack if p is not None and p > 0), next((p for _, _, p in stack if p is not None), ELSEWHERE))

    def flush() -> None:
        nonlocal text, linked
        lines = (INLINE_SPACE.sub(" ", x).strip() for x in entities.unescape("".join(text)).split("\n"))
        whole = "\n".join(x for x in lines if x)
        if whole:
            out.append({"text": whole, "chars": len(whole), "links": min(linked, len(whole)), "part": part()})
        text, linked = [], 0

    def take(piece: str) -> None:
        nonlocal linked
        if piece and not any(dropped for _, dropped, _ in stack):
            text.append(piece)
            linked += len(piece.strip()) if links else 0

    at = 0
    for m in MARKUP.finditer(page or ""):
        take(page[at:m.start()])
        at = m.end()
        if m.group(3) is None:
            if text:
                text.append(" " if m.group(1) or m.group(0).startswith("<!--") else "")
            continue
        closes, tag = m.group(2) == "/", m.group(3).lower()
        if tag == "a":
            links = max(0, links + (-1 if closes else 1))
        if tag not in BLOCK_TAGS:
            continue
        flush()
        links = 0 if tag in CONTAINERS else links
        if tag in CONTAINERS and not closes:
            dropped = tag in DROP_TAGS or (tag in UNWANTED_TAGS and UNWANTED.search(m.group(4)) is not None)
            articles += tag == "article" and not dropped
            stack.append((tag, dropped, articles if tag == "article" else IN_MAIN if tag == "main" else None))
        elif tag in CONTAINERS:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES and tag not in SCOPES:
                    break  # a stray end tag closes nothing outside
        if tag in ("article", "main", "p") and not closes and not any(dropped for _, dropped, _ in stack):
            paragraph = True
    take((page or "")[at:])
    flush()
    return out if paragraph else []


def page_blocks(html: Column) -> Column:
    """:func:`blocks_of` for a column of raw HTML, Arrow batches at a time."""
    def of(pages: pa.Array) -> pa.Array:
        return pa.array((blocks_of(x.as_py()) for x in pages), BLOCK_TYPE)

    return F.arrow_udf(of, BLOCK_DDL)(html)


def _weight(block: Column) -> Column:
    cost = F.when(block["part"] == ELSEWHERE, LINK_COST[1]).otherwise(LINK_COST[0])
    return block["chars"] - cost * block["links"]


def _best_run(blocks: Column) -> Column:
    """Struct (best, first, last): the run of blocks of the greatest weight, by
    one pass that carries the best run so far and the best one ending here."""
    start = F.struct(F.lit(0.0).alias("best"), F.lit(0).alias("first"), F.lit(-1).alias("last"), F.lit(0.0).alias("open"),
                     F.lit(0).alias("since"), F.lit(0).alias("at"))

    def step(s: Column, block: Column) -> Column:
        fresh = s["open"] <= 0
        run = F.when(fresh, F.lit(0.0)).otherwise(s["open"]) + _weight(block)
        since = F.when(fresh, s["at"]).otherwise(s["since"])
        better = run > s["best"]
        return F.struct(F.when(better, run).otherwise(s["best"]).alias("best"), F.when(better, since).otherwise(s["first"]).alias("first"),
                        F.when(better, s["at"]).otherwise(s["last"]).alias("last"), run.alias("open"), since.alias("since"),
                        (s["at"] + 1).alias("at"))

    return F.aggregate(blocks, start, step)


def main_text(blocks: Column) -> Column:
    """The main text of a page's blocks."""
    def run_of(inside: Column) -> Column:
        return F.struct(_best_run(inside).alias("run"), inside.alias("blocks"))

    parts = F.array_distinct(F.transform(blocks, lambda x: x["part"]))
    runs = F.transform(parts, lambda p: F.struct(p.alias("part"), run_of(F.filter(blocks, lambda x: x["part"] == p)).alias("r")))
    articles = F.filter(runs, lambda x: (x["part"] > 0) & (x["r"]["run"]["best"] > 0))
    heaviest = F.array_max(F.transform(articles, lambda x: x["r"]["run"]["best"]))
    first = F.filter(articles, lambda x: x["r"]["run"]["best"] >= MAIN_SHARE * heaviest)
    in_main = F.filter(runs, lambda x: (x["part"] == IN_MAIN) & (x["r"]["run"]["best"] > 0))
    anywhere = run_of(F.filter(blocks, lambda x: x["part"] <= 0))
    chosen = (F.when(F.size(first) > 0, F.get(first, F.lit(0))["r"]).when(F.size(in_main) > 0, F.get(in_main, F.lit(0))["r"])
              .otherwise(anywhere))
    within = F.slice(chosen["blocks"], chosen["run"]["first"] + 1, chosen["run"]["last"] - chosen["run"]["first"] + 1)
    return F.array_join(F.transform(F.filter(within, lambda x: _weight(x) > 0), lambda x: x["text"]), "\n")


def with_main_text(df: DataFrame, html_col: str, out_col: str) -> DataFrame:
    """Add the main text of a column of raw HTML; blocks are their own projection, so pages are scanned once."""
    tmp = "__blocks"
    return df.withColumn(tmp, page_blocks(F.col(html_col))).withColumn(out_col, main_text(F.col(tmp))).drop(tmp)


def page_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): main text of every page (the scanning is spread
    over the cluster when the scan gives too few splits)."""
    from ..operators.bm25 import spread
    pages = spread(pages.select("page_id", "url", "html"), "page_id")
    return with_main_text(pages, "html", "text").select("page_id", "url", "text")


def pages_for_urls(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, html) for the wanted urls only, one page per url (lowest id).
    The semi-join runs before any extraction, so only joined pages are parsed."""
    wanted = urls.select("url").filter(F.col("url").isNotNull() & (F.col("url") != "")).distinct()
    return (pages.select("page_id", "url", "html").join(wanted, "url", "left_semi")
            .groupBy("url").agg(F.min_by("html", "page_id").alias("html")))


def content_for_urls(pages: DataFrame, urls: DataFrame, max_chars: int = MAX_CHARS,
                     clean: bool = False) -> DataFrame:
    """(url, content): extracted text, optionally boilerplate-cleaned (server
    form), truncated to ``max_chars``."""
    p = with_main_text(pages_for_urls(pages, urls), "html", "text")
    text = clean_text(F.col("text")) if clean else F.col("text")
    return p.select("url", truncate_text(text, max_chars).alias("content"))


def content_attach(cands: DataFrame, pages: DataFrame, max_chars: int = MAX_CHARS,
                   clean: bool = False) -> DataFrame:
    """Left join page content on url; rows with no url or no page get ''."""
    content = content_for_urls(pages, cands.select("url"), max_chars, clean)
    return (cands.join(content, "url", "left")
            .withColumn("content", F.coalesce(F.col("content"), F.lit(""))))
