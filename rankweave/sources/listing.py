"""Plain-text result listings -> rows.

A listing is split into lines with their positions; a header line opens a
record and the record number of every line is the running count of headers
before it (a window over the listing). Lines are then grouped by
(listing, record), and ordered joins use sorted (pos, line) structs. Each
listing is one window partition; listings are independent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK, PY_WS, py_strip

# Fixed patterns of the two listing shapes.
RECORD_HEAD = r"^\p{Nd}+\." + PY_WS + r"+(.*)$"
URL_LINE_PREFIX = "URL:"
SECTION_HEAD = r"^\[([\p{L}\p{N}_]+)\]$"
LINK_PREFIXES = ("http://", "https://")


def _lines(df: DataFrame, key: str, text_col: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), LINE_BREAK))
                     .alias("pos", "line"))


def _join_snippet(cond: F.Column, value: F.Column) -> F.Column:
    parts = F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("pos"), value.alias("v")))))
    return F.array_join(F.transform(parts, lambda s: s["v"]), " ")


def parse_listing(df: DataFrame, key: str = "listing_id", text_col: str = "text", source: str | None = None) -> DataFrame:
    """``N. title`` opens a record, a ``URL:`` line sets its url (last one
    wins), other non-blank lines join the snippet with one space; lines before
    the first record are ignored. -> (key, record, title, url, snippet).
    With ``source`` a listing without a record gives one row that holds the
    source's name as title and the whole text as snippet."""
    if source is not None:
        records = parse_listing(df, key, text_col)
        bare = df.join(records.select(key).distinct(), key, "left_anti").select(
            key, F.lit(1).cast("long").alias("record"), F.lit(source).alias("title"), F.lit("").alias("url"),
            F.col(text_col).alias("snippet"))
        return records.unionByName(bare)
    lines = _lines(df, key, text_col)
    is_head = F.col("line").rlike(RECORD_HEAD)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stripped = py_strip(F.col("line"))
    tagged = (lines.withColumn("is_head", is_head)
              .withColumn("record", F.sum(F.col("is_head").cast("long")).over(w))
              .filter(F.col("record") > 0)
              .withColumn("s", stripped))
    is_url = ~F.col("is_head") & F.col("s").startswith(URL_LINE_PREFIX)
    # text after the *first* "URL:" on the line
    url_val = py_strip(F.expr(f"substr(line, instr(line, '{URL_LINE_PREFIX}') + {len(URL_LINE_PREFIX)})"))
    is_text = ~F.col("is_head") & ~is_url & (F.col("s") != "")
    return (tagged.groupBy(key, "record").agg(
        F.max(F.when(F.col("is_head"), py_strip(F.regexp_extract("line", RECORD_HEAD, 1)))).alias("title"),
        F.coalesce(F.max_by(F.when(is_url, url_val), F.when(is_url, F.col("pos"))), F.lit("")).alias("url"),
        _join_snippet(is_text, F.col("s")).alias("snippet")))


def parse_sections(df: DataFrame, key: str = "listing_id", text_col: str = "text") -> DataFrame:
    """As S5 on stripped lines, plus ``[engine]`` header lines carried
    forward; a line starting with http:// or https:// sets the url.
    -> (key, record, engine, title, url, snippet)."""
    lines = _lines(df, key, text_col).withColumn("s", py_strip(F.col("line")))
    is_sec = F.col("s").rlike(SECTION_HEAD)
    is_head = ~is_sec & F.col("s").rlike(r"^\p{Nd}+\." + PY_WS + r"+(.*)$")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tagged = (lines.withColumn("is_sec", is_sec).withColumn("is_head", is_head)
              .withColumn("sec", F.when(F.col("is_sec"), F.regexp_extract("s", SECTION_HEAD, 1)))
              .withColumn("engine", F.last("sec", ignorenulls=True).over(w))
              .withColumn("record", F.sum(F.col("is_head").cast("long")).over(w))
              .filter(F.col("record") > 0))
    is_url = ~F.col("is_sec") & ~F.col("is_head") & (
        F.col("s").startswith(LINK_PREFIXES[0]) | F.col("s").startswith(LINK_PREFIXES[1]))
    is_text = ~F.col("is_sec") & ~F.col("is_head") & ~is_url & (F.col("s") != "")
    return (tagged.groupBy(key, "record").agg(
        F.max(F.when(F.col("is_head"), F.col("engine"))).alias("engine"),
        F.max(F.when(F.col("is_head"), F.regexp_extract("s", r"^\p{Nd}+\." + PY_WS + r"+(.*)$", 1))).alias("title"),
        F.coalesce(F.max_by(F.when(is_url, F.col("s")), F.when(is_url, F.col("pos"))), F.lit("")).alias("url"),
        _join_snippet(is_text, F.col("s")).alias("snippet")))


def render_listing(rows: DataFrame, key: str, preamble: str = "Results:") -> DataFrame:
    """Numbered listing text per key from (key, rank, title, url, snippet):
    ``N. title`` / ``   URL: url`` / snippet lines, records separated by a
    blank line, after a preamble line."""
    block = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("title"), F.lit("\n   URL: "),
                     F.coalesce("url", F.lit("")), F.lit("\n   "), F.col("snippet"))
    parts = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return rows.groupBy(key).agg(F.concat(F.lit(preamble + "\n\n"),
                                          F.array_join(F.transform(parts, lambda s: s["b"]), "\n\n")).alias("text"))
