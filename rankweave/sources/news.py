"""Source payloads -> result rows (S1-S4) and the union of sources.

Each source's list position becomes an explicit ``rank`` (1-based) column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_tags

ITEM_FIELDS = "title string, originallink string, link string, description string, pubDate string"
PAYLOAD_SCHEMA = f"struct<items: array<struct<{ITEM_FIELDS.replace(' string', ': string')}>>>"
# Fixed default: characters of hosted content shown as the display snippet.
HOSTED_SNIPPET_CHARS = 200
RESULT_COLUMNS = ["query_id", "engine", "engine_pos", "rank", "title", "url", "snippet"]


# Zone names of mail dates with their hours from UTC, the months, and the forms of a date.
ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6,
         "PST": -8, "PDT": -7}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_MONTH = "|".join(f"{m}|{m[:3]}" for m in MONTHS)
_TIME = r"(?<hour>\d{1,2})[:.](?<minute>\d{1,2})(?:[:.](?<second>\d{1,2}))?(?:\.\d+)?"
_START = r"(?i)^(?:[a-z]+\.?\s*,?\s+)?"
_ZONE = r"\s*(?<zone>\S*)$"
DATE_FORMS = [
    rf"{_START}(?<day>\d{{1,2}})[ -](?<month>{_MONTH}),?[ -](?<year>\d{{4}}|\d{{2}}),? {_TIME}{_ZONE}",
    rf"{_START}(?<month>{_MONTH})[ -](?<day>\d{{1,2}}),?[ -](?<year>\d{{4}}|\d{{2}}),? {_TIME}{_ZONE}",
    rf"{_START}(?<month>{_MONTH}) (?<day>\d{{1,2}}),? {_TIME} (?<year>\d{{4}}|\d{{2}})(?<zone>)$",
]


def _fields(s: Column, form: str) -> Column:
    """The parts of a date of one form, null if the text is none."""
    names = re.findall(r"\(\?<(\w+)>", form)
    parts = F.struct(*[F.regexp_extract(s, form, k + 1).alias(n) for k, n in enumerate(names)])
    wanted = ("year", "month", "day", "hour", "minute", "second", "zone")
    return F.when(s.rlike(form), F.struct(*[parts[n].alias(n) for n in wanted]))


def parse_rfc2822(c: Column) -> Column:
    """Mail date -> timestamp, null when unparseable. Day or month come first,
    the year may stand behind the time, time parts are parted by colons or
    dots; weekday, seconds and zone may lack, comments in brackets are
    ignored, years of two digits are 1969 to 2068. A zone is a name or a number
    (hours x 100 + minutes); without one, or with any other, a date is UTC."""
    s = F.trim(F.regexp_replace(F.regexp_replace(c, r"\([^()]*\)", " "), r"\s+", " "))
    # the parts are bound once: every use of the expression would match the forms again
    found = F.coalesce(*[_fields(s, form) for form in DATE_FORMS])
    return F.get(F.transform(F.array(found), _instant), F.lit(0))


def _instant(found: Column) -> Column:
    short = F.array(*[F.lit(m[:3]) for m in MONTHS])
    month = F.array_position(short, F.lower(F.substring(found["month"], 1, 3))).cast("int")
    number = lambda x: F.when(x == "", 0).otherwise(x.cast("int"))
    year = number(found["year"])
    year = F.when(year > 99, year).when(year > 68, year + 1900).otherwise(year + 2000)
    named = F.element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), F.upper(found["zone"])) * 3600
    digits = F.when(found["zone"].rlike(r"^[+-]?\d{1,4}$"), F.regexp_replace(found["zone"], r"^\+", "").cast("int"))
    clock = F.floor(F.abs(digits) / 100) * 3600 + F.abs(digits) % 100 * 60
    offset = F.coalesce(named, F.when(digits < 0, -clock).otherwise(clock), F.lit(0))
    there = F.try_make_timestamp(year, month, number(found["day"]), number(found["hour"]), number(found["minute"]),
                                 number(found["second"]), F.lit("UTC"))
    return F.timestamp_seconds(F.unix_timestamp(there) - offset)


def _items(payloads: DataFrame, key_cols: list[str], payload_col: str) -> DataFrame:
    parsed = F.from_json(F.col(payload_col), PAYLOAD_SCHEMA)
    return (payloads.select(*key_cols, F.posexplode(F.coalesce(parsed["items"], F.array())).alias("p", "it"))
            .select(*key_cols, (F.col("p") + 1).cast("long").alias("rank"), "it.*"))


def _url(c_orig: str = "originallink", c_link: str = "link") -> Column:
    return F.coalesce(F.nullif(F.col(c_orig), F.lit("")), F.col(c_link))


def news_items(payloads: DataFrame, key_cols: list[str] | None = None,
               payload_col: str = "payload") -> DataFrame:
    """``{"items": [...]}`` -> (keys, rank, title, url, description, pub_date):
    tags deleted then entities decoded; url = originallink unless empty, else link."""
    keys = key_cols or ["query_id"]
    it = _items(payloads, keys, payload_col)
    return it.select(*keys, "rank", strip_tags(F.col("title")).alias("title"), _url().alias("url"),
                     strip_tags(F.col("description")).alias("description"),
                     parse_rfc2822(F.col("pubDate")).alias("pub_date"))


def vertical_items(payloads: DataFrame, key_cols: list[str] | None = None,
                   payload_col: str = "payload") -> DataFrame:
    """Same payload without dates; description becomes the snippet; tags
    removed with the lazy ``<.*?>`` form."""
    keys = key_cols or ["query_id", "engine"]
    it = _items(payloads, keys, payload_col)
    return it.select(*keys, "rank", strip_tags(F.col("title"), lazy=True).alias("title"), _url().alias("url"),
                     strip_tags(F.col("description"), lazy=True).alias("snippet"))


def keyless_items(raw: DataFrame) -> DataFrame:
    """S3: (title, href, body) -> (title, url, snippet)."""
    return raw.withColumnRenamed("href", "url").withColumnRenamed("body", "snippet")


def hosted_items(raw: DataFrame, engine: str = "hosted") -> DataFrame:
    """Missing title/url/content become ''; the display snippet is the
    first 200 characters; the full content is kept for prompts."""
    content = F.coalesce(F.col("content"), F.lit(""))
    return raw.select(
        *[c for c in raw.columns if c not in ("title", "url", "content")],
        F.lit(engine).alias("engine"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.substring(content, 1, HOSTED_SNIPPET_CHARS).alias("snippet"),
        content.alias("content"))


def source_union(*frames: DataFrame) -> DataFrame:
    """All sources' rows in one table; order = (engine_pos, rank)."""
    out = None
    for f in frames:
        f = f.select(*RESULT_COLUMNS)
        out = f if out is None else out.unionByName(f)
    return out
