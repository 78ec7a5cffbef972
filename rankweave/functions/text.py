"""Column -> Column text functions: tag stripping, entity decoding, boilerplate
cleaning, URL handling and tokenisation.

Everything here is a plain Spark SQL expression (JVM side, no Python rows).
"""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being matched; kept together, in
# natural order).
# ---------------------------------------------------------------------------

# Characters Python treats as whitespace (str.isspace / re \s on str).
PY_WS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# Line boundaries of Python's str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
# Tag patterns: a class form that may cross newlines, and the lazy form
# ``<.*?>`` whose dot stops at a newline.
TAG_CLASS = r"<[^>]+>"
TAG_LAZY = r"<[^\n]*?>"
# URL runs: scheme or www., then only characters legal in a URL.
URL_PATTERN = r"(?i)(?:https?://|www\.)[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"
# URL fragments are split on anything but ASCII letters/digits and Hangul syllables.
URL_SPLIT = r"[^0-9a-zA-Z가-힣]+"
# Scheme and domain-suffix fragments that carry no topic.
URL_NOISE = ["http", "https", "www", "com", "net", "org", "co", "kr", "html", "htm", "php"]
# Lexical token: a run of letters and digits (re-aimed lexer, see README).
TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# A character reference: numeric, or a name of at most 32 characters; ``;`` may lack.
ENTITY_PATTERN = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# The references that occur most, looked up before the whole table.
FREQUENT_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\xa0"}
# Boilerplate notices removed from extracted page text, in this order.
BOILERPLATE_PATTERNS = [
    r"(?iu)Copyright" + PY_WS + r"*[ⓒ©Cc][^\n]{0,100}",
    r"무단" + PY_WS + r"*전재" + PY_WS + r"*(및|,)?" + PY_WS + r"*재배포" + PY_WS + r"*(금지)?",
    r"무단" + PY_WS + r"*전재" + PY_WS + r"*(금지)?",
    r"AI" + PY_WS + r"*학습" + PY_WS + r"*(및|,)?" + PY_WS + r"*이용" + PY_WS + r"*금지",
    r"(?md)^" + PY_WS + r"*댓글" + PY_WS + r"*$",
]
# PDF-looking url: ".pdf" then "?", "#" or the end, any case.
PDF_PATTERN = r"(?i)\.pdf(?:[?#]|$)"

Tokenizer = Callable[[Column], Column]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Entities and tags
# ---------------------------------------------------------------------------

# Tables of the public HTML5 standard as the standard library holds them: all
# names (with and without ``;``), names that may lack it (longest first), and
# the numeric references below 160 that do not stand for their own code point.
NAMED = json.dumps(html5)
OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
LOW_CODES = json.dumps({str(n): html.unescape(f"&#{n};") for n in range(160) if html.unescape(f"&#{n};") != chr(n)})
LAST_CODE = 0x10FFFF


def _code_point(number: Column) -> Column:
    """Character of a numeric reference (long; above the last code point for
    all that are too large)."""
    table = F.from_json(F.lit(LOW_CODES), "map<string,string>")
    hidden = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return (F.when((number > LAST_CODE) | number.between(0xD800, 0xDFFF), "\ufffd")
            .when(hidden, "").when(number < 160, F.coalesce(F.element_at(table, number.cast("string")), character))
            .otherwise(character))


def _reference(ref: Column) -> Column:
    """What one character reference stands for; itself if nothing."""
    too_large = F.lit(LAST_CODE + 1).cast("long")
    digits = F.regexp_extract(ref, "^&#0*([0-9]*)", 1)
    hexes = F.regexp_extract(ref, "^&#[xX]0*([0-9a-fA-F]*)", 1)
    decimal = F.when(F.length(digits) > 9, too_large).otherwise(F.concat(F.lit("0"), digits).cast("long"))
    sixteen = F.when(F.length(hexes) > 8, too_large).otherwise(F.conv(F.concat(F.lit("0"), hexes), 16, 10).cast("long"))
    names = F.from_json(F.lit(NAMED), "map<string,string>")
    whole = F.element_at(names, F.substring(ref, 2, 40))
    start = F.regexp_extract(ref, f"^&({OPEN_NAMES})", 1)
    part = F.when(start != "", F.concat(F.element_at(names, start), F.substr(ref, F.length(start) + 2)))
    out = None
    for entity, character in FREQUENT_ENTITIES.items():
        out = (F if out is None else out).when(ref == entity, F.lit(character))
    return (out.when(ref.rlike("^&#[xX]"), _code_point(sixteen)).when(ref.rlike("^&#"), _code_point(decimal))
            .otherwise(F.coalesce(whole, part, ref)))


def decode_entities(c: Column | str) -> Column:
    """Decode every HTML5 character reference, in one pass and JVM-side: the
    references are looked up one by one between the pieces of text they part."""
    text = _col(c)
    refs = F.regexp_extract_all(text, F.lit(ENTITY_PATTERN), F.lit(0))
    gaps = F.split(text, ENTITY_PATTERN, -1)
    pieces = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(refs)).alias("gap"), refs.alias("ref")),
                         lambda z: F.concat(z["gap"], _reference(z["ref"])))
    return F.when(F.contains(text, F.lit("&")), F.concat(F.array_join(pieces, ""), F.element_at(gaps, -1))).otherwise(text)


def strip_tags(c: Column | str, lazy: bool = False) -> Column:
    """Delete tags (no replacement), then decode entities."""
    return decode_entities(F.regexp_replace(_col(c), TAG_LAZY if lazy else TAG_CLASS, ""))


def strip_tags_spaced(c: Column | str) -> Column:
    """Each tag becomes a space, then decode entities."""
    return decode_entities(F.regexp_replace(_col(c), TAG_CLASS, " "))


# ---------------------------------------------------------------------------
# Boilerplate clean and truncate
# ---------------------------------------------------------------------------

def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_col(c), rf"^{PY_WS}+|{PY_WS}+$", "")


def clean_text(c: Column | str) -> Column:
    """Drop boilerplate notices, strip every line, drop blank lines and
    join the rest with one space."""
    out = _col(c)
    for pattern in BOILERPLATE_PATTERNS:
        out = F.regexp_replace(out, pattern, "")
    lines = F.transform(F.split(out, LINE_BREAK), py_strip)
    return F.array_join(F.filter(lines, lambda x: x != F.lit("")), " ")


def truncate_text(c: Column | str, max_chars: int = 3000) -> Column:
    """P10: first ``max_chars`` code points."""
    return F.substring(_col(c), 1, max_chars)


# ---------------------------------------------------------------------------
# URLs and tokens
# ---------------------------------------------------------------------------

def extract_urls(c: Column | str) -> Column:
    """Every URL run in the text, in text order."""
    return F.regexp_extract_all(_col(c), F.lit(URL_PATTERN), 0)


def remove_urls(c: Column | str) -> Column:
    """The text with each URL run replaced by a space."""
    return F.regexp_replace(_col(c), URL_PATTERN, " ")


def url_tokens(url: Column | str) -> Column:
    """Topical fragments of one URL (lowercase, >= 2 chars, not noise,
    not all digits)."""
    noise = F.array(*[F.lit(w) for w in URL_NOISE])
    pieces = F.transform(F.filter(F.split(_col(url), URL_SPLIT), lambda p: p != F.lit("")), F.lower)
    return F.filter(
        pieces,
        lambda p: (F.length(p) >= 2) & ~F.array_contains(noise, p) & ~p.rlike(r"^[0-9]+$"),
    )


def lexical_tokens(c: Column | str) -> Column:
    """Lowercased letter/digit runs."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN_PATTERN), 0)


def url_part(cleaned: Column) -> Column:
    """URL tokens of a cleaned text; the array work runs only for texts that
    hold a URL at all."""
    return F.when(cleaned.rlike(URL_PATTERN), F.flatten(F.transform(extract_urls(cleaned), url_tokens))) \
        .otherwise(F.array().cast("array<string>"))


def tokens_from_cleaned(cleaned: Column, lexer: Tokenizer | None = None) -> Column:
    lex = (lexer or lexical_tokens)(F.when(cleaned.rlike(URL_PATTERN), remove_urls(cleaned)).otherwise(cleaned))
    return F.concat(lex, url_part(cleaned))


def clean_for_tokens(c: Column | str) -> Column:
    return strip_tags_spaced(F.coalesce(_col(c), F.lit("")))


def tokenize(c: Column | str, lexer: Tokenizer | None = None) -> Column:
    """Tags -> spaces, entities decoded, URLs pulled out; lexical tokens
    of the remainder followed by the URL tokens. ``lexer`` replaces the
    lexical step (e.g. a pandas UDF wrapping a morphological analyser).
    For large tables prefer :func:`with_tokens`, which cleans each text once."""
    return tokens_from_cleaned(clean_for_tokens(c), lexer)


def with_tokens(df, text: Column | str, out_col: str = "tokens", lexer: Tokenizer | None = None):
    """DataFrame form of :func:`tokenize`: the cleaned text is its own
    projection, so the entity chain runs once per row (Spark does not inline a
    non-trivial expression that is used twice)."""
    tmp = "__cleaned"
    return (df.withColumn(tmp, clean_for_tokens(text))
            .withColumn(out_col, tokens_from_cleaned(F.col(tmp), lexer)).drop(tmp))


def looks_like_pdf(url: Column | str) -> Column:
    """P7 predicate: true for PDF-looking urls; null/empty url gives false."""
    u = _col(url)
    return F.coalesce(u.rlike(PDF_PATTERN), F.lit(False))


def first_matching_keyword(text: Column | str, keywords: list[str]) -> Column:
    """First keyword in *list* order that occurs in the text
    (case-sensitive substring); null when none."""
    t = _col(text)
    out = F.lit(None).cast("string")
    for kw in reversed(keywords):
        out = F.when(F.instr(t, kw) > 0, F.lit(kw)).otherwise(out)
    return out
