"""URL filter: path and host rules, then naive Bayes over segmented names.

A rule (host, path) fits its host and all subdomains where the url's path
starts with the rule's; the longest rule that fits decides. Urls without a
rule are judged by a multinomial naive Bayes classifier over the words of
host and path. Host labels such as ``cheappills`` are split by unigram Viterbi:
word counts come from the separated parts of labels and from paths over all
urls, and every label is joined with the words among its own substrings, so
neither words nor labels are gathered anywhere. The classifier is fitted on
all urls, taking those that hold a seed word as bad examples and the others
as good ones, and so learns the words that come with the seeds.

Urls with the same host and path words are judged once (a host may hold any
part of all rows) and joined back.

Nulls and ties: a null url or one without ``://`` has an empty host and path,
fits no rule and is allowed, as is a url without words; equal scores allow;
equally long rules: the one first in text order decides. Repeated rows are
judged alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import string

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

ALLOW, BLOCK = "allow", "block"

#: (verdict, host, path)
RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)

# Words of unwanted hosts.
SEEDS = """
ads adult bet bets betting bitcoin bonus casino cheap clickbait crack escort gamble gambling hack jackpot keygen loan
loans lottery malware nude phishing pills poker porn roulette sex slots spam torrent tracker viagra virus warez xxx
""".split()
SEED_COUNT = 10
LONGEST_WORD = 24
SMOOTHING = 1.0


# -- parts of a url --------------------------------------------------------------------

def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """Behind the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the rule that decides (null: none)."""
    fits = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p),
                   F.struct(F.lit(-len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for v, h, p in rules]
    best = F.array_min(F.array_compact(F.array(*fits)))
    return best["rule"], best["verdict"]


def _labels(host: Column) -> Column:
    """Runs of letters of a host, lower case."""
    return F.filter(F.split(F.lower(host), r"[^\p{L}]+"), lambda x: F.length(x) > 0)


def _path_words(path: Column) -> Column:
    """Words of a path, lower case; a number is ``#``."""
    words = F.split(F.regexp_replace(F.lower(path), r"\p{N}+", " # "), r"[^\p{L}#]+")
    return F.filter(words, lambda x: F.length(x) > 0)


# -- segmentation ----------------------------------------------------------------------

def word_counts(urls: DataFrame) -> DataFrame:
    """(word, n): separated parts of host labels and words of paths, by
    urls, and the seeds. ``urls``: host, path, n."""
    inner = F.filter(F.split(F.lower("host"), r"\."), lambda x: x.rlike(r"\p{L}[^\p{L}]+\p{L}"))
    parts = F.flatten(F.transform(inner, lambda x: F.split(x, r"[^\p{L}]+")))
    words = urls.select("n", F.explode(F.concat(parts, _path_words(F.col("path")))).alias("word"))
    seeds = urls.sparkSession.createDataFrame([(SEED_COUNT, w) for w in SEEDS], "n long, word string")
    return (words.unionByName(seeds).where((F.length("word") > 1) & (F.length("word") <= LONGEST_WORD))
            .groupBy("word").agg(F.sum("n").alias("n")))


def split_label(label: str, counts: dict[str, int], total: float) -> list[str]:
    """Most likely words of a label; a run that is no word costs a factor of
    ten for each letter, so it stays whole."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    known = {}
    for w, n in counts.items():
        known.setdefault(len(w), set()).add(w)
    for end in range(1, len(label) + 1):
        options = []
        for size in known:
            if size <= end and label[end - size:end] in known[size]:
                options.append((best[end - size][0] + math.log(counts[label[end - size:end]] / total), -size))
        for start in range(max(0, end - LONGEST_WORD), end):
            options.append((best[start][0] + math.log(10 / total) - (end - start) * math.log(10), start - end))
        score, size = max(options)
        best.append((score, -size))
    out, end = [], len(label)
    while end:
        out.append(label[end - best[end][1]:end])
        end -= best[end][1]
    return out[::-1]


def segment(labels: DataFrame, words: DataFrame, total: float) -> DataFrame:
    """(label, parts) for the distinct labels: joined with the words among their substrings."""
    places = labels.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("at"))
    spans = places.select("label", "at", F.explode(F.sequence(
        F.lit(2), F.greatest(F.lit(2), F.least(F.lit(LONGEST_WORD), F.length("label") - F.col("at") + 1)))).alias("size"))
    pieces = spans.select("label", F.substring("label", F.col("at"), F.col("size")).alias("word")).distinct()
    known = pieces.join(words, "word").groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))
    joined = labels.join(known, "label", "left")

    def split(frames):
        for f in frames:
            yield pd.DataFrame({"label": f["label"], "parts": [
                split_label(x, {} if k is None else dict(k), total) for x, k in zip(f["label"], f["known"])]})

    return joined.mapInPandas(split, "label string, parts array<string>")


# -- filter ------------------------------------------------------------------------------

def classify(urls: DataFrame) -> DataFrame:
    """(host, path, words, score) for stored distinct urls (host, path, n):
    score is the log odds of block against allow."""
    spark = urls.sparkSession
    words = materialize(word_counts(urls), "url-words")
    total = float(words.agg(F.sum("n")).first()[0])
    labels = materialize(urls.select(F.explode(_labels(F.col("host"))).alias("label")).distinct(), "url-labels")
    parts = materialize(segment(labels, words, total), "url-parts")
    hosts = urls.select("host").distinct()
    named = (hosts.select("host", F.posexplode(_labels(F.col("host"))).alias("at", "label")).join(parts, "label")
             .groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "parts"))),
                                                        lambda x: x["parts"])).alias("host_words")))
    bag = urls.join(named, "host", "left").select(
        "host", "path", "n", F.concat(F.coalesce("host_words", F.array().cast("array<string>")),
                                      _path_words(F.col("path"))).alias("words"))
    bag = materialize(bag.withColumn("bad", F.arrays_overlap("words", F.array(*[F.lit(w) for w in SEEDS]))), "url-bags")
    tokens = bag.select("host", "path", "n", "bad", F.explode("words").alias("word"))
    sums = [F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"),
            F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("good")]
    counted = materialize(tokens.groupBy("word").agg(*sums), "url-word-classes")
    # three sums reach the driver
    whole = counted.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("words")).first()
    prior = bag.agg(*sums).first()
    start = math.log(((prior.bad or 0) + SMOOTHING) / ((prior.good or 0) + SMOOTHING))
    rate = lambda c, all_: F.log((F.col(c) + SMOOTHING) / ((all_ or 0) + SMOOTHING * (whole.words + 1)))
    odds = counted.select("word", (rate("bad", whole.bad) - rate("good", whole.good)).alias("odds"))
    scores = tokens.join(odds, "word").groupBy("host", "path").agg(F.sum("odds").alias("sum"))
    return bag.join(scores, ["host", "path"], "left").select(
        "host", "path", "words", (F.lit(start) + F.coalesce("sum", F.lit(0.0))).alias("score"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per page: id, host, path, rule (null: none), verdict, score
    (log odds of block) and words."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(host_of(url), F.lit("")).alias("host"),
                        F.coalesce(path_of(url), F.lit("")).alias("path"))
    # a path stands for its words when it is judged
    shape = F.concat(F.lit("/"), F.array_join(_path_words(F.col("path")), "/"))
    rows = rows.withColumn("shape", shape)
    distinct = materialize(rows.groupBy("host", F.col("shape").alias("path")).agg(F.count("*").alias("n")), "url-distinct")
    judged = materialize(classify(distinct).withColumnRenamed("path", "shape"), "url-judged")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when((F.size("words") > 0) & (F.col("score") > 0), BLOCK).otherwise(ALLOW)
    return (rows.join(judged, ["host", "shape"])
            .select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
                    "score", "words"))
