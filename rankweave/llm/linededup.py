"""Removal of boilerplate lines by their spread over sites.

A line is known by the hash of its normal form (trimmed, lower case, white
space runs as one space). For each hash a HyperLogLog sketch of the sites it
occurs on is built in every task and merged by aggregation. Lines whose
estimate lies clearly above ``min_sites`` are boilerplate, those clearly below
are not; lines near the threshold get an exact count of their sites. Boilerplate
lines are removed from every document.

Nulls and ties: a null text stays null; a null site is no site; lines
without a letter or digit are no candidates and stay; what goes from a text
depends on the text and the corpus only, so repeated rows are cleaned alike. A
text that keeps no line becomes empty. An empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MIN_SITES = 5
#: 2**LOG_BUCKETS registers: a standard error of 1.04 / 2**(LOG_BUCKETS / 2)
LOG_BUCKETS = 10
#: standard errors around the threshold that are counted exactly
MARGIN = 4.0


def line_hash(line: Column) -> Column:
    """Hash of a line's normal form; null without a letter or digit."""
    plain = F.lower(F.trim(F.regexp_replace(line, r"[\x09\x0B-\x0D\x20]+", " ")))
    return F.when(plain.rlike(r"[\p{L}\d]"), F.xxhash64(plain))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def hashed_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """Stored (hash of the text, site, lines: hash of each line in order)."""
    text = F.col(text_col)
    return materialize(docs.where(text.isNotNull()).select(
        F.xxhash64(text).alias("hash"), F.col(site_col).cast("string").alias("site"),
        F.transform(_lines(text), line_hash).alias("lines")), "line-hashes")


def _occurrences(lines: DataFrame) -> DataFrame:
    """(site, line), a line once for each row that holds it."""
    return (lines.where("site is not null").select("site", F.explode(F.array_distinct("lines")).alias("line"))
            .where("line is not null"))


def spread(lines: DataFrame, log_buckets: int = LOG_BUCKETS) -> DataFrame:
    """(line, sites): estimated number of sites of every line hash."""
    return _occurrences(lines).groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log_buckets))).alias("sites"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, log_buckets: int = LOG_BUCKETS) -> DataFrame:
    """(line, sites) of the lines on at least ``min_sites`` sites; ``sites``
    is exact for those near the threshold, else the estimate."""
    slack = MARGIN * 1.04 / 2 ** (log_buckets / 2) * min_sites + 1
    wide = materialize(spread(lines, log_buckets).where(F.col("sites") >= min_sites - slack), "line-spread")
    near = wide.where(F.col("sites") <= min_sites + slack).select("line")
    exact = (_occurrences(lines).join(near, "line", "left_semi").distinct()
             .groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites))
    return wide.where(F.col("sites") > min_sites + slack).select("line", "sites").unionByName(exact)


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                       min_sites: int = MIN_SITES) -> DataFrame:
    """One row per document: id, text without boilerplate lines, n_lines and
    n_removed.

    Removal goes by text: the places of its boilerplate lines are gathered
    under the text's hash (at most as many as it has lines) and joined to its
    rows. The join builds its tables from the places and streams the texts,
    at every size, so texts are shuffled once and never sorted.
    """
    lines = hashed_lines(docs, text_col, site_col)
    found = materialize(boilerplate(lines, min_sites).select("line"), "line-boilerplate")
    placed = lines.select("hash", F.posexplode("lines").alias("at", "line")).join(found, "line", "left_semi")
    gone = materialize(placed.select("hash", "at").distinct().groupBy("hash").agg(F.collect_list("at").alias("gone")), "line-gone")
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    rows = rows.join(gone.hint("shuffle_hash"), "hash", "left")
    kept = F.filter(_lines(F.col("text")), lambda x, i: ~F.array_contains("gone", i))
    total = F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text"))))
    removed = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return rows.select(
        F.col("id").alias(id_col), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        total.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
