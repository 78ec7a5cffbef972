"""Source routing over a table of requests.

requests:  (query_id, query, engines)   engines = 'all' or a comma list
registry:  (engine, pos, is_default, ...)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip

# Section messages and outcome labels of the text answer.
MSG_NO_RESULTS = "검색 결과가 없습니다."
MSG_UNKNOWN = "알 수 없는 검색엔진입니다."
MSG_POLICY = "정책상 관련 키워드로 검색이 불가능합니다."
MSG_ERROR_PREFIX = "검색 중 오류가 발생했습니다: "
MSG_TIMEOUT_SUFFIX = "초 내에 응답이 없어 건너뛰었습니다."
OK_COUNT_SUFFIX = "건"
NO_OUTCOMES = "없음"


def resolve_sources(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """R1 + J4: (query_id, engine, req_pos, registered). 'all' expands to the
    registry's default sources in registry order; otherwise the comma list is
    split, stripped, blanks dropped, repeats reduced to the first occurrence
    (``array_distinct`` keeps first-occurrence order). One projection per
    request plus a join of the registry, which Spark broadcasts while it is small."""
    defaults = (registry.filter("is_default")
                .agg(F.sort_array(F.collect_list(F.struct("pos", "engine"))).alias("d"))
                .select(F.transform("d", lambda s: s["engine"]).alias("d")))
    listed = F.filter(F.transform(F.split(F.coalesce(F.col("engines"), F.lit("")), ","), py_strip),
                      lambda x: x != F.lit(""))
    names = (requests.withColumn("_defaults", defaults.select("d").scalar())
             .select("query_id", F.array_distinct(
                 F.when(F.col("engines") == "all", F.col("_defaults")).otherwise(listed)).alias("names")))
    reg = registry.select("engine", F.lit(True).alias("registered"))
    return (names.select("query_id", F.posexplode("names").alias("req_pos", "engine"))
            .join(reg, "engine", "left")
            .select("query_id", "engine", F.col("req_pos").cast("long").alias("req_pos"),
                    F.coalesce("registered", F.lit(False)).alias("registered")))


def fallback_sources(requests: DataFrame, resolved: DataFrame, has_rows: DataFrame,
                     registry: DataFrame) -> DataFrame:
    """R3 + J5: for queries whose first round returned no row at all, every
    registered source not yet tried, in registry order, numbered after the
    requested ones. A query resolving to no source falls back to all."""
    n_req = (requests.select("query_id").distinct()
             .join(resolved.groupBy("query_id").agg(F.count("engine").alias("n_req")), "query_id", "left")
             .select("query_id", F.coalesce("n_req", F.lit(0)).alias("n_req")))
    empty = n_req.join(has_rows.select("query_id").distinct(), "query_id", "left_anti")
    reg = registry.select("engine", "pos").agg(
        F.sort_array(F.collect_list(F.struct("pos", "engine"))).alias("r")).select("r").scalar()
    cands = empty.select("query_id", "n_req", F.explode(reg).alias("s")).select(
        "query_id", "n_req", F.col("s.engine").alias("engine"), F.col("s.pos").alias("pos"))
    untried = cands.join(resolved.select("query_id", "engine"), ["query_id", "engine"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("pos")
    return untried.select("query_id", "engine",
                          (F.col("n_req") + F.row_number().over(w) - 1).cast("long").alias("sec_pos"))


def source_status(sections: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """R2: apply reported outcomes to sections (query_id, engine, status,
    message, n_rows, ...). ``outcomes`` has (query_id, engine, outcome,
    detail) for calls that did not answer: ``error`` (detail: the error),
    ``timeout`` (detail: the seconds waited), ``unavailable`` and
    ``quota_exceeded`` (detail: the message to show). An unregistered name stays unknown whatever is
    reported; a source with a reported outcome contributes no rows."""
    if outcomes is None:
        return sections
    said = outcomes.select("query_id", "engine", F.col("outcome").alias("_outcome"), F.col("detail").alias("_detail"))
    failed = F.col("_outcome").isNotNull() & (F.col("status") != "unknown")
    status = (F.when(F.col("_outcome") == "timeout", "timeout").when(F.col("_outcome") == "error", "error")
              .otherwise("skip"))
    detail = F.coalesce("_detail", F.lit(""))
    message = (F.when(F.col("_outcome") == "timeout", F.concat(detail, F.lit(MSG_TIMEOUT_SUFFIX)))
               .when(F.col("_outcome") == "error", F.concat(F.lit(MSG_ERROR_PREFIX), detail)).otherwise(detail))
    return (sections.join(said, ["query_id", "engine"], "left")
            .withColumn("status", F.when(failed, status).otherwise(F.col("status")))
            .withColumn("message", F.when(failed, message).otherwise(F.col("message")))
            .withColumn("n_rows", F.when(failed, F.lit(0)).otherwise(F.col("n_rows")).cast("long"))
            .drop("_outcome", "_detail"))


def answered(rows: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Rows of sources without a reported outcome."""
    return rows if outcomes is None else rows.join(outcomes.select("query_id", "engine"), ["query_id", "engine"], "left_anti")


def outcome_summary(sections: DataFrame, requests: DataFrame) -> DataFrame:
    """Per request, ``engine=status`` in section order (``ok(n건)`` for
    ok); a request without sections gets the label for none."""
    label = F.when(F.col("status") == "ok",
                   F.concat(F.col("engine"), F.lit("=ok("), F.col("n_rows").cast("string"),
                            F.lit(OK_COUNT_SUFFIX + ")"))) \
        .otherwise(F.concat(F.col("engine"), F.lit("="), F.col("status")))
    agg = sections.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec_pos", label.alias("l")))),
                                 lambda s: s["l"]), ", ").alias("summary"))
    return requests.select("query_id").distinct().join(agg, "query_id", "left").select(
        "query_id", F.coalesce("summary", F.lit(NO_OUTCOMES)).alias("summary"))
