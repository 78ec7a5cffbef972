"""Mixing sources to target weights by capped water-filling.

Sources in code-point order (null last) get the weights in turn. A target is
``level x weight``, clamped at ``max_epochs`` times the source's size; the
excess of clamped sources raises the level until no source is above its
clamp. A source then takes whole repetitions of all its documents and, for
the fraction left, one more of a part of them: long, middle and short documents
each give that fraction of their words, those first in the order of a seeded
hash, up to the document in whose middle the bound falls; what one kind gives
too much or too little the next makes up for, so the error left is that of a
short document.

Built from DataFrame functions. A decision is one hash bound for each source
and kind, so rows are decided where they are; the driver sees two sums in each
round of the water-filling.

Nulls and ties: a null text has size 0; a null source is a source; a source
of size 0 has target 0 and its documents are taken 0 times as words. Rows
equal in id, source and text share a hash, so one decision holds for them.
An empty table gives an empty mix. Columns of ``docs`` of any name may stand
beside the ones read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, running_before, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 20
#: least words of a long and of a middle document
KINDS = (512, 64)
SALT_BITS = 6


def _hash(row: str, id_col: str, text_col: str, source_col: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"{row}`{c}`") for c in (id_col, source_col, text_col)])


def kind_of(size: Column) -> Column:
    """0: long, 1: middle, 2: short."""
    return F.when(size >= KINDS[0], 0).when(size >= KINDS[1], 1).otherwise(2)


def number_in_order(df: DataFrame, by: Column, out: str, name: str) -> DataFrame:
    """Add ``out``: the row's place (from 0) in the order of ``by``, without
    one task for all rows: ranges are numbered apart and shifted by the counts
    of the ranges before."""
    ranged = materialize(df.repartitionByRange(by).withColumn("__range", F.spark_partition_id()), name)
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__shift"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(by)) - 1 + F.col("__shift")
    return ranged.join(shifts, "__range").withColumn(out, place.cast("long")).drop("__range", "__shift")


def water_level(sources: DataFrame, budget: float) -> float:
    """Level at which the targets least(cap, level x weight) sum to the budget;
    infinite if all caps together do not reach it."""
    level, clamped = None, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight") if level is not None else F.lit(False)
        got = sources.agg(F.sum(over.cast("long")).alias("n"),
                          F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("held"),
                          F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if got.n is None or not got.free:
            return float("inf")
        if got.n == clamped:
            return level
        clamped, level = got.n, (budget - got.held) / got.free


def plan_mix(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
             max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per source of the stored table ``rows`` (source, size, order):
    source, source_size, target, whole repetitions and ``cuts``, by kind of
    document the largest order that is taken once more (null: none)."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = number_in_order(totals, F.col("source").asc_nulls_last(), "rank", "mix-ranks")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = materialize(ranked.select("source", "source_size", pick.alias("weight"),
                                        (F.col("source_size") * float(max_epochs)).alias("cap")), "mix-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(sources, share * total)
    target = F.least("cap", F.lit(level) * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    planned = materialize(
        sources.withColumn("target", target).withColumn("whole", whole.cast("int"))
        .select("source", "source_size", "target", "whole", F.xxhash64("source", F.col("source").isNull()).alias("sid"),
                (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest")), "mix-targets")
    units = materialize(
        rows.groupBy(F.xxhash64("source", F.col("source").isNull()).alias("sid"), kind_of(F.col("size")).alias("kind"), "order")
        .agg(F.sum("size").alias("size")), "mix-units")
    placed = materialize(running_before(units, ["sid", "kind"], "order", F.col("size"), "before"), "mix-placed")
    words = placed.groupBy("sid", "kind").agg(F.sum("size").alias("words"))
    part = F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0)
    state = planned.withColumn("part", part).withColumn("owed", F.lit(0.0)).withColumn("cuts", F.array().cast("array<long>"))
    for kind in range(len(KINDS) + 1):
        own = words.where(F.col("kind") == kind).select("sid", "words")
        bound = F.when(F.col("rest") > 0, F.col("part") * F.coalesce("words", F.lit(0)) + F.col("owed")).otherwise(0.0)
        bounded = state.join(own, "sid", "left").withColumn("bound", bound).drop("words")
        # a source may hold any part of the rows: its bound stands once for each of 2**SALT_BITS hash ranges
        salts = F.sequence(F.lit(-(1 << SALT_BITS - 1)).cast("long"), F.lit((1 << SALT_BITS - 1) - 1).cast("long"))
        salted = bounded.select("sid", "bound", F.explode(salts).alias("salt"))
        taken = (placed.where(F.col("kind") == kind).withColumn("salt", F.shiftright("order", 64 - SALT_BITS))
                 .join(salted, ["sid", "salt"])
                 .where((F.col("bound") > 0) & (F.col("before") + F.col("size") / 2 <= F.col("bound")))
                 .groupBy("sid").agg(F.max("order").alias("cut"), F.sum("size").alias("took")))
        state = materialize(
            bounded.join(taken, "sid", "left").withColumn("owed", F.col("bound") - F.coalesce("took", F.lit(0)))
            .withColumn("cuts", F.concat("cuts", F.array("cut"))).drop("bound", "cut", "took"), "mix-state")
    return state.select("source", "source_size", "target", "whole", "cuts")


def _decided(rows: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """Add source_size, target and ``__times`` to rows that hold ``__order`` and ``__kind``."""
    plan = plan.select(F.col("source").alias("__source"), "source_size", "target", F.col("whole").alias("__whole"),
                       F.col("cuts").alias("__cuts"))
    more = F.coalesce(F.col("__order") <= F.element_at("__cuts", F.col("__kind") + 1), F.lit(False)).cast("int")
    return (rows.join(plan, F.col(source).eqNullSafe(F.col("__source")))
            .withColumn("__times", F.col("__whole") + more))


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
              weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS,
              seed: int = SEED) -> DataFrame:
    """One row per document: id, size (words), source_size, target (both of
    its source), taken (words, repeats counted) and repeats."""
    rows = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                   word_count(F.col(text_col)).alias("size"),
                                   _hash("", id_col, text_col, source_col, seed).alias("order")), "mix-rows")
    plan = plan_mix(rows, weights, share, max_epochs)
    done = _decided(rows.withColumnRenamed("order", "__order").withColumn("__kind", kind_of(F.col("size"))), plan, "source")
    return done.select(F.col("id").alias(id_col), "size", "source_size", "target",
                       (F.col("size") * F.col("__times")).cast("long").alias("taken"), F.col("__times").alias("repeats"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``docs``, with its columns, as often as it is taken."""
    rows = materialize(docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                                   _hash("", id_col, text_col, source_col, seed).alias("order")), "mix-rows")
    plan = plan_mix(rows, weights, share, max_epochs)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    packed = (packed.withColumn("__order", _hash("row.", id_col, text_col, source_col, seed))
              .withColumn("__kind", kind_of(word_count(F.col(f"row.`{text_col}`")))))
    taken = _decided(packed, plan, f"row.`{source_col}`").where("__times > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("row.*")
