"""Sharding by balanced label propagation.

Documents of equal text are neighbours. They start on a shard picked by hash
and are moved, in rounds of joins and groupings, to the shard that already
holds most of their group, as far as the capacity quota of that shard has
room. A group's documents are alike, so a round works on counts by group and
shard. Documents without neighbours, and those an overfull shard gives back,
then fill the shards: size classes from large to small (powers of two) level
what the class before left uneven, so the shards' bytes end near equal.

Built from DataFrame functions. The driver sees the bytes of each shard and
class, at most 64 x shards numbers.

Nulls and ties: a null text has no neighbour and size 16; empty texts are
equal to each other; repeated rows are rows of their own; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, running_before, text_bytes

SHARDS = 40
OVERHEAD = 16
ROUNDS = 10
SEED = 9


def _loads(df: DataFrame, size: Column, shards: int) -> list[int]:
    """Bytes by shard."""
    out = [0] * shards
    for r in df.groupBy("shard").agg(F.sum(size).alias("bytes")).collect():
        out[r.shard] = r.bytes
    return out


def _fitting(room: Column) -> Column:
    """How many of ``n`` documents of ``size`` go into what ``room`` leaves."""
    return F.least(F.col("n"), F.greatest(F.lit(0), F.floor(room / F.col("size")))).cast("long")


def _at(values: list[int], index: str) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col(index) + 1)


def propagate(state: DataFrame, quota: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """Rounds of label propagation on (g, size, shard, n): documents move to
    the shard with room that holds most of their group, from shards that hold
    fewer, until none moves or ``rounds`` are over."""
    for _ in range(rounds):
        room = [quota - x for x in _loads(state, F.col("n") * F.col("size"), shards)]
        weight = F.struct("n", F.xxhash64("g", "shard").alias("tie"), "shard")
        goal = F.max(F.when(_at(room, "shard") >= F.col("size"), weight)).alias("goal")
        goals = state.groupBy("g", "size").agg(goal).where("goal is not null")
        moves = materialize(
            state.withColumn("own", weight).join(goals, ["g", "size"]).where("own < goal")
            .select("g", "size", "shard", "n", F.col("goal.shard").alias("to"),
                    F.xxhash64("g", "shard", F.lit(SEED)).alias("order")), "shard-moves")
        asked = running_before(moves, ["to"], "order", F.col("n") * F.col("size"), "before", ["g", "size", "shard"])
        done = materialize(asked.withColumn("k", _fitting(_at(room, "to") - F.col("before"))).where("k > 0")
                           .select("g", "size", "shard", "to", "k"), "shard-moved")
        if done.isEmpty():
            break
        out = done.select("g", "size", "shard", (-F.col("k")).alias("n"))
        into = done.select("g", "size", F.col("to").alias("shard"), F.col("k").alias("n"))
        state = materialize(state.unionByName(out).unionByName(into).groupBy("g", "size", "shard")
                            .agg(F.sum("n").alias("n")).where("n > 0"), "shard-state")
    return state


def _levelled(loads: list[int], amount: int) -> list[float]:
    """Shares of ``amount`` that level the loads from below."""
    order, level, filled = sorted(loads), 0.0, 0
    for k, low in enumerate(order, 1):
        filled += low
        level = (amount + filled) / k
        if k == len(order) or level <= order[k]:
            break
    return [max(0.0, level - x) for x in loads]


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
                  rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, size, text_crc32, law (``bytes``), shard,
    slot (its place in the shard, from 0) and grown_shard (null: only the law
    ``key`` has one)."""
    spark, text = docs.sparkSession, F.col(text_col)
    rows = materialize(
        docs.select(F.col(id_col).alias("id"), (text_bytes(text) + OVERHEAD).alias("size"),
                    F.crc32(text.cast("binary")).alias("crc"), F.when(text.isNotNull(), F.xxhash64(text)).alias("g"),
                    F.xxhash64(F.col(id_col), text, F.lit(SEED)).alias("order")), "shard-rows")
    groups = materialize(rows.where("g is not null").groupBy("g", "size").agg(F.count("*").alias("members"))
                         .where("members > 1"), "shard-groups")
    total = rows.agg(F.sum("size")).first()[0] or 0
    quota = -(-total // shards)

    # a group that no shard can hold starts on as few as can
    parts = F.least(F.lit(shards), F.ceil(F.col("members") * F.col("size") / F.lit(max(quota, 1))))
    start = F.when(parts == 1, F.pmod("order", F.lit(shards))).otherwise(
        F.pmod(F.pmod("g", F.lit(shards)) + F.pmod("order", parts), F.lit(shards))).cast("int")
    linked = materialize(rows.join(groups, ["g", "size"]).withColumn("start", start).drop("members"), "shard-linked")
    state = propagate(materialize(linked.groupBy("g", "size", F.col("start").alias("shard"))
                                  .agg(F.count("*").alias("n")), "shard-state"), quota, shards, rounds)

    # overfull shards give back; then the members of a group are dealt to its shards by rank
    kept = running_before(state.withColumn("order", F.xxhash64("g", "size")), ["shard"], "order",
                          F.col("n") * F.col("size"), "before", ["g", "size"])
    kept = kept.withColumn("n", _fitting(F.lit(quota) - F.col("before"))).where("n > 0")
    earlier = Window.partitionBy("g", "size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = kept.select("g", "size", "shard", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    spans = spans.select(F.col("g").alias("g_"), F.col("size").alias("size_"), "shard", "first",
                         (F.col("first") + F.col("n")).alias("end"))
    ranked = running_before(linked, ["g", "size"], "order", F.lit(1), "rank", ["id"])
    inside = ((F.col("g") == F.col("g_")) & (F.col("size") == F.col("size_"))
              & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    dealt = materialize(ranked.join(spans, inside, "left").select("id", "size", "crc", "order", "shard"), "shard-dealt")
    placed = dealt.where("shard is not null")

    alone = rows.join(groups.select("g", "size"), ["g", "size"], "left_anti").select("id", "size", "crc", "order")
    pool = materialize(
        alone.unionByName(dealt.where("shard is null").drop("shard"))
        .withColumn("class", F.floor(F.log2("size")).cast("int")), "shard-pool")
    pool = materialize(running_before(pool, ["class"], "order", F.col("size"), "before", ["id"]), "shard-classes")
    amounts = {r["class"]: r.bytes for r in pool.groupBy("class").agg(F.sum("size").alias("bytes")).collect()}
    loads, edges = _loads(placed, F.col("size"), shards), []
    middle = F.col("before") + F.col("size") / 2
    for c in sorted(amounts, reverse=True):
        ends, at = [], 0.0
        for share in _levelled(loads, amounts[c]):
            at += share
            ends.append(at)
        edges.append((c, ends[:-1]))
        found = F.size(F.filter(F.array(*[F.lit(e) for e in ends[:-1]]).cast("array<double>"), lambda e: e <= middle))
        added = _loads(pool.where(F.col("class") == c).select("size", found.alias("shard")), F.col("size"), shards)
        loads = [x + y for x, y in zip(loads, added)]
    # one row for each size class: at most 64
    table = F.broadcast(spark.createDataFrame(edges, "class int, ends array<double>"))
    filled = pool.join(table, "class").withColumn("shard", F.size(F.filter("ends", lambda e: e <= middle)))
    done = materialize(placed.unionByName(filled.select("id", "size", "crc", "order", "shard")), "shard-done")
    slots = running_before(done, ["shard"], "order", F.lit(1), "slot", ["id"])
    return slots.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
                        F.lit(None).cast("int").alias("grown_shard"))
