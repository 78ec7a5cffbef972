"""Prefix trie of conversations by vertical bitmaps.

A node is a distinct sequence of first turns; the conversations that start
with it are its members. Conversations are cut into shards in the order of
their ids (at most SHARD_UNITS conversations, at most SHARD_TURNS turns). A shard indexes every
(position, turn) to the bitset of its conversations that hold the turn there
and walks depth first: a node's bitset and the posting of a next turn give the
bitset of a child, popcounts and masks give its figures. Nodes of equal path
meet in one aggregation over all shards; what a shard returns for a node is
one row, however many members it has.

Figures over a subtree need no walk over the whole trie. A conversation owns
the nodes whose smallest member it is, a run from some depth to its end; given
that depth, children, leaves and shared text are sums over members. So shards
walk twice: once for smallest members and counts, then, knowing the owners,
for everything.

A conversation longer than BLOCK_TURNS turns is cut into blocks that start at
the path they continue, so no task holds a conversation of any length. Turns
and paths are told apart by 128 bits of hashes. The digest of a node's
conversations is the one sequential step: pieces of up to SHARD_UNITS ids
stream through it in order.

Nulls and ties: rows without a conversation id take no part; a null role or
text is empty; null turns come first and rows of equal turn are ordered by a
hash of role and text, so repeated rows are turns of their own; an empty table
gives no node. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .mixing import number_in_order

SHARD_UNITS = 1024
SHARD_TURNS = 1 << 16
BLOCK_TURNS = 256
#: conversations c - c % GROUP lend their first turns, up to LENT - 1 of them
GROUP = 100
LENT = 6

PATH = [("k1", pa.int64()), ("k2", pa.int64()), ("depth", pa.int64())]
FIRST = pa.schema(PATH + [("n", pa.int64()), ("low", pa.int64()), ("n_ends", pa.int64()), ("upto", pa.int64()), ("chars", pa.int64())])
SECOND = pa.schema(PATH + [("q1", pa.int64()), ("q2", pa.int64()), ("n", pa.int64()), ("low", pa.int64()),
                           ("parent", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()),
                           ("saved", pa.int64()), ("first", pa.int64()), ("ends", pa.binary())])
FIRST_DDL = "k1 long, k2 long, depth long, n long, low long, n_ends long, upto long, chars long"
SECOND_DDL = ("k1 long, k2 long, depth long, q1 long, q2 long, n long, low long, parent long, children long, "
              "leaves long, saved long, first long, ends binary")


# -- turns --------------------------------------------------------------------------

def ordered_turns(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv, pos, t1, t2, chars): every turn with its place in the
    conversation (from 0), two hashes of role and text, and the code points of
    the text. Stored."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = table.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"), F.length(text).cast("long").alias("chars"))
    placed = number_in_order(rows, F.struct("conv", "turn", "t1", "t2"), "place", "trie-order")
    starts = placed.groupBy("conv").agg(F.min("place").alias("start"))
    return materialize(placed.join(starts, "conv").select("conv", (F.col("place") - F.col("start")).alias("pos"),
                                                          "t1", "t2", "chars"), "trie-turns")


def conversation_sizes(turns: DataFrame) -> DataFrame:
    """(conv, n): turns of each conversation."""
    return turns.groupBy("conv").agg(F.count("*").alias("n"))


def lent_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from that of its group: crc32 of its decimal id modulo LENT."""
    return (F.crc32(conv.cast("string").cast("binary")) % LENT).cast("long")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation anew: the first turns of its group's conversation
    (:func:`lent_turns` many, all if fewer, none if it is absent), then its
    own turns after as many. (turns, sizes); a size may be 0."""
    lender = Window.partitionBy("conv").orderBy("pos")
    first = (turns.where((F.col("conv") % GROUP == 0) & (F.col("pos") < LENT - 1))
             .withColumn("nth", F.row_number().over(lender)).where(F.col("nth") < LENT)
             .groupBy(F.col("conv").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "t1", "t2", "chars"))).alias("lent")))
    convs = (conversation_sizes(turns).withColumn("base", F.col("conv") - F.col("conv") % GROUP)
             .join(first, "base", "left").withColumn("h", lent_turns(F.col("conv"))))
    none = F.array().cast("array<struct<pos:bigint,t1:bigint,t2:bigint,chars:bigint>>")
    convs = convs.withColumn("lent", F.slice(F.coalesce("lent", none), F.lit(1), F.col("h").cast("int")))
    convs = materialize(convs.select("conv", "h", F.size("lent").cast("long").alias("taken"), "lent",
                                     F.greatest(F.lit(0), F.col("n") - F.col("h")).alias("own")), "trie-convs")
    heads = convs.select("conv", F.inline("lent"))
    tails = (turns.join(convs.select("conv", "h", "taken"), "conv").where(F.col("pos") >= F.col("h"))
             .select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "t1", "t2", "chars"))
    return heads.unionByName(tails), convs.select("conv", (F.col("taken") + F.col("own")).alias("n"))


# -- a shard --------------------------------------------------------------------------

class Unit(NamedTuple):
    """A block of a conversation: the path and text length it starts from, its
    (position, turn) keys and text lengths, and what is known of its owner run."""
    conv: int
    block: int
    n: int
    path: tuple[int, int]
    before: int
    turns: list[tuple[int, int]]
    chars: list[int]
    owned: int = 0      # depth from which the conversation owns its nodes
    shared: int = 0     # text length above that depth
    leaf: bool = False  # it is the smallest member of a leaf


def _ids(bits: int) -> Iterator[int]:
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


def walk(units: list[Unit], second: bool) -> list[tuple]:
    """Rows of FIRST or SECOND for the nodes of a shard; ``units`` ascend by
    conversation, so the lowest bit of a bitset is its smallest member."""
    postings: dict[tuple[int, int], int] = {}
    roots: dict[tuple, int] = {}
    ends: dict[int, int] = {}     # depth -> conversations that end there
    going: dict[int, int] = {}    # depth -> conversations that own their node there
    owners: dict[int, int] = {}   # depth -> conversations whose run has begun there
    leaf = 0
    for i, u in enumerate(units):
        bit = 1 << i
        roots[(u.block, u.path)] = roots.get((u.block, u.path), 0) | bit
        ends[u.n] = ends.get(u.n, 0) | bit
        leaf |= bit if u.leaf else 0
        top = u.block * BLOCK_TURNS
        for key in u.turns:
            postings[key] = postings.get(key, 0) | bit
        if second:
            for d in range(max(u.owned, top), top + len(u.turns) + 2):
                owners[d] = owners.get(d, 0) | bit
                if d <= u.n:
                    going[d] = going.get(d, 0) | bit
    holds: list[int] = []         # place in the block -> conversations with a turn there
    for i, u in enumerate(units):
        holds += [0] * (len(u.turns) - len(holds))
        for at in range(len(u.turns)):
            holds[at] |= 1 << i

    out: list[tuple] = []

    def emit(bits: int, depth: int, key: tuple[int, int], parent: tuple[int, int], upto: int, chars: int) -> None:
        low = units[(bits & -bits).bit_length() - 1].conv
        over = bits & ends.get(depth, 0)
        if not second:
            out.append((*key, depth, bits.bit_count(), low, over.bit_count(), upto, chars))
            return
        above = owners.get(depth - 1, 0) & bits if depth else 0
        late = bits & ~owners.get(depth, 0)
        at = upto - chars
        saved = sum(units[i].shared - at for i in _ids(late))
        done = [units[i].conv for i in _ids(over)]
        out.append((*key, depth, *parent, bits.bit_count(), low,
                    units[above.bit_length() - 1].conv if above else None,
                    (bits & going.get(depth + 1, 0)).bit_count(), (bits & leaf).bit_count(), saved,
                    done[0] if done else None, np.array(done, "<i8").tobytes() if done else None))

    for (block, path), bits in roots.items():
        before = units[(bits & -bits).bit_length() - 1].before
        if block == 0:
            emit(bits, 0, path, (0, 0), 0, 0)
        stack = [(bits, 0, path, before)]
        while stack:
            members, at, path_, upto = stack.pop()
            left = members & holds[at] if at < len(holds) else 0
            while left:
                i = (left & -left).bit_length() - 1
                turn, chars = units[i].turns[at], units[i].chars[at]
                child = members & postings[turn]
                left &= ~child
                key = (path_[0] ^ turn[0], path_[1] ^ turn[1])
                emit(child, block * BLOCK_TURNS + at + 1, key, path_, upto + chars, chars)
                stack.append((child, at + 1, key, upto + chars))
    return out


def _walk_shards(second: bool):
    schema = SECOND if second else FIRST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(units):
            rows = walk(units, second)
            columns = list(zip(*rows)) if rows else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        units, turns = [], 0
        for batch in batches:
            table = batch.to_pydict()
            for k in range(batch.num_rows):
                row = {c: v[k] for c, v in table.items()}
                t = row["turns"]
                known = (row["owned"], row["shared"], row["leaf"]) if second else ()
                units.append(Unit(row["conv"], row["block"], row["n"], (row["p1"], row["p2"]), row["before"],
                                  [(x["f1"], x["f2"]) for x in t], [x["chars"] for x in t], *known))
                turns += len(t)
                if len(units) >= SHARD_UNITS or turns >= SHARD_TURNS:
                    yield flush(units)
                    units, turns = [], 0
        if units:
            yield flush(units)
    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids; its pieces come one after the other."""
    names = ["k1", "k2", "ends_sha256"]
    node, state, done = None, None, []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()),
                                           pa.array([x[2] for x in done], pa.string())], names)

    for batch in batches:
        for k1, k2, ends in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ends"))):
            piece = ",".join(map(str, np.frombuffer(ends, "<i8").tolist()))
            if (k1, k2) == node:
                state.update(b"," + piece.encode())
                continue
            if node is not None:
                done.append((*node, state.hexdigest()))
            node, state = (k1, k2), hashlib.sha256(piece.encode())
        if len(done) >= 10000:
            yield flush()
            done.clear()
    if node is not None:
        done.append((*node, state.hexdigest()))
    if done:
        yield flush()


# -- operator -------------------------------------------------------------------------

def trie_units(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks of conversations with the path they start from. Stored."""
    block = F.floor(F.col("pos") / BLOCK_TURNS).cast("long")
    keyed = turns.select("conv", block.alias("block"), "pos", F.xxhash64("pos", "t1", "t2").alias("f1"),
                         F.xxhash64(F.lit(1), "t2", "t1", "pos").alias("f2"), "chars")
    # one row without a turn for each conversation, which may have none
    keyed = keyed.unionByName(sizes.select("conv", F.lit(0).cast("long").alias("block")), allowMissingColumns=True)
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "f1", "f2", "chars"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    blocks = materialize(
        keyed.groupBy("conv", "block")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"), zero(F.bit_xor("f1")).alias("s1"),
             zero(F.bit_xor("f2")).alias("s2"), zero(F.sum("chars")).alias("text")), "trie-blocks")
    long = sizes.where(F.col("n") > BLOCK_TURNS)
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocks.join(long.select("conv"), "conv", "left_semi")
              .select("conv", "block", F.bit_xor("s1").over(earlier).alias("p1"), F.bit_xor("s2").over(earlier).alias("p2"),
                      F.sum("text").over(earlier).alias("before"),
                      F.sum("text").over(Window.partitionBy("conv")).alias("whole")))
    return materialize(
        blocks.join(starts, ["conv", "block"], "left").join(sizes, "conv")
        .select("conv", "block", "n", zero(F.col("p1")).alias("p1"), zero(F.col("p2")).alias("p2"),
                zero(F.col("before")).alias("before"), F.coalesce("whole", "text").alias("whole"), "turns"), "trie-units")


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per node of the trie over (conv, pos, t1, t2, chars) and (conv,
    n): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    units = trie_units(turns, sizes)

    def shards(df: DataFrame) -> DataFrame:
        return df.repartitionByRange("conv", "block").sortWithinPartitions("conv", "block")

    plain = units.select("conv", "block", "n", "p1", "p2", "before", "turns")
    nodes = (shards(plain).mapInArrow(_walk_shards(False), FIRST_DDL).groupBy("k1", "k2")
             .agg(F.max("depth").alias("depth"), F.sum("n").alias("n"), F.min("low").alias("low"),
                  F.sum("n_ends").alias("n_ends"), F.max(F.col("upto") - F.col("chars")).alias("above")))
    runs = nodes.groupBy(F.col("low").alias("conv")).agg(
        F.min(F.struct("depth", "above")).alias("run"), F.max(F.col("n_ends") == F.col("n")).alias("leaf"))
    known = (units.join(runs, "conv", "left")
             .select(*plain.columns, F.coalesce("run.depth", F.col("n") + 1).alias("owned"),
                     F.coalesce("run.above", "whole").alias("shared"), F.coalesce("leaf", F.lit(False)).alias("leaf")))
    found = materialize(shards(known).mapInArrow(_walk_shards(True), SECOND_DDL), "trie-nodes")

    merged = materialize(
        found.groupBy("k1", "k2")
        .agg(F.max("depth").alias("depth"), F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.sum("n").alias("n"),
             F.min("low").alias("low"), F.min("parent").alias("parent"), F.sum("children").alias("children"),
             F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "trie-merged")
    pieces = found.where("ends is not null").select("k1", "k2", "first", "ends")
    digests = (pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").select("k1", "k2", "ends")
               .mapInArrow(_digest, "k1 long, k2 long, ends_sha256 string"))
    # a node whose owner does not own its parent looks the parent up
    root = merged.where("depth = 0").select("low").scalar()
    wanting = merged.where("parent is null and depth > 1").select("k1", "k2", "q1", "q2")
    looked = (wanting.join(merged.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("low").alias("found")),
                           ["q1", "q2"]).select("k1", "k2", "found"))
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == 1, root).otherwise(F.coalesce("parent", "found"))
    return (merged.join(digests, ["k1", "k2"], "left").join(looked, ["k1", "k2"], "left")
            .select(F.col("low").alias("conv_id"), "depth", parent.cast("long").alias("parent_conv_id"),
                    F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                    F.col("saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
