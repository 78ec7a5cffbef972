"""Hard negatives by cover trees over norm-augmented candidates.

A candidate x becomes (x, sqrt(M^2 - |x|^2)), a query q becomes (q, 0): the
inner product stays, and a ball of radius r about a candidate c bounds the
inner products of all rows in it by q.c - |q| r and q.c + |q| r. Rows are cut
into blocks of BLOCK_ROWS in the order of label and nearest pivot (a bounded
sample of rows); each block is one cover tree, built by farthest-first
traversal: a node's centre is a row, centre of one of its children too,
children lie apart by more than the radius that covers them, and every node
holds the radius that covers its rows.

Anchors meet trees in blocks: a batch of anchors and a strip of trees are one
task, if bounds over the whole batch and tree allow a hit. Inside, trees go
down level by level and drop nodes outside the anchors' windows; leaves are
then visited best bound first, until the bound falls under the score of the
k-th found, and verified by exact integer products. A task returns k rows for
a window, so the merge is small whatever the size of a label.

Three searches: an anchor's own block gives a lower bound for its positives,
the other blocks give the positives, and every positive opens a window for
the negatives.

Nulls and ties: rows with a null id, label or vector, or a null or non-finite
component take no part, nor do rows whose scores would not fit in a long
(squared integer norm above 2**62). Vectors of different length do not meet.
Higher scores come first, ties by smaller id, then by row; repeated rows are
rows of their own. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .mixing import number_in_order

SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: bounds of a negative's score, in hundredths of the positive's
WINDOW = (50, 95)
BLOCK_ROWS = 2048
BATCH_BLOCKS = 8
STRIP_BLOCKS = 8
PIVOTS = 64
FANOUT = 16
LEAF_ROWS = 16
SHRINK = 0.5
#: pairs of batches and blocks are planned in this many parts
SALTS = 16
#: integers and their sums are exact in a double up to here
EXACT = 2**52
LARGEST = 2**62
SLACK = 1e-7
LOWEST = np.iinfo(np.int64).min

SPANS = "array<struct<place:int,least:bigint,most:bigint>>"
FOUND = "anchor long, place int, score long, id long, rid long"


# -- cover tree -----------------------------------------------------------------------

class CoverTree:
    """Rows in leaf order and nodes level by level: ``parent``, ``centre`` (a
    row), ``radius``, rows ``low`` .. ``high`` - 1, ``leaf``; ``levels`` are the
    first nodes of the levels, with the end."""

    def __init__(self, rows: np.ndarray):
        plain = rows.astype(np.float64)
        squares = (plain * plain).sum(axis=1)
        self.norm = float(np.sqrt(squares.max()))
        points = np.column_stack([plain, np.sqrt(np.maximum(0, squares.max() - squares))])
        order = np.arange(len(rows))
        nodes, levels = [], [0]
        middle = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
        level = [(-1, middle, 0, len(rows))]
        while level:
            below = []
            for parent, centre, low, high in level:
                members = order[low:high]
                away = np.sqrt(((points[members] - points[centre]) ** 2).sum(axis=1))
                radius = float(away.max())
                leaf = high - low <= LEAF_ROWS or radius == 0
                number = len(nodes)
                nodes.append((parent, centre, radius, low, high, leaf))
                if leaf:
                    continue
                centres, owner = [centre], np.zeros(len(members), np.int64)
                while away.max() > radius * SHRINK and len(centres) < FANOUT:
                    far = int(members[np.argmax(away)])
                    other = np.sqrt(((points[members] - points[far]) ** 2).sum(axis=1))
                    nearer = other < away
                    owner[nearer] = len(centres)
                    away = np.where(nearer, other, away)
                    centres.append(far)
                order[low:high] = members[np.argsort(owner, kind="stable")]
                cuts = low + np.append(0, np.cumsum(np.bincount(owner, minlength=len(centres))))
                below += [(number, c, int(a), int(b)) for c, a, b in zip(centres, cuts, cuts[1:]) if a < b]
            level = below
            levels.append(len(nodes))
        self.order = order
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        self.parent = np.array([n[0] for n in nodes])
        self.centre = place[[n[1] for n in nodes]]
        self.radius = np.array([n[2] for n in nodes])
        self.low, self.high = np.array([n[3] for n in nodes]), np.array([n[4] for n in nodes])
        self.leaf = np.array([n[5] for n in nodes])
        self.levels = np.array(levels)


def _scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of integer rows: doubles where they are exact, else longs."""
    return np.rint(a @ b.T).astype(np.int64) if exact else a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The k best rows of each query: higher score, smaller id, smaller row."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least = k, least
        self.query, self.score, self.id, self.rid = (np.zeros(0, np.int64) for _ in range(4))

    def bounds(self) -> np.ndarray:
        """Least score that can still enter, by query."""
        out = self.least.copy()
        last = np.append(np.nonzero(np.diff(self.query))[0], len(self.query) - 1) if len(self.query) else np.zeros(0, int)
        full = np.bincount(self.query, minlength=len(out)) >= self.k
        ends = self.query[last]
        out[ends] = np.where(full[ends], np.maximum(out[ends], self.score[last]), out[ends])
        return out

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rid: np.ndarray) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        ids, rid = np.concatenate([self.id, ids]), np.concatenate([self.rid, rid])
        order = np.lexsort((rid, ids, -score, query))
        first = np.searchsorted(query[order], query[order], side="left")
        order = order[np.arange(len(order)) - first < self.k]
        self.query, self.score, self.id, self.rid = query[order], score[order], ids[order], rid[order]


class Anchors:
    """Anchors of a task and their queries: one for each window, sorted by anchor."""

    def __init__(self, rid, label, vectors: np.ndarray, spans: list, k: int, same: bool):
        self.rid, self.label, self.vectors, self.same = rid, label, vectors.astype(np.float64), same
        self.norm = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.of = np.repeat(np.arange(len(rid)), [len(s) for s in spans])
        self.place = np.array([w["place"] for s in spans for w in s], np.int64)
        self.most = np.array([w["most"] for s in spans for w in s], np.int64)
        self.best = Best(np.array([w["least"] for s in spans for w in s], np.int64), k)
        self.first = np.searchsorted(self.of, np.arange(len(rid)))
        self.top = np.maximum.reduceat(self.most, self.first)

    def least(self) -> np.ndarray:
        """Least score of any window of an anchor that can still enter."""
        return np.minimum.reduceat(self.best.bounds(), self.first)

    def offer(self, anchor, score, ids, rid) -> None:
        """Verified rows, for every window of the anchor they fall in."""
        width = np.append(self.first[1:], len(self.of)) - self.first
        n = width[anchor]
        at = np.repeat(np.arange(len(anchor)), n)
        query = np.repeat(self.first[anchor] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        fits = (score[at] >= self.best.bounds()[query]) & (score[at] <= self.most[query])
        at = at[fits]
        self.best.add(query[fits], score[at], ids[at], rid[at])


def search(anchors: Anchors, tree: dict, part: np.ndarray) -> None:
    """Offer the rows of one tree to the anchors numbered ``part``."""
    rows, q, norm = tree["vectors"], anchors.vectors[part], anchors.norm[part]
    exact = max(float(norm.max()), tree["norm"]) ** 2 <= EXACT
    slack = SLACK * norm * tree["norm"] + 1
    least, most = anchors.least()[part], anchors.top[part]
    leaves = []
    alive = None
    for start, end in zip(tree["levels"], tree["levels"][1:]):
        nodes = np.arange(start, end)
        if alive is None:
            open_ = np.ones((len(part), 1), bool)
        else:
            open_ = alive[:, tree["parent"][nodes] - before]
            used = open_.any(axis=0)
            nodes, open_ = nodes[used], open_[:, used]
        if not len(nodes):
            break
        middle = q @ rows[tree["centre"][nodes]].T
        reach = norm[:, None] * tree["radius"][nodes] + slack[:, None]
        open_ &= (middle + reach >= least[:, None]) & (middle - reach <= most[:, None])
        i, j = np.nonzero(open_ & tree["leaf"][nodes])
        leaves.append((i, nodes[j], np.minimum(middle[i, j] + reach[i, j], most[i].astype(np.float64))))
        alive = np.zeros((len(part), end - start), bool)
        alive[:, nodes - start] = open_ & ~tree["leaf"][nodes]
        before = start
    i, leaf, bound = (np.concatenate(x) for x in zip(*leaves)) if leaves else (np.zeros(0, int),) * 3
    order = np.lexsort((-bound, i))
    i, leaf, bound = i[order], leaf[order], bound[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i, side="left")
    done, step = 0, 4
    while len(i):
        least = anchors.least()[part]
        turn = np.nonzero((nth >= done) & (nth < done + step) & (bound >= least[i]))[0]
        if not len(turn):
            break
        turn = turn[np.argsort(leaf[turn], kind="stable")]
        got = []
        for group in np.split(turn, np.nonzero(np.diff(leaf[turn]))[0] + 1):
            low, high = tree["low"][leaf[group[0]]], tree["high"][leaf[group[0]]]
            who = i[group]
            s = _scores(q[who], rows[low:high], exact)
            same = anchors.label[part[who]][:, None] == tree["label"][low:high][None, :]
            ok = (s >= least[who][:, None]) & (s <= most[who][:, None]) & (same == anchors.same)
            ok &= anchors.rid[part[who]][:, None] != tree["rid"][low:high][None, :]
            a, b = np.nonzero(ok)
            got.append((part[who[a]], s[a, b], low + b))
        who, score, row = (np.concatenate(x) for x in zip(*got))
        anchors.offer(who, score, tree["id"][row], tree["rid"][row])
        done, step = done + step, step * 2


# -- blocks ---------------------------------------------------------------------------

def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.array(column.to_list(), dtype=np.float64).reshape(len(column), dims)


def prepared(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             scale: int = SCALE) -> DataFrame:
    """(rid, id, label, dims, q): the rows that take part, components floor(scale x). Stored."""
    x = F.transform(F.col(vector_col), lambda v: F.lit(float(scale)) * v.cast("double"))
    fits = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(2**31)))
    rows = (table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
            .where("id is not null and label is not null and x is not null").where(F.coalesce(fits, F.lit(False)))
            .select("id", "label", F.transform("x", lambda v: F.floor(v).cast("int")).alias("q")))
    square = F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = rows.where(square <= float(LARGEST))
    return materialize(rows.withColumn("dims", F.size("q")).withColumn("rid", F.monotonically_increasing_id()), "neg-rows")


def in_blocks(rows: DataFrame) -> DataFrame:
    """Add ``block``: runs of BLOCK_ROWS rows of equal length by label and nearest pivot. Stored."""
    sample = rows.select("q").orderBy(F.xxhash64("rid"), "rid").limit(PIVOTS).collect()
    pivots = {d: np.array([r.q for r in sample if len(r.q) == d], np.float64) for d in {len(r.q) for r in sample}}

    def nearest(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = np.zeros(len(part), np.int32)
            sizes = part.str.len().to_numpy()
            for d, p in pivots.items():
                at = np.nonzero(sizes == d)[0]
                if d and len(at):
                    m = _matrix(part.iloc[at], d)
                    out[at] = np.argmin((p * p).sum(axis=1)[None, :] - 2 * (m @ p.T), axis=1)
            yield pd.Series(out)

    near = F.pandas_udf(nearest, "int")
    order = rows.withColumn("pivot", near("q"))
    numbered = number_in_order(order, F.struct("dims", "label", "pivot", "rid"), "at", "neg-order")
    starts = numbered.groupBy("dims").agg(F.min("at").alias("start"))
    block = F.floor((F.col("at") - F.col("start")) / BLOCK_ROWS).cast("long")
    return materialize(numbered.join(starts, "dims").select("rid", "id", "label", "dims", "q", block.alias("block")), "neg-placed")


def _tree_row(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """A block as one row: its tree, and what plans need to know of it."""
    dims, block = int(key[0]), int(key[1])
    part = part.sort_values("rid")
    rows = _matrix(part["q"], dims)
    tree = CoverTree(rows)
    part = part.iloc[tree.order]
    rows = rows[tree.order]
    root = rows[tree.centre[0]]
    return pd.DataFrame({
        "dims": [dims], "block": [block], "first_label": [part["label"].min()], "last_label": [part["label"].max()],
        "root": [root.tolist()], "reach": [float(tree.radius[0])], "norm": [tree.norm],
        "vectors": [rows.astype("<i4").tobytes()], "id": [part["id"].to_numpy("<i8").tobytes()],
        "rid": [part["rid"].to_numpy("<i8").tobytes()], "label": [part["label"].to_numpy("<i8").tobytes()],
        "nodes": [np.stack([tree.parent, tree.centre, tree.low, tree.high, tree.leaf]).astype("<i8").tobytes()],
        "radius": [tree.radius.astype("<f8").tobytes()], "levels": [tree.levels.astype("<i8").tobytes()]})


TREE = ("dims int, block long, first_label long, last_label long, root array<double>, reach double, norm double, vectors binary, "
        "id binary, rid binary, label binary, nodes binary, radius binary, levels binary")


def _tree_of(row) -> dict:
    longs = lambda b: np.frombuffer(b, "<i8").astype(np.int64)
    ids = longs(row.id)
    parent, centre, low, high, leaf = longs(row.nodes).reshape(5, -1)
    return {"vectors": np.frombuffer(row.vectors, "<i4").astype(np.float64).reshape(len(ids), row.dims), "id": ids,
            "rid": longs(row.rid), "label": longs(row.label), "norm": row.norm, "parent": parent, "centre": centre,
            "low": low, "high": high, "leaf": leaf.astype(bool), "radius": np.frombuffer(row.radius, "<f8"),
            "levels": longs(row.levels)}


def cover_trees(placed: DataFrame) -> DataFrame:
    """One row per block, see TREE. Stored."""
    return materialize(placed.groupBy("dims", "block").applyInPandas(_tree_row, TREE), "neg-trees")


# -- search ---------------------------------------------------------------------------

def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _norm(a: str) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def planned(anchors: DataFrame, trees: DataFrame, same: bool, own: bool | None) -> DataFrame:
    """(dims, batch, block): the pairs that may hold a hit. Batches and trees
    meet in SALTS parts; there is a row for each batch and each tree."""
    middle = (anchors.select("dims", "batch", F.posexplode("q").alias("axis", "x")).groupBy("dims", "batch", "axis")
              .agg(F.avg("x").alias("x")).groupBy("dims", "batch")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "x"))), lambda s: s["x"]).alias("middle")))
    real = F.transform("q", lambda x: x.cast("double"))
    spread = F.sqrt(F.aggregate(F.zip_with("real", "middle", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    batches = (anchors.join(middle, ["dims", "batch"], "left").withColumn("real", real)
               .withColumn("middle", F.coalesce("middle", F.array().cast("array<double>")))
               .groupBy("dims", "batch")
               .agg(F.first("middle").alias("middle"), F.max(spread).alias("spread"), F.max(_norm("real")).alias("longest"),
                    F.min("label").alias("first"), F.max("label").alias("last"),
                    F.min(F.array_min(F.transform("spans", lambda s: s["least"]))).alias("least"),
                    F.max(F.array_max(F.transform("spans", lambda s: s["most"]))).alias("most")))
    batches = materialize(batches, "neg-batches").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    heads = trees.select("dims", "block", "first_label", "last_label", "root", "reach", "norm",
                         (F.col("block") % SALTS).cast("int").alias("salt"))
    pairs = batches.join(heads, ["dims", "salt"])
    meet = F.col("block") / BATCH_BLOCKS
    if own is not None:
        pairs = pairs.where((F.floor(meet) == F.col("batch")) if own else F.lit(True))
    if same:
        pairs = pairs.where("first_label <= last and last_label >= first")
    else:
        pairs = pairs.where("not (first_label = last_label and first = last and first = first_label)")
    # q.x = q.c + q.(x - c) and q.c = m.c + (q - m).c
    room = F.col("spread") * _norm("root") + F.col("longest") * F.col("reach")
    room = room + SLACK * F.col("longest") * F.col("norm") + 1
    dot = _dot("middle", "root")
    return (pairs.where((dot + room >= F.col("least").cast("double")) & (dot - room <= F.col("most").cast("double")))
            .select("dims", "batch", "block"))


def _searcher(k: int, same: bool):
    def run(key: tuple, anchors: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = []
        dims = int(key[0])
        for at in range(0, len(anchors) if len(trees) else 0, 1024):
            part = anchors.iloc[at:at + 1024]
            a = Anchors(part["rid"].to_numpy(np.int64), part["label"].to_numpy(np.int64), _matrix(part["q"], dims),
                        part["spans"].to_list(), k, same)
            # trees of the best bound first, so that the others meet higher thresholds
            reach = [float((a.vectors @ np.array(t.root) + a.norm * t.reach).max()) for t in trees.itertuples()]
            for t in (list(trees.itertuples())[n] for n in np.argsort(reach)[::-1]):
                search(a, _tree_of(t), np.arange(len(part)))
            b = a.best
            out.append(pd.DataFrame({"anchor": a.rid[a.of[b.query]], "place": a.place[b.query].astype(np.int32), "score": b.score,
                                     "id": b.id, "rid": b.rid}))
        if not out:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in
                                 zip(("anchor", "place", "score", "id", "rid"), ("i8", "i4", "i8", "i8", "i8"))})
        return pd.concat(out, ignore_index=True)
    return run


def best_rows(anchors: DataFrame, trees: DataFrame, k: int, same: bool, own: bool | None = None) -> DataFrame:
    """(anchor, place, score, id, rid, nth): the k best rows of every window
    ``spans`` of (rid, label, dims, q, batch, spans), of the anchor's label or
    of others. ``own`` keeps to the trees of the anchor's batch. Stored."""
    pairs = materialize(planned(anchors, trees, same, own)
                        .withColumn("strip", F.floor(F.col("block") / STRIP_BLOCKS)), "neg-pairs")
    # names of their own: both sides come from the same pairs
    left, right = (d.toDF(*d.columns) for d in (
        anchors.join(pairs.select("dims", "batch", "strip").distinct(), ["dims", "batch"]), trees.join(pairs, ["dims", "block"])))
    keys = ["dims", "batch", "strip"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_searcher(k, same), FOUND)
    order = Window.partitionBy("anchor", "place").orderBy(F.col("score").desc(), "id", "rid")
    return materialize(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k), "neg-found")


def _hundredths(score: Column, part: int, up: bool) -> Column:
    """score * part / 100 rounded up or down, without overflow."""
    rest = F.pmod(score, F.lit(100))
    inner = rest * part / 100
    return ((score - rest) / 100).cast("long") * part + (F.ceil(inner) if up else F.floor(inner))


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   window: tuple[int, int] = WINDOW) -> DataFrame:
    """For each anchor (rows of :func:`prepared` that hold ``anchors``) and
    each of its ``positives`` best rows of the same label, the ``negatives``
    best rows of other labels whose score lies in the ``window`` (hundredths of
    the positive's score): anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score."""
    placed = in_blocks(rows)
    trees = cover_trees(placed)
    asked = (placed.where(anchors).select("rid", "id", "label", "dims", "q",
                                          F.floor(F.col("block") / BATCH_BLOCKS).alias("batch")))
    least = F.lit(-LARGEST)
    whole = asked.withColumn("spans", F.array(F.struct(F.lit(0).alias("place"), least.alias("least"), F.lit(LARGEST).alias("most"))))
    near = best_rows(whole, trees, positives, True, own=True)
    floor = near.where(F.col("nth") == positives).select(F.col("anchor").alias("rid"), F.col("score").alias("floor"))
    raised = F.array(F.struct(F.lit(0).alias("place"), F.coalesce("floor", least).alias("least"), F.lit(LARGEST).alias("most")))
    best = best_rows(asked.join(floor, "rid", "left").withColumn("spans", raised).drop("floor"), trees, positives, True)
    score = F.col("score")
    span = F.struct(F.col("nth").alias("place"), _hundredths(score, window[0], True).alias("least"),
                    _hundredths(score, window[1], False).alias("most"))
    spans = (best.select(F.col("anchor").alias("rid"), span.alias("s")).where("s.least <= s.most").groupBy("rid")
             .agg(F.array_sort(F.collect_list("s")).alias("spans")))
    found = best_rows(asked.join(spans, "rid"), trees, negatives, False)
    names = asked.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
    positive = best.select("anchor", F.col("nth").alias("place"), F.col("id").alias("positive_id"),
                           F.col("score").alias("positive_score"))
    return (found.join(positive, ["anchor", "place"]).join(names, "anchor")
            .select("anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
