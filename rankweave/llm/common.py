"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import read_table, scratch_path

__all__ = ["WORD_PATTERN", "connected_components", "forest", "materialize", "read_table", "running_before", "text_bytes",
           "word_count"]

#: a word: a run of anything but the six ASCII white-space characters
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: hash ranges a group is divided into for running totals
BUCKET_BITS = 10


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: later jobs reread the files, also after the loss of an
    executor, and rows derived from them stay the same in every job.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def running_before(df: DataFrame, keys: list[str], order: str, value: Column, out: str,
                   ties: list[str] | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``keys``
    that precede the row in the order of ``order`` (a hash spread over all
    longs), then ``ties``.

    A group may hold any part of all rows: it is divided by hash range, rows
    are summed inside a range and ranges are summed in a table of at most
    2**BUCKET_BITS rows for each group. ``df`` is used twice, so it should be
    a stored table. Keys must not be null.
    """
    part = F.shiftright(F.col(order), 64 - BUCKET_BITS)
    df = df.withColumn("__part", part).withColumn("__value", value.cast("long"))
    totals = df.groupBy(*keys, "__part").agg(F.sum("__value").alias("__total"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__part", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"))
    inside = (Window.partitionBy(*keys, "__part").orderBy(order, *(ties or []))
              .rowsBetween(Window.unboundedPreceding, -1))
    return (df.join(offsets, [*keys, "__part"])
            .withColumn(out, F.col("__offset") + F.coalesce(F.sum("__value").over(inside), F.lit(0)))
            .drop("__part", "__value", "__offset"))


def _to_roots(spark: SparkSession, parents: DataFrame) -> DataFrame:
    """Pointer jumping on (node, root) until every root is its own root."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("__up"))
        jumped = materialize(
            parents.join(up, "root", "left")
            .select("node", F.coalesce("__up", "root").alias("root"),
                    (F.coalesce("__up", "root") != F.col("root")).alias("__moved")), "jump")
        parents = jumped.select("node", "root")
        if jumped.where("__moved").isEmpty():
            return parents


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected edges (two longs, not
    null); root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks
    to their roots and contracts the edges to roots; the nodes left fall by
    half at least, so the rounds are logarithmic for any shape. Nothing but
    emptiness tests reaches the driver.
    """
    spark = edges.sparkSession

    def tidy(e: DataFrame) -> DataFrame:
        return materialize(
            e.where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")

    left = tidy(edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")))
    labels = None
    while not left.isEmpty():
        both = left.select(F.col("x").alias("node"), F.col("y").alias("to")).union(left.select("y", "x"))
        hooks = materialize(both.groupBy("node").agg(F.min("to").alias("to"))
                            .select("node", F.least("node", "to").alias("root")), "hooks")
        roots = _to_roots(spark, hooks)
        labels = roots if labels is None else materialize(
            labels.withColumnRenamed("root", "__mid")
            .join(roots.select(F.col("node").alias("__mid"), "root"), "__mid", "left")
            .select("node", F.coalesce("root", "__mid").alias("root")), "labels")
        left = tidy(left
                    .join(roots.select(F.col("node").alias("x"), F.col("root").alias("rx")), "x")
                    .join(roots.select(F.col("node").alias("y"), F.col("root").alias("ry")), "y")
                    .select(F.col("rx").alias("x"), F.col("ry").alias("y")))
    if labels is None:
        return left.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return labels


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that connect the same nodes as the links x, y do."""
    nodes, flat = np.unique(np.concatenate([x, y]), return_inverse=True)
    u, v = flat[:len(x)], flat[len(x):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[root]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]
