"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are compared inside a label only. Equal vectors are one
representative with a count. Unit vectors are rotated to the principal axes
(an orthogonal map, so cosines stay), numbered along the first axis and cut
into tiles; two tiles are compared if the boxes around their leading
coordinates come near enough for the threshold. Inside a pair of tiles the dot
products are accumulated over blocks of dimensions, leading ones first; a
pair stops when its sum plus the product of the two suffix norms cannot
reach the threshold. What is left is verified by the cosine of the original
vectors in double precision.

A pair of tiles returns the number of links of each vector and a spanning
forest of the links, never the links themselves, so copies and dense groups
stay linear in rows.

Nulls and ties: vectors that are null, empty, zero or hold a null or
non-finite component, and rows with a null label, link with nothing and are
returned as themselves; vectors of different length do not link; rows equal
in label and vector link with each other. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, forest, materialize
from .mixing import number_in_order

THRESHOLD = 0.93
TILE_ROWS = 2048
BLOCK_DIMS = 8
BOX_DIMS = 8
#: pairs alive from which a row block is no longer kept as a matrix
SPARSE = 0.05
SLACK = 1e-6


def _valid(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: pd.Series) -> np.ndarray:
    m = np.stack(rows.to_numpy()).astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Rotation to the principal axes of the unit vectors of ``dims``
    components. Sums of outer products by task; the driver gets dims rows."""
    def outer(batches):
        total = np.zeros((dims, dims))
        for b in batches:
            if len(b):
                u = _unit(b["vector"])
                total += u.T @ u
        yield pd.DataFrame({"i": np.arange(dims), "row": list(total)})

    parts = vectors.where(F.size("vector") == dims).select("vector").mapInPandas(outer, "i int, row array<double>")
    summed = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    gram = np.zeros((dims, dims))
    for r in summed.collect():
        gram[r.i, r.j] = r.x
    values, axes = np.linalg.eigh((gram + gram.T) / 2)
    return axes[:, np.argsort(-values)]


def _near(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the rotated unit rows of a and b that may reach the threshold."""
    dims = a.shape[1]
    least = threshold - SLACK
    tail = lambda m: np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]))
    ta, tb = tail(a), tail(b)
    i = j = total = None
    dense = np.zeros((len(a), len(b)))
    for at in range(0, dims, BLOCK_DIMS):
        end = min(at + BLOCK_DIMS, dims)
        rest_a = ta[:, end] if end < dims else np.zeros(len(a))
        rest_b = tb[:, end] if end < dims else np.zeros(len(b))
        if i is None:
            dense += a[:, at:end] @ b[:, at:end].T
            alive = dense + rest_a[:, None] * rest_b[None, :] >= least
            if end == dims or alive.mean() <= SPARSE:
                i, j = np.nonzero(alive)
                total = dense[i, j]
        else:
            total = total + np.einsum("ij,ij->i", a[i, at:end], b[j, at:end])
            keep = total + rest_a[i] * rest_b[j] >= least
            i, j, total = i[keep], j[keep], total[keep]
    return i, j


def _compare(axes: dict[int, np.ndarray], threshold: float):
    def compare(key, pair):
        """Links of a pair of tiles: (a, b, links); a forest edge has links 0, a count has b null."""
        first, second = key[2], key[3]
        one = pair[pair["tile"] == first]
        two = one if first == second else pair[pair["tile"] == second]
        empty = pd.DataFrame({"a": [], "b": [], "links": []}).astype({"a": "Int64", "b": "Int64", "links": "Int64"})
        if one.empty or two.empty:
            return empty
        full = [np.stack(t["vector"].to_numpy()).astype(np.float64) for t in (one, two)]
        scaled = [m / np.abs(m).max(axis=1, keepdims=True) for m in full]
        norms = [np.sqrt((m * m).sum(axis=1)) for m in scaled]
        turned = [(m / n[:, None]) @ axes[m.shape[1]] for m, n in zip(scaled, norms)]
        ids = [t["gid"].to_numpy() for t in (one, two)]
        weight = [t["n"].to_numpy() for t in (one, two)]
        degree = [np.zeros(len(one), np.int64), np.zeros(len(two), np.int64)]
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(one), 256):
            i, j = _near(turned[0][at:at + 256], turned[1], threshold)
            i = i + at
            if first == second:
                i, j = i[i < j], j[i < j]
            for part in range(0, len(i), 1 << 16):
                p, q = i[part:part + (1 << 16)], j[part:part + (1 << 16)]
                cosine = np.einsum("ij,ij->i", scaled[0][p], scaled[1][q]) / (norms[0][p] * norms[1][q])
                p, q = p[cosine >= threshold], q[cosine >= threshold]
                np.add.at(degree[0], p, weight[1][q])
                np.add.at(degree[1], q, weight[0][p])
                u, v = forest(np.concatenate([u, ids[0][p]]), np.concatenate([v, ids[1][q]]))
        out = [pd.DataFrame({"a": u, "b": pd.array(v, "Int64"), "links": 0})]
        for node, links in zip(ids, degree):
            out.append(pd.DataFrame({"a": node[links > 0], "b": pd.array([None] * int((links > 0).sum()), "Int64"),
                                     "links": links[links > 0]}))
        return pd.concat(out, ignore_index=True)
    return compare


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly),
    component_id (smallest id reachable) and kept (whether it is that one)."""
    vector = F.col(vector_col)
    rows = materialize(
        table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vector"),
                     (F.col(label_col).isNotNull() & _valid(vector)).alias("ok"))
        .withColumn("h1", F.xxhash64("label", "vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector", "label")), "vec-rows")
    # two seeded 64-bit hashes stand for label and vector
    groups = (rows.where("ok").groupBy("h1", "h2")
              .agg(F.min("id").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"),
                   F.first("vector").alias("vector")))
    groups = materialize(groups.withColumn("gid", F.monotonically_increasing_id())
                         .withColumn("dims", F.size("vector")), "vec-groups")
    sizes = [r.dims for r in groups.select("dims").distinct().collect()]
    axes = {d: principal_axes(groups, d) for d in sizes}

    lead = _leading(groups, axes)
    numbered = number_in_order(lead, F.struct("label", "dims", F.col("lead")[0], "gid"), "place", "vec-order")
    starts = numbered.groupBy("label", "dims").agg(F.min("place").alias("start"))
    tile = F.floor((F.col("place") - F.col("start")) / TILE_ROWS).cast("int")
    tiled = materialize(numbered.join(starts, ["label", "dims"])
                        .select("label", "dims", tile.alias("tile"), "gid", "lead"), "vec-tiles")
    width = F.posexplode("lead").alias("axis", "x")
    box = (tiled.select("label", "dims", "tile", width).groupBy("label", "dims", "tile", "axis")
           .agg(F.min("x").alias("low"), F.max("x").alias("high"))
           .groupBy("label", "dims", "tile")
           .agg(F.array_sort(F.collect_list(F.struct("axis", "low", "high"))).alias("box")))
    box = materialize(box, "vec-boxes")
    gap = F.aggregate(
        F.zip_with("box", "other", lambda x, y: F.greatest(F.lit(0.0), y["low"] - x["high"], x["low"] - y["high"])),
        F.lit(0.0), lambda s, g: s + g * g)
    other = box.select("label", "dims", F.col("tile").alias("second"), F.col("box").alias("other"))
    # |u - v|^2 = 2 - 2 cos for unit vectors; a box holds less than the whole distance
    pairs = (box.withColumnRenamed("tile", "first").join(other, ["label", "dims"])
             .where((F.col("first") <= F.col("second")) & (gap <= 2 - 2 * threshold + SLACK))
             .select("label", "dims", "first", "second"))
    pairs = materialize(pairs, "vec-pairs")
    use = (pairs.withColumn("tile", F.explode(F.array_distinct(F.array("first", "second"))))
           .join(tiled.select("label", "dims", "tile", "gid"), ["label", "dims", "tile"])
           .join(groups.select("gid", "n", "vector"), "gid"))
    found = materialize(
        use.select("label", "dims", "first", "second", "tile", "gid", "n", "vector")
        .groupBy("label", "dims", "first", "second")
        .applyInPandas(_compare(axes, threshold), "a long, b long, links long"), "vec-links")

    links = found.where("b is null").groupBy(F.col("a").alias("gid")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "gid")
    by_root = groups.select("h1", "h2", "gid", "low", "n").join(roots, "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    lows = by_root.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = (by_root.join(lows, "root").join(links, "gid", "left")
               .select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    joined = rows.where("ok").join(classes, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _leading(groups: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """(label, dims, gid, lead): the first BOX_DIMS rotated coordinates."""
    def lead(batches):
        for b in batches:
            for dims, part in b.groupby("dims"):
                turned = _unit(part["vector"]) @ axes[dims][:, :BOX_DIMS]
                yield pd.DataFrame({"label": part["label"], "dims": part["dims"], "gid": part["gid"], "lead": list(turned)})

    label_type = dict(groups.dtypes)["label"]
    return groups.select("label", "dims", "gid", "vector").mapInPandas(
        lead, f"label {label_type}, dims int, gid long, lead array<double>")
