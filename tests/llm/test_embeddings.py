import math
import random

import numpy as np

from rankweave.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, gid int"


def brute(rows, threshold=0.93):
    vec = [None if v is None or lab is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v)
           else np.array(v, np.float32).astype(float) for _, v, lab in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if vec[i] is None or vec[j] is None or rows[i][2] != rows[j][2] or len(vec[i]) != len(vec[j]):
                continue
            if vec[i] @ vec[j] / math.sqrt((vec[i] @ vec[i]) * (vec[j] @ vec[j])) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    out = []
    for i, (d, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((d, links[i], low, d is not None and d == low))
    return sorted(out, key=str)


def corpus(dims=24):
    rng = random.Random(8)
    rows, at = [], 0
    for g in range(50):
        base = [rng.gauss(0, 1) for _ in range(dims)]
        for c in range(rng.choice([1, 1, 2, 9])):
            noise = rng.choice([0, 0.1, 0.25, 0.3])
            scale = rng.choice([1, 1, 1000.0])
            rows.append((at, [scale * (x + rng.gauss(0, noise)) for x in base], rng.choice([1, 2]) if g % 5 == 0 else g % 3))
            at += 1
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * dims, 1), (903, [float("nan")] * dims, 1), (904, [None] * dims, 1),
             (905, [float("inf")] + [1.0] * (dims - 1), 1), (906, rows[0][1], None), (907, rows[0][1], rows[0][2]),
             (907, rows[0][1], rows[0][2]), (None, rows[1][1], rows[1][2]), (908, [1.0, 2.0], 1), (909, [1.0, 2.01], 1)]
    return rows


def test_equals_brute_force_for_any_tile_size(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    want = brute(rows)
    assert sorted((tuple(r) for r in E.near_duplicates(df).collect()), key=str) == want
    monkeypatch.setattr(E, "TILE_ROWS", 7)
    monkeypatch.setattr(E, "BLOCK_DIMS", 5)
    assert sorted((tuple(r) for r in E.near_duplicates(df).collect()), key=str) == want


def test_empty_and_all_invalid(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(1, None, 1, "", 0)], SCHEMA)
    assert [tuple(r) for r in E.near_duplicates(one).collect()] == [(1, 0, 1, True)]


def test_whole_table_equals_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table.collect()]
    assert sorted((tuple(r) for r in E.near_duplicates(table).collect()), key=str) == brute(rows)
