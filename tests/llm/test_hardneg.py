import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(rows):
    out = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        if sum(x * x for x in q) <= hardneg.LARGEST and all(abs(x) < 2**31 for x in q):
            out.append((i, q, label))
    return out


def brute(rows, step, positives=5, negatives=3):
    live = usable(rows)
    out = []
    for n, (i, q, label) in enumerate(live):
        if i % step:
            continue
        scored = [(-sum(a * b for a, b in zip(q, p)), j, other) for m, (j, p, other) in enumerate(live)
                  if m != n and len(p) == len(q)]
        best = sorted(s[:2] for s in scored if s[2] == label)[:positives]
        for s, j in best:
            fits = sorted(t for t in scored if t[2] != label and 50 * -s <= 100 * -t[0] <= 95 * -s)[:negatives]
            out += [(i, j, k + 1, t[1], -s, -t[0]) for k, t in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, step, schema=SCHEMA):
    found = hardneg.hard_negatives(hardneg.prepared(spark.createDataFrame(rows, schema)), F.col("id") % step == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def cloud(rng, n, dims, labels, spread=0.6):
    centres = rng.normal(size=(8, dims))
    v = centres[rng.integers(0, 8, n)] + spread * rng.normal(size=(n, dims))
    return [(i, (x * rng.uniform(0.1, 3)).astype(np.float32).tolist(), int(rng.integers(0, labels))) for i, x in enumerate(v)]


def test_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = cloud(rng, 700, 12, 4)
    assert mined(spark, rows, 25) == brute(rows, 25)


def test_several_blocks_and_a_hot_label(spark):
    rng = np.random.default_rng(8)
    n = 2 * hardneg.BLOCK_ROWS + 300
    rows = [(i, v, 0 if i % 3 else label) for i, v, label in cloud(rng, n, 6, 40)]
    rows += [(n + i, rows[1][1], i % 2) for i in range(300)]  # copies of one vector
    assert mined(spark, rows, 200) == brute(rows, 200)


def test_rows_that_take_no_part_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = cloud(rng, 120, 4, 3)
    nan, inf = float("nan"), float("inf")
    odd = [(200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [nan, 0.0, 0.0, 0.0], 1), (203, [inf, 0.0, 0.0, 0.0], 1),
           (204, [1.0, 0.0, 0.0, 0.0], None), (None, [1.0, 0.0, 0.0, 0.0], 1), (205, [3e38, 0.0, 0.0, 0.0], 1),
           (210, [0.0] * 4, 1), (220, [0.0] * 4, 2), (230, [], 1), (240, [], 1), (250, [], 2), (260, [1.0, 2.0], 1),
           (270, [2.0, 2.0], 1), (280, [1.0, 1.0], 2), (290, [-1.0, -1.0], 2)]
    rows += odd + [(300 + i, [0.5, 0.25, 0.5, 0.125], i % 3) for i in range(40)]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_repeated_rows_are_rows(spark):
    rows = [(10, [1.0, 0.0], 1), (10, [1.0, 0.0], 1), (3, [0.7, 0.0], 2), (3, [0.7, 0.0], 2)]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=5) * 2e6).astype(np.float32).tolist(), int(i % 3)) for i in range(200)]
    assert any(sum(x * x for x in q) > hardneg.EXACT for _, q, _ in usable(rows))
    assert mined(spark, rows, 20) == brute(rows, 20)


def test_empty_table_and_clashing_columns(spark):
    assert mined(spark, [], 50) == []
    rng = np.random.default_rng(7)
    rows = cloud(rng, 60, 3, 2)
    wide = [(*r, "x", 1, 2, 3) for r in rows]
    assert mined(spark, wide, 20, SCHEMA + ", q string, rid int, block int, dims int") == brute(rows, 20)


@pytest.mark.parametrize("dims, spread", [(3, 0.05), (8, 0.5), (24, 2.0), (0, 1.0)])
def test_tree_covers_and_separates(dims, spread):
    rng = np.random.default_rng(dims)
    rows = np.floor(256 * (rng.normal(size=(6, dims))[rng.integers(0, 6, 900)] + spread * rng.normal(size=(900, dims))))
    rows[700:] = rows[0]
    t = hardneg.CoverTree(rows)
    x = rows[t.order]
    points = np.column_stack([x, np.sqrt(np.maximum(0, (x * x).sum(axis=1).max() - (x * x).sum(axis=1)))])
    away = lambda a, b: np.sqrt(((points[a] - points[b]) ** 2).sum(axis=-1))
    leaves = np.nonzero(t.leaf)[0]
    assert sorted(i for n in leaves for i in range(t.low[n], t.high[n])) == list(range(900))
    for n in range(len(t.parent)):
        inside = np.arange(t.low[n], t.high[n])
        assert t.centre[n] in inside and away(inside, t.centre[n]).max() <= t.radius[n] + 1e-6
        children = np.nonzero(t.parent == n)[0]
        if len(children):
            assert t.centre[n] in t.centre[children]  # nesting
            gaps = [away(t.centre[a], t.centre[b]) for a in children for b in children if a < b]
            assert min(gaps) >= t.radius[children].max() - 1e-6  # separation by the covering radius


def test_clustered_rows_are_mostly_skipped():
    rng = np.random.default_rng(1)
    centres = 40 * rng.normal(size=(50, 16))
    rows = np.floor(256 * (centres[rng.integers(0, 50, 2000)] + rng.normal(size=(2000, 16))))
    t = hardneg.CoverTree(rows)
    tree = {"vectors": rows[t.order], "id": t.order, "rid": t.order, "label": np.zeros(2000, np.int64), "norm": t.norm,
            "parent": t.parent, "centre": t.centre, "low": t.low, "high": t.high, "leaf": t.leaf, "radius": t.radius,
            "levels": t.levels}
    seen = []
    verify = hardneg._scores

    def counted(a, b, exact):
        seen.append(len(a) * len(b))
        return verify(a, b, exact)

    hardneg._scores = counted
    try:
        whole = [[{"place": 0, "least": -hardneg.LARGEST, "most": hardneg.LARGEST}]] * 20
        a = hardneg.Anchors(np.arange(20), np.zeros(20, np.int64), rows[:20], whole, 5, True)
        hardneg.search(a, tree, np.arange(20))
    finally:
        hardneg._scores = verify
    assert sum(seen) < 0.4 * 20 * 2000
    s = (rows[:20] @ rows.T).astype(np.int64)
    s[np.arange(20), np.arange(20)] = hardneg.LOWEST
    want = np.sort(s, axis=1)[:, ::-1][:, :5].reshape(-1)
    assert np.array_equal(a.best.score, want)
