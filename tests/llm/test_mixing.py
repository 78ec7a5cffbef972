import random
import re

import pytest
from pyspark.sql import functions as F

from rankweave.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size int, target string, rank int"


def corpus(n=600, hot=200):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([1, 3, 20, 60])), rng.choice(["b", "a", "é", "Z", "c", ""])) for i in range(n)]
    rows += [(10_000 + i, "x y\tz", "hot") for i in range(hot)]
    rows += [(20_000, None, "b"), (20_001, "", None), (20_002, "only one", None), (None, "p q", "a"), (20_003, " ", "zero"),
             (20_004, "same", "a"), (20_004, "same", "a"), (20_005, "long " * 3000, "c")]
    return rows


def brute_targets(rows):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, free, target = 1.5 * sum(size.values()), set(names), {}
    while True:
        level = budget / sum(weight[s] for s in free)
        over = {s for s in free if 2 * size[s] < level * weight[s]}
        if not over:
            return size, {**target, **{s: level * weight[s] for s in free}}
        for s in over:
            target[s] = 2.0 * size[s]
            budget -= target[s]
        free -= over


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", 1) for r in rows], SCHEMA)


def test_sizes_targets_and_taken(spark):
    rows = corpus()
    size, target = brute_targets(rows)
    src = {i: s for i, _, s in rows}
    got = M.mix_sizes(frame(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted(
        (i or -1, len((t or "").split())) for i, t, _ in rows)
    taken = {}
    for r in got:
        s = src[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in target.items():
        largest = max(len((x or "").split()) for _, x, y in rows if y == s)
        assert abs(taken[s] - t) <= max(largest, 1), s
    again = M.mix_sizes(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_repeats_rows(spark):
    rows = corpus(80, 20)
    df = frame(spark, rows)
    times = {r.doc_id: r.repeats for r in M.mix_sizes(df).collect()}
    out = M.mix(df)
    assert out.columns == df.columns
    seen = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    copies = {}
    for i, _, _ in rows:
        copies[i] = copies.get(i, 0) + 1
    assert seen == {i: copies[i] * t for i, t in times.items() if t}


def test_empty_and_wordless(spark):
    assert M.mix_sizes(frame(spark, [])).count() == 0 and M.mix(frame(spark, [])).count() == 0
    (r,) = M.mix_sizes(frame(spark, [(1, None, None)])).collect()
    assert (r["size"], r.source_size, r.taken) == (0, 0, 0) and r.target == 0


def test_no_python_and_no_single_task(spark):
    df = M.mix_sizes(frame(spark, corpus(30, 5)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_numbers_follow_the_order(spark):
    df = M.materialize(spark.range(500).selectExpr("cast(id * 7919 % 500 as string) as s"), "numbers")
    got = M.number_in_order(df, F.col("s").asc_nulls_last(), "place", "places").orderBy("place").collect()
    assert [r.place for r in got] == list(range(500)) and [r.s for r in got] == sorted(r.s for r in got)
