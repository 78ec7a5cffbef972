import random
import re
from collections import defaultdict

from rankweave.llm import linededup as L

SCHEMA = "doc_id long, text string, source string, line int, kept string, hash int"


def norm(x):
    x = re.sub(r"[\x09\x0B-\x0D\x20]+", " ", x).strip(" ").lower()
    return x if re.search(r"[^\W_]", x) else None


def brute(rows, least):
    sites = defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n") if t is not None else []:
            if s is not None and norm(x) is not None:
                sites[norm(x)].add(s)
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if norm(x) is None or len(sites[norm(x)]) < least]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    vocab = [f"Line {i} of  text" for i in range(30)] + ["", "***", "  all\trights reserved ", "ALL RIGHTS RESERVED", "ünï $&1"]
    rows = [(i, "\n".join(rng.choices(vocab, k=rng.randint(1, 5))), f"s{rng.randint(0, 9)}") for i in range(80)]
    rows += [(900, None, "s1"), (901, "", "s1"), (902, "\n", None), (None, "Line 1 of text", "s2"), (903, "own line", "s3"),
             (903, "own line", "s3"), (904, "solo " * 200_000 + "\nall rights reserved", "s4"), (905, "Line 2 of text\n\nend", None)]
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in L.remove_boilerplate(df, **kw).collect()), key=str)


def test_equals_brute_force(spark):
    for least in (2, 5, 9):
        assert run(spark, corpus(), min_sites=least) == brute(corpus(), least)


def test_lines_far_above_the_threshold_need_no_exact_count(spark):
    rows = [(i, "same line\nown %d" % i, f"site{i}") for i in range(400)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    (line,) = L.boilerplate(L.hashed_lines(df)).collect()
    assert abs(line.sites - 400) < 60
    assert run(spark, rows) == brute(rows, 5)


def test_empty(spark):
    assert run(spark, []) == []
