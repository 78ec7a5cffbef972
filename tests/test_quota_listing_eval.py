import random

import pytest

from pyspark.sql import functions as F

from rankweave.operators import evaluate, quota
from rankweave.sources import listing


def calls(spark, n, day="2024-01-01"):
    return spark.createDataFrame([(i, f"{day} 00:{i // 60:02d}:{i % 60:02d}") for i in range(n)],
                                 "event_id long, t string").select("event_id", F.col("t").cast("timestamp").alias("ts"))


def assigned(spark, n, keys):
    k = spark.createDataFrame(keys, "key_name string, idx long, daily_limit long, threshold double")
    return [r["key_name"] for r in quota.quota_assign(calls(spark, n), k).orderBy("n").collect()]


def walk(n, keys):
    """Sequential reference: each call uses the first key under its line."""
    counts = {k: 0 for k, *_ in keys}
    out = []
    for _ in range(n):
        if not keys:
            out.append("unavailable")
            continue
        for k, _i, lim, thr in sorted(keys, key=lambda x: x[1]):
            if counts[k] < lim * thr:
                counts[k] += 1
                out.append(k)
                break
        else:
            out.append("quota_exceeded")
    return out


def test_quota_vectors(spark):
    keys = [("k1", 0, 100, 0.9), ("k2", 1, 100, 0.9), ("k3", 2, 100, 0.9)]
    got = assigned(spark, 300, keys)
    assert got[179] == "k2" and got[180] == "k3" and got[269] == "k3" and got[270] == "quota_exceeded"
    assert set(assigned(spark, 3, [])) == {"unavailable"}


def test_quota_equals_sequential_walk(spark):
    rnd = random.Random(3)
    for _ in range(4):
        keys = [(f"k{i}", i, rnd.choice([0, 1, 5, 10]), rnd.choice([0.5, 0.8, 1.0, 0.33])) for i in range(rnd.randint(1, 3))]
        n = rnd.randint(1, 40)
        assert assigned(spark, n, keys) == walk(n, keys)


def test_day_sequence_spans_buckets(spark):
    seq = quota.day_sequence(calls(spark, 150)).orderBy("event_id").collect()
    assert [r["n"] for r in seq] == list(range(1, 151))


def test_listing_parse(spark):
    text = "Intro line\n1. First title\n   URL: https://a\n   snippet one\n   wrapped\n\n2. Second\n   more"
    df = spark.createDataFrame([(1, text)], "listing_id long, text string")
    got = [(r["record"], r["title"], r["url"], r["snippet"]) for r in listing.parse_listing(df).orderBy("record").collect()]
    assert got == [(1, "First title", "https://a", "snippet one wrapped"), (2, "Second", "", "more")]


def test_listing_without_a_record(spark):
    df = spark.createDataFrame([(1, "No results.\nTry again"), (2, "1. T\n   URL: https://a")], "listing_id long, text string")
    got = sorted(tuple(r) for r in listing.parse_listing(df, source="web").collect())
    assert got == [(1, 1, "web", "", "No results.\nTry again"), (2, 1, "T", "https://a", "")]


def test_sections_parse(spark):
    text = "[e0]\n1. T1\n   http://u1\n   body\n\n[nope]\n알 수 없는 검색엔진입니다.\n\n[e1]\n1. T2\n   https://u2\n   b2"
    df = spark.createDataFrame([(1, text)], "query_id long, text string")
    got = [(r["engine"], r["title"], r["url"], r["snippet"])
           for r in listing.parse_sections(df, "query_id").orderBy("record").collect()]
    assert got == [("e0", "T1", "http://u1", "body 알 수 없는 검색엔진입니다."), ("e1", "T2", "https://u2", "b2")]


def test_hits_and_mean(spark):
    r = spark.createDataFrame([(1, 1, ["a", "a", "c"])], "query_id long, pos long, doc_tokens array<string>")
    q = spark.createDataFrame([(1, ["a", "b"])], "query_id long, q_tokens array<string>")
    assert evaluate.term_hits(r, q).first()["hits"] == 1
    empty = spark.createDataFrame([], "query_id long, ranking string, pos long, hits long")
    every = spark.createDataFrame([(1, "bm25"), (2, "bm25")], "query_id long, ranking string")
    assert [r["mean_hits"] for r in evaluate.mean_hits(empty, every).collect()] == [0.0, 0.0]


def test_usage_report_has_keyless_sources_and_endpoints(spark):
    import datetime as dt
    rows = [(i, dt.datetime(2024, 1, 15 + i // 5, 8, i), "free" if i % 2 else "paid") for i in range(8)]
    calls = spark.createDataFrame(rows, "event_id long, ts timestamp, key string")
    keys = spark.createDataFrame([("k1", 0, 2, 1.0), ("k2", 1, 10, 1.0)], "key_name string, idx long, daily_limit long, threshold double")
    reg = spark.createDataFrame([("e0", 0, None, None, "free"), ("e1", 1, "g", "news", None)],
                                "engine string, pos long, shared_key_group string, endpoint string, call_key string")
    got = sorted((tuple(r) for r in quota.usage_report(calls, keys, reg, "2024-01-15").collect()), key=str)
    assert got == [("e0", None, None, 2, None, None, None), ("e1", "news", "k1", 2, 2, 1.0, 0), ("e1", "news", "k2", 3, 10, 0.3, 7)]


def test_one_day_is_rewritten_and_the_session_unchanged(spark, tmp_path):
    path, name = str(tmp_path / "counts"), "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(name)
    frame = lambda rows: spark.createDataFrame(rows, "key string, day string, n long")
    assert quota.read_counts(spark, path).count() == 0
    quota.write_counts(frame([("a", "2024-01-01", 1), ("a", "2024-01-02", 2)]), path)
    quota.write_counts(frame([("a", "2024-01-02", 5), ("b", "2024-01-02", 6)]), path)
    assert sorted(tuple(r) for r in quota.read_counts(spark, path).collect()) == [
        ("a", "2024-01-01", 1), ("a", "2024-01-02", 5), ("b", "2024-01-02", 6)]
    assert spark.conf.get(name) == before
    damaged = next((tmp_path / "counts" / "day=2024-01-01").glob("part-*.parquet"))
    damaged.write_bytes(b"no parquet")
    for crc in (tmp_path / "counts" / "day=2024-01-01").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception):
        quota.read_counts(spark, path).collect()
    assert quota.read_counts(spark, path, skip_corrupt=True).count() == 2
