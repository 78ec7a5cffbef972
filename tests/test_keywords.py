import random

from pyspark.sql import functions as F

from rankweave.functions.text import first_matching_keyword
from rankweave.operators import filters, keywords


def rows(spark, texts):
    return spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, title string, snippet string")


def test_table_equals_the_chain(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abcé한") for _ in range(n))
    words = [word(rnd.randint(1, 6)) for _ in range(50)]
    texts = [" ".join(word(rnd.randint(1, 9)) for _ in range(rnd.randint(0, 4))) for _ in range(150)] + ["", "A", None]
    df = rows(spark, texts + texts[:5])
    want = {r[0]: r[1] for r in df.select("doc_id", first_matching_keyword(filters.policy_text(df), words)).collect()}
    got = filters.with_excluded_keyword(df, keywords.keyword_table(spark, words))
    assert got.columns == ["doc_id", "title", "snippet", "keyword"]
    assert {r["doc_id"]: r["keyword"] for r in got.collect()} == want
    assert any(want.values()) and not all(want.values())


def test_order_case_and_odd_keywords(spark):
    table = spark.createDataFrame([(3, "needle"), (1, "Needle"), (2, "eedl"), (5, "eedl"), (4, None), (9, "x")], "pos long, keyword string")
    df = rows(spark, ["a needle", "a Needle", "x", "NEEDLE", None])
    got = {r["doc_id"]: r["keyword"] for r in filters.with_excluded_keyword(df, table).collect()}
    assert got == {0: "eedl", 1: "Needle", 2: "x", 3: None, 4: None}
    empty = spark.createDataFrame([(1, "zz"), (2, "")], "pos long, keyword string")
    got = {r["doc_id"]: r["keyword"] for r in filters.with_excluded_keyword(rows(spark, ["zz", "", "a"]), empty).collect()}
    assert got == {0: "zz", 1: "", 2: ""}
    none = spark.createDataFrame([], "pos long, keyword string")
    assert filters.with_excluded_keyword(rows(spark, ["a"]), none).first()["keyword"] is None
    assert filters.with_excluded_keyword(rows(spark, []), table).count() == 0


def test_twenty_thousand_keywords_run(spark):
    words = [f"kw{i:05d}" for i in range(20_000)]
    df = rows(spark, [f"see kw{i * 7 % 25_000:05d} and kw{i % 300:05d} here" for i in range(2_000)])
    got = filters.with_excluded_keyword(df, words)  # a long list is joined, not chained
    for r in got.where("doc_id % 97 = 0").collect():
        numbers = [n for n in (r["doc_id"] * 7 % 25_000, r["doc_id"] % 300) if n < 20_000]
        assert r["keyword"] == f"kw{min(numbers):05d}"


def test_exclusion_filter_takes_a_long_list(spark):
    raw = spark.createDataFrame([(1, "e", 1, "has kw00070", ""), (1, "e", 2, "clean", ""), (1, "e", 3, "fine", "")],
                                "query_id long, engine string, rank long, title string, snippet string")
    words = [f"kw{i:05d}" for i in range(100)]
    kept = filters.exclusion_filter(raw, 1, words).select("rank", "src_rank", F.col("title")).collect()
    assert [tuple(r) for r in kept] == [(1, 2, "clean")]
