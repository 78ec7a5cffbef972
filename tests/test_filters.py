from pyspark.sql import functions as F

from rankweave.operators import filters


def cands(spark, rows):
    return spark.createDataFrame(rows, "query_id long, engine string, rank long, title string, snippet string, url string")


def test_pdf_filter(spark):
    urls = ["/a.PDF?x", "/a.pdf#p", "/a.pdf", "/a.pdfx", None, ""]
    df = cands(spark, [(1, "e", i + 1, "t", "s", u) for i, u in enumerate(urls)])
    kept = [r["url"] for r in filters.pdf_filter(df).orderBy("rank").collect()]
    assert kept == ["/a.pdfx", None, ""]


def test_exclusion_and_status(spark):
    rows = [(1, "e0", 1, "a", "whst", "u"), (1, "e0", 2, "b", "ok", "u"), (1, "e0", 3, "c", "ok", "u"),
            (2, "e0", 1, "a", "whst", "u"), (2, "e0", 2, "b", "xwhst", "u")]
    df = cands(spark, rows)
    kept = filters.exclusion_filter(df, 1, ["whst"])
    got = sorted((r["query_id"], r["src_rank"], r["rank"]) for r in kept.collect())
    assert got == [(1, 2, 1)]
    req = spark.createDataFrame([(1, "e0"), (2, "e0"), (3, "e0")], "query_id long, engine string")
    st = {r["query_id"]: r["status"] for r in filters.policy_status(req, df, kept).collect()}
    assert st == {1: "ok", 2: "policy_restricted", 3: "empty"}


def test_zero_max_results_keeps_one_with_keywords(spark):
    df = cands(spark, [(1, "e0", 1, "a", "x", "u"), (1, "e0", 2, "b", "y", "u")])
    assert filters.exclusion_filter(df, 0, ["zzz"]).count() == 1
    assert filters.exclusion_filter(df, 0, []).count() == 0
    # without keywords it is a slice: a negative bound drops from the end
    assert filters.exclusion_filter(df, -1, []).count() == 1


def test_overfetch_bound():
    assert filters.fetch_count(3, ["k"]) == 10
    assert filters.fetch_count(12, ["k"]) == 12
    assert filters.fetch_count(3, []) == 3


def test_drop_counts(spark):
    a = cands(spark, [(1, "e", 1, "t", "s", "x.pdf"), (1, "e", 2, "t", "s", "u")])
    b = filters.pdf_filter(a)
    c = b.filter(F.lit(False))
    r = filters.drop_counts(a, b, c).first()
    assert (r["n_in"], r["n_pdf_dropped"], r["n_bm25_dropped"], r["n_out"]) == (2, 1, 1, 0)
