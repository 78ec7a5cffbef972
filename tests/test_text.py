from pyspark.sql import functions as F

from rankweave.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first()["o"]


def test_url_tokens(spark):
    assert one(spark, T.url_tokens, "https://www.samsung.com/sec/") == ["samsung", "sec"]
    assert one(spark, T.url_tokens, "https://www.samsung.com/sec/ai-subs/") == ["samsung", "sec", "ai", "subs"]
    assert one(spark, T.url_tokens, "http://x.kr/2024/index.php") == ["index"]


def test_url_stops_before_attached_korean(spark):
    urls = one(spark, T.extract_urls, "https://a.example.com/unpacked에서 확인")
    assert urls == ["https://a.example.com/unpacked"]
    toks = one(spark, T.tokenize, "https://a.example.com/unpacked에서 확인")
    assert toks == ["에서", "확인", "example", "unpacked"]


def test_case_folded_match_of_url_and_word(spark):
    toks = one(spark, T.tokenize, "Samsung news https://www.samsung.com/sec/")
    assert toks.count("samsung") == 2


def test_tag_strip_forms(spark):
    assert one(spark, T.strip_tags, "<b>A&amp;B</b>") == "A&B"
    assert one(spark, T.strip_tags, "x<br>y") == "xy"
    assert one(spark, T.strip_tags_spaced, "x<br>y") == "x y"
    assert one(spark, lambda c: T.strip_tags(c, lazy=True), "a<b\nc>d") == "a<b\nc>d"
    assert one(spark, T.strip_tags, "a<b\nc>d") == "ad"
    # single decoding pass: &amp;lt; -> &lt;
    assert one(spark, T.decode_entities, "&amp;lt;") == "&lt;"


def test_references_equal_the_standard_decoder(spark):
    import html
    texts = ["a &amp; b", "caf&eacute; &euro;&#233;&#x1F600;&AMP;&trade;&amp", "&ampfoo &notit; &notin; &copycat &lt&gt;&quot",
             "&#0;&#128;&#x80;&#xD800;&#x110000;&#99999999999999;&#xFFFE;&#1;&#13;", "&unknown; & && &; &#; &#x; x&", "&nbsp;|&NotEqualTilde;",
             "&amp;lt;", "&#65&#x42;C", "&" + "a" * 50 + ";", "&frac12x", "", "none", "ing&&& erhe*** of%%% &&&\nx"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.decode_entities("t").alias("d"))
    assert {r.i: r.d for r in df.collect()} == {i: html.unescape(t) for i, t in enumerate(texts)}
    assert one(spark, lambda c: T.tokenize(c), "Caf&eacute; <b>x</b>") == ["café", "x"]


def test_lexer_hook(spark):
    import pandas as pd

    @F.pandas_udf("array<string>")
    def halves(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [w[i:i + 2] for w in t.split() for i in range(0, len(w), 2)])

    got = one(spark, lambda c: T.tokenize(c, lexer=halves), "<b>abcd</b> ef http://news.site.org/topic")
    assert got == ["ab", "cd", "ef", "news", "site", "topic"]


def test_clean_text(spark):
    text = ("Body one\nCopyright ⓒ " + "x" * 150 + "\nnext line\n\n\n  댓글  \n"
            "무단 전재 및 재배포 금지\nAI 학습 및 이용 금지\n  last  ")
    out = one(spark, T.clean_text, text)
    # the notice takes the 100 characters after the mark (one space + 99 x), not the next line
    assert out == "Body one " + "x" * 51 + " next line last"


def test_truncate_counts_code_points(spark):
    assert one(spark, lambda c: T.truncate_text(c, 3), "한국어텍스트") == "한국어"


def test_first_keyword_in_list_order(spark):
    out = spark.createDataFrame([("a b",)], "t string").select(
        T.first_matching_keyword(F.col("t"), ["b", "a"]).alias("k")).first()["k"]
    assert out == "b"
