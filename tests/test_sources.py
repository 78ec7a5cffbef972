import json

from pyspark.sql import functions as F

from rankweave.operators import render
from rankweave.plans.search import web_search
from rankweave.sources import news


def test_news_items_parse(spark):
    payload = json.dumps({"items": [
        {"title": "<b>A&amp;B</b>", "originallink": "", "link": "http://l/1", "description": "d<br>x",
         "pubDate": "Mon, 01 Jan 2024 09:00:07 +0900"},
        {"title": "T2", "link": "http://l/2", "description": "", "pubDate": "Tue, 02 Jan 2024 00:00:00 GMT"},
        {"title": "T3", "originallink": "http://o/3", "link": "http://l/3", "description": "", "pubDate": "not a date"},
    ]})
    df = spark.createDataFrame([(1, payload), (2, json.dumps({"items": []}))], "query_id long, payload string")
    rows = news.news_items(df).orderBy("rank").collect()
    assert [(r["rank"], r["title"], r["url"], r["description"]) for r in rows] == [
        (1, "A&B", "http://l/1", "dx"), (2, "T2", "http://l/2", ""), (3, "T3", "http://o/3", "")]
    got = [r["d"] for r in news.news_items(df).orderBy("rank").select(
        F.date_format("pub_date", "yyyy-MM-dd HH:mm:ss").alias("d")).collect()]
    assert got == ["2024-01-01 00:00:07", "2024-01-02 00:00:00", None]


def test_mail_dates(spark):
    want = {"Mon, 01 Jan 2024 09:00:00 +0900": "2024-01-01 00:00:00", "Mon, 01 Jan 2024 09:00:00": "2024-01-01 09:00:00",
            "Monday, 01 January 2024 09:00:00 GMT": "2024-01-01 09:00:00", "01 Jan 24 09:00:00 -0500": "2024-01-01 14:00:00",
            "1 Jan 69 09:00 UTC": "1969-01-01 09:00:00", "Mon, 01 Jan 2024 09:00:00 +0900 (KST)": "2024-01-01 00:00:00",
            "Mon, 01 Jan 2024 09:00:00 EST": "2024-01-01 14:00:00", "Mon, 01 Jan 2024 9:05 XYZ": "2024-01-01 09:05:00",
            "Thu, 30 Feb 2024 09:00:00 GMT": None, "not a date": None, "": None, None: None}
    df = spark.createDataFrame([(d,) for d in want], "d string")
    got = df.select("d", F.date_format(news.parse_rfc2822(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("t")).collect()
    assert {r.d: r.t for r in got} == want


def test_hosted_defaults(spark):
    raw = spark.createDataFrame([(1, 1, None, None, "x" * 250)], "query_id long, rank long, title string, url string, content string")
    r = news.hosted_items(raw).first()
    assert (r["title"], r["url"], len(r["snippet"]), len(r["content"])) == ("", "", 200, 250)


def test_answer_json_shape(spark):
    req = spark.createDataFrame([(1, "stock price", "e0,nope")], "query_id long, query string, engines string")
    reg = spark.createDataFrame([("e0", 0, True, None)], "engine string, pos long, is_default boolean, shared_key_group string")
    src = spark.createDataFrame([(1, "e0", 1, "stock price", None, "stock price up")],
                                "query_id long, engine string, rank long, title string, url string, snippet string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    r = web_search(req, reg, src, pages)
    out = json.loads(render.answer_json(r.rows, r.sections, req, r.resolved).first()["answer_json"])
    assert out == {"query": "stock price", "engines": ["e0", "nope"],
                   "results": [{"engine": "e0", "title": "stock price", "url": None, "content": "stock price up"}]}


def test_mail_dates_equal_the_standard_library(spark):
    from datetime import timezone
    from email.utils import parsedate_to_datetime

    from pyspark.sql import functions as F

    texts = ["Mon, 01 Jan 2024 09:00:00 +0900", "1 Jan 2024 9:5:7 +0900", "01 Jan 2024 09:00:00 +09:00", "01 Jan 2024 09.00.00 +0900",
             "01 Jan 2024 09:00:00 +090", "Mon, Jan 01 2024 09:00:00 -0130", "Mon Jan  1 09:00:00 2024", "1 January 2024 09:00 EST",
             "01-Feb-99 23:59:59 PDT", "Janx 01 2024 09:00:00", "01 Janx 2024 09:00:00 +0000", "31 Feb 2024 10:00:00 +0000",
             "Thu, 29 Feb 2024 23:59:59 -0000 (comment)", "01 Jan 68 00:00 GMT", "01 Jan 69 00:00 UT", "not a date", "",
             "01 Jan 2024 25:00:00 +0000", "Fri, 05 Apr 2024 07:08:09"]

    def want(text):
        try:
            at = parsedate_to_datetime(text)
        except (ValueError, TypeError):
            return None
        return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp()

    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r[0]: r[1] for r in df.select("t", F.unix_timestamp(news.parse_rfc2822(F.col("t")))).collect()}
    assert got.pop(None) is None
    assert got == {t: want(t) for t in texts}
