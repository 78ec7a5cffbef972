from pyspark.sql import functions as F

from rankweave.operators import render, routing
from rankweave.plans.search import web_search

REG = [("e0", 0, True, None), ("e1", 1, True, "g"), ("e2", 2, False, "g")]


def setup(spark, engines, rows):
    req = spark.createDataFrame([(1, "stock price", engines)], "query_id long, query string, engines string")
    reg = spark.createDataFrame(REG, "engine string, pos long, is_default boolean, shared_key_group string")
    src = spark.createDataFrame(rows, "query_id long, engine string, rank long, title string, url string, snippet string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    return req, reg, src, pages


def run(spark, engines, rows, **kw):
    req, reg, src, pages = setup(spark, engines, rows)
    r = web_search(req, reg, src, pages, max_results=3, **kw)
    secs = [(s["engine"], s["status"]) for s in r.sections.orderBy("sec_pos").collect()]
    return r, secs, req


def test_resolve(spark):
    req = spark.createDataFrame([(1, "q", "all"), (2, "q", " e1 , ,e1,x"), (3, "q", "")],
                                "query_id long, query string, engines string")
    reg = spark.createDataFrame(REG, "engine string, pos long, is_default boolean, shared_key_group string")
    got = sorted((r["query_id"], r["req_pos"], r["engine"], r["registered"])
                 for r in routing.resolve_sources(req, reg).collect())
    assert got == [(1, 0, "e0", True), (1, 1, "e1", True), (2, 0, "e1", True), (2, 1, "x", False)]


def test_no_fallback_when_one_source_has_rows(spark):
    rows = [(1, "e0", 1, "stock price", "http://a", "stock price up")]
    _, secs, _ = run(spark, "e0,nope", rows)
    assert secs == [("e0", "ok"), ("nope", "unknown")]


def test_fallback_runs_every_untried_source(spark):
    rows = [(1, "e2", 1, "stock price", "http://a", "stock price up")]
    r, secs, _ = run(spark, "e0", rows)
    assert secs == [("e0", "ok"), ("e1", "ok"), ("e2", "ok")]
    assert [x["engine"] for x in r.rows.collect()] == ["e2"]


def test_all_pdf_answer_stays_empty(spark):
    rows = [(1, "e0", 1, "stock price", "http://a.pdf", "stock price up")]
    r, secs, req = run(spark, "e0", rows)
    assert secs == [("e0", "ok")]
    assert r.rows.count() == 0
    text = render.answer_text(r.rows, r.sections, req).first()["answer"]
    assert text == "[e0]\n" + routing.MSG_NO_RESULTS


def test_policy_skip_then_fallback(spark):
    rows = [(1, "e0", 1, "stock whst", "http://a", "x"), (1, "e1", 1, "stock price", "http://b", "stock price")]
    r, secs, _ = run(spark, "e0", rows, keywords=["whst"])
    assert secs == [("e0", "skip"), ("e1", "ok"), ("e2", "ok")]


def test_outcome_summary(spark):
    rows = [(1, "e0", 1, "stock price", "http://a", "stock price up")]
    r, _, req = run(spark, "e0,nope", rows)
    assert routing.outcome_summary(r.sections, req).first()["summary"] == "e0=ok(1건), nope=unknown"
    none = r.sections.filter("false")
    assert routing.outcome_summary(none, req).first()["summary"] == "없음"


def test_reported_outcomes(spark):
    rows = [(1, e, 1, "stock price", f"http://{e}", "stock price up") for e in ("e0", "e1", "e2")]
    said = spark.createDataFrame([(1, "e0", "error", "boom"), (1, "e1", "timeout", "8"), (1, "nope", "error", "x")],
                                 "query_id long, engine string, outcome string, detail string")
    r, secs, req = run(spark, "e0,e1,nope", rows, outcomes=said)
    # nobody answered, so the source not yet tried is asked
    assert secs == [("e0", "error"), ("e1", "timeout"), ("nope", "unknown"), ("e2", "ok")]
    assert [x["engine"] for x in r.rows.collect()] == ["e2"]
    text = render.answer_text(r.rows, r.sections, req).first()["answer"]
    assert text.startswith("[e0]\n검색 중 오류가 발생했습니다: boom\n\n[e1]\n8초 내에 응답이 없어 건너뛰었습니다.\n\n[nope]\n")
    limit = spark.createDataFrame([(1, "e0", "quota_exceeded", "all keys near their limit"), (1, "e1", "unavailable", "no key")],
                                  "query_id long, engine string, outcome string, detail string")
    r, secs, req = run(spark, "e0,e1,e2", rows, outcomes=limit)
    assert secs == [("e0", "skip"), ("e1", "skip"), ("e2", "ok")]
    assert "[e0]\nall keys near their limit" in render.answer_text(r.rows, r.sections, req).first()["answer"]


def test_unknown_only_request_falls_back_to_all(spark):
    rows = [(1, "e1", 1, "stock price", "http://b", "stock price")]
    r, secs, _ = run(spark, "nope", rows)
    assert secs == [("nope", "unknown"), ("e0", "ok"), ("e1", "ok"), ("e2", "ok")]
    assert [x["engine"] for x in r.rows.collect()] == ["e1"]


def test_blank_request_resolves_to_nothing_then_falls_back(spark):
    rows = [(1, "e0", 1, "stock price", "http://a", "stock price up")]
    _, secs, _ = run(spark, " , ", rows)
    assert secs == [("e0", "ok"), ("e1", "ok"), ("e2", "ok")]
