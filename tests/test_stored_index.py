import random

import pytest
from pyspark.sql import functions as F
from test_bm25 import py_bm25

from rankweave.functions.text import lexical_tokens
from rankweave.operators import bm25, stored_index
from rankweave.session import store_bucketed


def corpus(rnd, n, words=40):
    """Texts over a Zipf vocabulary; some empty, some repeated."""
    texts = []
    for i in range(n):
        size = rnd.choice([0, 1, 3, 8, 20, 60])
        texts.append(" ".join(f"w{min(int(rnd.paretovariate(0.7)), words)}" for _ in range(size)))
    texts[-1] = texts[0]
    return texts


def table(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def questions(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "query_id long, query string")


def expected(texts, query, k, ids=None):
    scores = py_bm25([t.split() for t in texts], query.split())
    ids = ids or list(range(len(texts)))
    ranked = sorted(range(len(texts)), key=lambda i: (-round(scores[i], 9), ids[i]))[:k]
    return [(ids[i], pytest.approx(scores[i], abs=1e-8)) for i in ranked]


def found(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rnd = random.Random(3)
    texts = corpus(rnd, 400)
    path = str(tmp_path_factory.mktemp("index") / "one")
    return texts, stored_index.build(table(spark, texts), path, buckets=4), path


QUERIES = ["w1 w2 w30", "w40 w39 w38 w1", "w1", "w5 w5 w5 w6", "", "nothing at all", "w1 w2 w3 w4 w5 w6 w7 w8 w20 w33"]


def test_scores_and_top_k_equal_the_formula(spark, made):
    texts, index, _ = made
    q = questions(spark, QUERIES)
    qt = bm25.query_terms(q)
    want = {i: expected(texts, text, 7) for i, text in enumerate(QUERIES)}
    assert found(bm25.top_k(index.index(), qt, q, 7)) == want
    assert found(stored_index.top_k_pruned(index.index(), qt, q, 7).rows) == want


def test_pruned_with_ties_and_negative_weights(spark, tmp_path):
    # "a" and "b" are held by nearly all, so their weights are negative where the mean is
    texts = [f"a b {'c' if i % 50 == 0 else ''} {'d' if i % 90 == 0 else ''}" for i in range(200)] + ["c c", "d", "", "c d"]
    index = stored_index.build(table(spark, texts), str(tmp_path / "i"), buckets=2).index()
    rows = ["c d", "a c", "a b", "d", "c c a"]
    q = questions(spark, rows)
    got = found(stored_index.top_k_pruned(index, bm25.query_terms(q), q, 5).rows)
    assert got == {i: expected(texts, text, 5) for i, text in enumerate(rows)}


def test_random_corpora(spark, tmp_path):
    rnd = random.Random(11)
    for n in range(3):
        texts = corpus(rnd, rnd.choice([5, 30, 150]), rnd.choice([3, 12]))
        rows = [" ".join(f"w{rnd.randint(1, 14)}" for _ in range(rnd.randint(1, 9))) for _ in range(5)]
        q = questions(spark, rows)
        index = stored_index.build(table(spark, texts), str(tmp_path / f"i{n}"), buckets=2).index()
        got = found(stored_index.top_k_pruned(index, bm25.query_terms(q), q, 4).rows)
        assert got == {i: expected(texts, text, 4) for i, text in enumerate(rows)}


def test_common_terms_are_scored_for_open_documents_only(spark, tmp_path):
    # every document holds the common words, ten hold the rare ones as well
    texts = [" ".join(["the", "of", "and"] * 3 + [f"x{i % 50}"] + (["needle", "thread"] if i % 100 == 7 else [])
                      + ["pad"] * (i % 5)) for i in range(1000)]
    index = stored_index.build(table(spark, texts), str(tmp_path / "i"), buckets=4).index()
    rows = ["needle thread of pad"]
    q = questions(spark, rows)
    pruned = stored_index.top_k_pruned(index, bm25.query_terms(q), q, 3)
    assert found(pruned.rows) == {0: expected(texts, rows[0], 3)}
    read = stored_index.postings_scored(index, pruned).first()
    assert read["n_all"] > 1800 and read["n_scored"] < 100


def test_no_exchange_on_query_and_document(spark, made):
    _, index, _ = made
    q = questions(spark, QUERIES)
    scored = bm25.score(index.index(), bm25.query_terms(q))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "")
    assert "Bucketed: true" in plan and "BroadcastHashJoin" in plan
    exchanges = [x for x in bm25.best_of(scored, 3, "query_id", "doc_id")._jdf.queryExecution().executedPlan().toString().split("\n")
                 if "Exchange hashpartitioning" in x]
    assert len(exchanges) == 1 and "query_id" in exchanges[0] and "doc_id" not in exchanges[0]


def test_another_session_opens_it(spark, made):
    texts, _, path = made
    other = spark.newSession()
    q = questions(other, ["w1 w2 w30"])
    index = stored_index.open_index(other, path).index()
    assert found(bm25.top_k(index, bm25.query_terms(q), q, 5)) == {0: expected(texts, "w1 w2 w30", 5)}


def tables_of(index):
    i = index.index()
    return ({(r["doc_id"], r["term"]): (r["tf"], r["dl"]) for r in i.postings.collect()},
            {r["doc_id"]: r["dl"] for r in i.docs.collect()},
            {r["term"]: (r["df"], round(r["idf"], 9)) for r in i.terms.collect()},
            tuple(round(x, 9) for x in i.stats.first()))


def test_append_and_delete_equal_a_rebuild(spark, tmp_path):
    rnd = random.Random(5)
    texts = corpus(rnd, 90)
    index = stored_index.build(table(spark, texts[:40]), str(tmp_path / "a"), buckets=2)
    index = index.append(table(spark, texts[40:70], 40))
    ids = lambda xs: spark.createDataFrame([(x,) for x in xs], "doc_id long")
    index = index.delete(ids([1, 2, 3, 44, 5000])).append(table(spark, texts[70:], 70))
    # a removed id comes back with another text, and goes and comes once more
    index = index.append(spark.createDataFrame([(2, "w1 again")], "doc_id long, text string"))
    index = index.delete(ids([2, 80])).append(spark.createDataFrame([(2, "w2 last last")], "doc_id long, text string"))
    now = {i: t for i, t in enumerate(texts) if i not in (1, 3, 44, 80)} | {2: "w2 last last"}
    rebuilt = stored_index.build(spark.createDataFrame(sorted(now.items()), "doc_id long, text string"), str(tmp_path / "b"), buckets=2)
    assert tables_of(index) == tables_of(rebuilt)
    compacted = index.compact(str(tmp_path / "c"))
    assert tables_of(compacted) == tables_of(rebuilt)
    assert len(compacted.manifest["segments"]) == 1 and not compacted.manifest["dead"]
    q = questions(spark, QUERIES)
    order = sorted(now)
    want = {i: expected([now[d] for d in order], text, 6, order) for i, text in enumerate(QUERIES)}
    for i in (index, compacted):
        assert found(stored_index.top_k_pruned(i.index(), bm25.query_terms(q), q, 6).rows) == want


def test_what_a_failed_append_left_is_not_read(spark, tmp_path):
    index = stored_index.build(table(spark, ["a b", "c"]), str(tmp_path / "a"), buckets=2)
    before = tables_of(index)
    half = stored_index.StoredIndex(spark, index.path, index.table, index.manifest)
    half._commit = lambda *a: (_ for _ in ()).throw(RuntimeError("killed"))
    with pytest.raises(RuntimeError):
        half.append(table(spark, ["lost words"], 10))
    again = stored_index.open_index(spark, index.path)
    assert tables_of(again) == before
    grown = again.append(table(spark, ["found words"], 11))
    assert set(tables_of(grown)[1]) == {0, 1, 11}


def test_index_of_no_documents_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        stored_index.build(table(spark, []), str(tmp_path / "a"))


def test_a_lexer_of_ones_own(spark, tmp_path):
    index = stored_index.build(table(spark, ["Walking home", "walked"]), str(tmp_path / "a"),
                               lexer=lambda c: F.transform(lexical_tokens(c), lambda t: F.substring(t, 1, 4))).index()
    assert {r["term"] for r in index.terms.collect()} == {"walk", "home"}


def test_buckets_grow_in_number_with_the_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_index, "BUCKET_BYTES", 100)
    texts = [(i, " ".join(f"w{(i * k) % 9}" for k in range(1, 12))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    made = stored_index.build(docs.where("doc_id < 30"), str(tmp_path / "i"))
    size = sum(len(t) for i, t in texts if i < 30)
    assert made.manifest["buckets"] == -(-size // 100) > spark.sparkContext.defaultParallelism
    # a segment larger than the first build is written by more tasks than there are buckets, into the same buckets
    small = stored_index.build(docs.where("doc_id < 30"), str(tmp_path / "s"), buckets=2).append(docs.where("doc_id >= 30"))
    assert small.manifest["buckets"] == 2
    whole = stored_index.build(docs, str(tmp_path / "w"))
    rows = lambda x: sorted(map(tuple, x.postings().collect()))
    assert rows(small) == rows(whole) == rows(made.append(docs.where("doc_id >= 30")))
    assert rows(small.compact(str(tmp_path / "c"))) == rows(whole)


def test_documents_stored_in_the_buckets_of_an_index_meet_it_without_an_exchange(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a{i % 3} b{i % 5}") for i in range(40)], "doc_id long, text string")
    index = stored_index.build(docs, str(tmp_path / "i"), buckets=3).index()
    held = store_bucketed(docs.where("doc_id < 13").select("doc_id", F.array(F.lit(1)).alias("asked")), "held", "doc_id", index.buckets)
    joined = index.postings.hint("merge").join(held.hint("merge"), "doc_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 26
