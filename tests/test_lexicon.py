import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from rankweave.functions.text import tokenize
from rankweave.operators import bm25, lexicon, stored_index

NOUNS = ["학교", "도서관", "시장", "은행", "고양이", "자동차", "컴퓨터", "대통령", "신문사", "병원", "음악", "여행사"]
PARTICLES = ["에서", "에", "은", "을", "으로", "까지", "부터", "도"]


def texts():
    rnd = random.Random(4)
    forms = [n + p for n, p in itertools.product(NOUNS, PARTICLES + [""])]
    return [" ".join(rnd.choice(forms) for _ in range(12)) for _ in range(120)]


def table(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


@pytest.fixture(scope="module")
def learned(spark):
    return lexicon.learn(table(spark, texts()))


def test_stems_and_particles(learned):
    assert set(NOUNS) <= learned.stems and set(PARTICLES) <= learned.particles
    for n, p in itertools.product(NOUNS, PARTICLES):
        assert learned.stem(n + p) == n
    assert learned.stem("학교") == "학교" and learned.stem("낯선말을") == "낯선말을"


def test_inflected_forms_meet_in_scores(spark, learned, tmp_path):
    docs = table(spark, ["도서관에서 책을 읽다", "병원까지 걷다", "the library (English)"])
    q = spark.createDataFrame([(1, "도서관으로")], "query_id long, query string")
    plain = stored_index.build(docs, str(tmp_path / "a")).index()
    assert bm25.score(plain, bm25.query_terms(q)).collect() == []
    lex = lexicon.lexer(learned, spark)
    index = stored_index.build(docs, str(tmp_path / "b"), lexer=lex).index()
    assert [r["doc_id"] for r in bm25.score(index, bm25.query_terms(q, lexer=lex)).collect()] == [0]
    got = docs.select(tokenize(F.col("text"), lexer=lex).alias("t")).collect()
    assert got[0]["t"][:2] == ["도서관", "책을"] and got[2]["t"] == ["the", "library", "english"]


def test_statistics_equal_brute_force(spark):
    rnd = random.Random(6)
    rows = [" ".join("".join(rnd.choice("가나다라") for _ in range(rnd.randint(1, 5))) for _ in range(6)) for _ in range(60)]
    forms = {}
    for w in " ".join(rows).split():
        if len(w) >= 2:
            forms[w] = forms.get(w, 0) + 1
    follow = {}
    for w, n in forms.items():
        for k in range(1, len(w) + 1):
            nxt = follow.setdefault(w[:k], {})
            nxt[w[k:k + 1]] = nxt.get(w[k:k + 1], 0) + n
    got = {r["prefix"]: r for r in lexicon.prefix_statistics(lexicon.word_forms(table(spark, rows), "text")).collect()}
    assert set(got) == set(follow)
    for p, nxt in follow.items():
        n = sum(nxt.values())
        assert got[p]["n"] == n
        assert got[p]["entropy"] == pytest.approx(-sum(m / n * math.log(m / n) for m in nxt.values()), abs=1e-9)
        first = sum(follow[p[0]].values())
        assert got[p]["cohesion"] == pytest.approx(1.0 if len(p) == 1 else (n / first) ** (1 / (len(p) - 1)), abs=1e-12)


def test_nothing_to_learn(spark):
    empty = lexicon.learn(table(spark, ["only english words", ""]))
    assert not empty.stems and not empty.particles and empty.stem("학교에서") == "학교에서"
    null = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert lexicon.learn(null) == empty
