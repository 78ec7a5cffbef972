import numpy as np
from pyspark.sql import functions as F

from rankweave.llm import langid as L
from rankweave.llm import queries as Q

SF001 = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    got = Q.QUERIES["op1_langid"](spark, SF001)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "lang")
    joined = got.join(docs, "doc_id")
    assert got.count() == docs.count()
    right = joined.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95
    bad = joined.where("score is null or score < 0 or score > 1 or lang_pred is null").count()
    assert bad == 0


def rows(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, lang string, lang_pred int, score string")


def test_edge_texts(spark):
    train = [("the cat and the dog of the house", "en"), ("der hund und die katze im haus", "de"),
             ("el perro y la casa de los gatos", "es"), ("le chien et la maison des chats", "fr")] * 10
    model = L.fit_rows(train)
    long = "der hund und die katze " * 200_000
    df = rows(spark, [(1, None, "en", 1, "x"), (2, "", None, 1, "x"), (3, "123 *** ", "fr", 1, None), (4, long, "en", 2, "y"),
                      (None, "THE cat and THE dog", None, None, None), (5, "el perro y la casa", "fr", 0, ""),
                      (5, "el perro y la casa", "fr", 0, "")])
    got = sorted(((r.row.doc_id or 0, r.lang_pred, r.score > 0) for r in L.identify(df, model).collect()))
    assert got == [(0, "en", True), (1, "und", False), (2, "und", False), (3, "und", False), (4, "de", True),
                   (5, "es", True), (5, "es", True)]
    kept = L.keep_identified(df, model)
    assert kept.columns == df.columns and kept.count() == 4


def test_families_come_first():
    model = L.fit_rows([("aaa bbb", "en"), ("ccc ddd", "de"), ("eee fff", "fr"), ("ggg hhh", "es"), ("iii jjj", "xx")] * 8)
    assert model.families == ["germanic", "only:xx", "romance"]
    assert model.pairs == [("de", "en"), ("es", "fr")]
    assert [L.predict_bytes(t, model)[0] for t in (b"aaa bbb", b"ccc ddd", b"eee", b"ggg hhh", b"iii")] == \
        ["en", "de", "fr", "es", "xx"]


def test_pieces_of_a_long_text_add_up(monkeypatch):
    model = L.fit_rows([("aaa bbb", "en"), ("ccc ddd", "de")] * 5)
    whole = L.predict_bytes(b"aaa bbb ccc " * 50, model)
    monkeypatch.setattr(L, "CHUNK_BYTES", 64)
    parts = L.predict_bytes(b"aaa bbb ccc " * 50, model)
    assert whole[0] == parts[0] and abs(whole[1] - parts[1]) < 1e-9
    for size in (1, 2, 3, 5, 7, 64):
        monkeypatch.setattr(L, "CHUNK_BYTES", size)
        for text in (b"", b"a", b"  a  b ", b"12 ab\n\n cd", b"abcdefgh", b" x" * 40):
            monkeypatch.setattr(L, "CHUNK_BYTES", 1 << 17)
            want = sorted(L._grams(text).tolist())
            monkeypatch.setattr(L, "CHUNK_BYTES", size)
            assert sorted(L._grams(text).tolist()) == want


def test_nothing_to_learn(spark):
    df = rows(spark, [(1, "some text", None, None, None)])
    model = L.fit_corpus(df)
    assert [tuple(r)[1:3] for r in L.identify(df, model).collect()] == [("und", 0.0)]
    one = L.fit_rows([("some text", "en")])
    assert [tuple(r)[1:3] for r in L.identify(df, one).collect()] == [("en", 1.0)]
    assert L.identify(rows(spark, []), one).count() == 0


def test_language_stage_drops_what_no_machine_knows(spark):
    import corpus_pipeline

    rng = np.random.default_rng(3)
    words = {"en": "the of and to in that is was for with his they have this from".split(),
             "de": "der die und das nicht ist ein ich sich mit auf für werden auch es".split(),
             "fr": "le de un être et à il avoir ne je son que se qui ce dans".split(),
             "es": "de la que el en y a los se del las un por con no una".split()}
    texts = [(i, " ".join(rng.choice(words[x], int(rng.integers(5, 400)))), x) for i in range(300) for x in [sorted(words)[i % 4]]]
    odd = [(1000, "Съешь ещё этих мягких французских булок, да выпей чаю. " * 60, None), (1001, "12 + 34 = 46", "en"),
           (1002, None, None), (1003, "the house", None), (1004, "la casa", "es"), (1005, "и", None)]
    df = spark.createDataFrame([(*r, "f", 1) for r in texts + odd], "doc_id long, text string, lang string, known string, p int")
    kept = corpus_pipeline.identify_language(spark, df, "")
    assert kept.columns == df.columns
    got = {r.doc_id for r in kept.collect()}
    # the long foreign text and the letterless ones go; the short clean ones, and one letter, stay
    assert got == {r[0] for r in texts} | {1003, 1004, 1005}
    model = L.fit_corpus(df, calibrated=True)
    english = {r.doc_id for r in L.keep_identified(df, model, wanted=["en"]).collect()}
    assert english >= {r[0] for r in texts if r[2] == "en" and r[0] % 4 == 1} and not english & {r[0] for r in texts if r[2] == "es"}


def test_equal_votes_go_to_the_first_name():
    model = L.Model(["de", "en", "nl"], ["germanic"], [("de", "en"), ("de", "nl"), ("en", "nl")],
                    np.zeros((1 << L.HASH_BITS, 3), np.float32), np.ones(3))
    assert L.predict_bytes(b"abc", model) == ("de", 0.5, True)


def dense(text, model):
    """The decision written out again over counts of n-grams in a dictionary."""
    counts = {}
    for code in L._grams(text).tolist():
        counts[code] = counts.get(code, 0) + 1
    n = sum(counts.values())
    prob = [1 / (1 + np.exp(-model.slopes[c] * sum(k * float(model.weights[g, c]) for g, k in counts.items()) / n ** 0.5))
            for c in range(model.weights.shape[1])]
    f = max(range(len(model.families)), key=lambda c: prob[c])
    votes = {x: 0 for x in model.languages if L.family_of(x) == model.families[f]}
    for (a, b), p in zip(model.pairs, prob[len(model.families):]):
        if a in votes:
            votes[a if p >= 0.5 else b] += 1
    return min(votes, key=lambda x: (-votes[x], x))


def test_decisions_equal_an_independent_scorer():
    rows = [("the cat and the dog of the house", "en"), ("der hund und die katze im haus", "de"),
            ("el perro y la casa de los gatos", "es"), ("le chien et la maison des chats", "fr")]
    model = L.fit_rows(rows * 10)
    for text in [t for t, _ in rows] + ["katze", "the", "la", "zzz", "dog und chien"]:
        assert L.predict_bytes(text.encode(), model)[0] == dense(text.encode(), model)


def test_every_row_is_learned_from(spark, monkeypatch):
    # two rows of thousands hold what tells the languages apart
    plain = [(i, "same words here", "en" if i % 2 else "de", None, None) for i in range(3000)]
    df = rows(spark, [*plain, (3001, "zyxwvu qponml " * 40, "en", None, None), (3003, "kjihgf edcba " * 40, "de", None, None)])
    for size in (1 << 22, 1 << 14):  # one group, several groups
        monkeypatch.setattr(L, "GROUP_BYTES", size)
        model = L.fit(df, id_col="doc_id")
        assert [L.predict_bytes(t, model)[0] for t in (b"zyxwvu qponml", b"kjihgf edcba")] == ["en", "de"]


def test_a_vector_holds_the_whole_of_a_long_text(monkeypatch):
    text = b"some words and others " * 900
    index, value, ratio = L._vector(text)
    monkeypatch.setattr(L, "CHUNK_BYTES", 1000)
    parts = L._vector(text)
    assert (index == parts[0]).all() and np.allclose(value, parts[1]) and abs(ratio - parts[2]) < 1e-9


def test_the_floor_comes_from_every_row(spark):
    train = [("the cat and the dog of the house", "en"), ("le chien et la maison des chats", "fr")] * 10
    model = L.fit_rows(train)
    data = [(i, "the cat and the dog of the house", "en", None, None) for i in range(900)]
    high = L.calibrate(model, rows(spark, data))
    low = L.calibrate(model, rows(spark, [*data, (901, "the cat le chien et dog maison", "en", None, None)]))
    assert np.isfinite(high.floor) and low.floor < high.floor
