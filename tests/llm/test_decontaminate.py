import random

import numpy as np

from rankweave.llm import decontaminate as D

DOCS = "doc_id long, text string, item_id int, hash string, tokens int"
ITEMS = "item_id long, text string, size string"

QUESTION = "Yesterday Tom bought 5 apples for 3 dollars each while his friend Tom carried 5 kg of flour to the old market"


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    got = sorted(((r.doc_id, r.item_id, r.verbatim) for r in D.contamination(d, b).collect()), key=str)
    return got, [r.doc_id for r in D.drop_contaminated(d, b).collect()]


def test_verbatim_and_changed_slots(spark):
    other = QUESTION.replace("Tom", "Ann").replace("5", "72").replace("3 dollars", "1,250 euros").replace(" kg", " pounds")
    crossed = QUESTION.replace("Tom bought", "Ann bought")  # Tom is Ann here and Tom there
    filler = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    docs = [(1, QUESTION), (2, f"{filler}. {other} {filler}"), (3, crossed), (4, filler), (5, None), (6, ""), (7, "5 5 5 5 5 5 5 5 5"),
            (8, QUESTION), (8, QUESTION), (None, f"*** {QUESTION}!!"), (9, (filler + " ") * 2000 + QUESTION)]
    got, kept = run(spark, docs, [(10, QUESTION), (11, None), (12, ""), (13, "5 6 7 8 9 1 2 3"), (None, "one two")])
    assert got == sorted([(1, 10, True), (2, 10, False), (3, 10, False), (8, 10, True), (9, 10, True), (None, 10, True)], key=str)
    assert sorted(kept) == [4, 5, 6, 7]


def test_short_item_and_repeated_items(spark):
    got, kept = run(spark, [(1, "so the red fox jumps high today"), (2, "the red cat jumps high")],
                    [(1, "the red fox jumps high"), (1, "the red fox jumps high"), (2, "the red fox jumps high")])
    assert got == [(1, 1, True), (1, 2, True)] and kept == [2]


def test_empty_tables(spark):
    assert run(spark, [], [(1, QUESTION)]) == ([], [])
    assert run(spark, [(1, QUESTION)], []) == ([], [1])


def test_pieces_and_map_agree_with_whole_text(monkeypatch):
    rng = random.Random(2)
    vocab = ["alpha", "beta", "Paris", "12", "kg", "gamma", "Rome", "7.5", "delta"]
    text = " ".join(rng.choices(vocab, k=400))
    whole = D.windows(text, [5, 8], None, D._Codes())
    monkeypatch.setattr(D, "CHUNK_CHARS", 60)
    parts = D.windows(text, [5, 8], None, D._Codes())
    key = lambda w: (w["pos"], len(w["kinds"]))
    assert {key(w) for w in whole} == {key(w) for w in parts} and len(parts) == len(whole)
    order = lambda w: (w["pos"], len(w["kinds"]), w["kinds"], w["hash"])
    assert sorted(whole, key=order) == sorted(parts, key=order)
    h = np.array([w["hash"] for w in whole]).view(np.uint64)
    bits = np.zeros((1 << 20) // 8, np.uint8)
    for place in np.concatenate(D._places(h, 20)).tolist():
        bits[place >> 3] |= 1 << (place & 7)
    assert D._passes(h, bits).all()


def test_bit_map_equals_plain_one(spark):
    rnd = random.Random(4)
    for n, size in ((500, 20), (50_000, 21)):
        hashes = [rnd.getrandbits(64) - 2**63 for _ in range(n)]
        df = spark.createDataFrame([(h,) for h in hashes], "hash long")
        want = np.zeros((1 << size) // 8, np.uint8)
        for place in np.concatenate(D._places(np.array(hashes).view(np.uint64), size)).tolist():
            want[place >> 3] |= 1 << (place & 7)
        assert np.array_equal(D._bit_map(df), want)


def test_every_item_in_any_case(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    own = [(r.item_id, r.text) for r in table.select("item_id", "text").collect()]
    own += [(1000, QUESTION), (1001, "Die große Straße in Köln Süd führt Anna Weiß zum Markt"), (1002, "Five men and Tom met five men")]
    items = [(i, t) for i, t in own if len(D.TOKEN.findall(t)) >= D.MIN_LITERAL]
    cases = [str, str.upper, str.lower, str.title]
    docs = [(k * 10_000 + i, f"some words before. {case(t)} and some behind") for k, case in enumerate(cases) for i, t in items]
    got, _ = run(spark, docs, items)
    found = {(d, i) for d, i, verbatim in got if verbatim}
    assert len(items) > 20 and [(d, d % 10_000) for d, _ in docs if (d, d % 10_000) not in found] == []


def test_case_blind_form_keeps_slots_and_adds_no_single_name(spark):
    other = QUESTION.replace("5", "72").replace(" 3 ", " 8 ").upper()
    got, kept = run(spark, [(1, other), (2, "I saw Paris and PARIS again")], [(10, QUESTION), (11, "Paris"), (12, "Tom Smith")])
    assert got == [(1, 10, False)] and kept == [2]


def edited(text):
    """The text with one occurrence of a repeated slot value changed, or None."""
    seen = {}
    for m in D.TOKEN.finditer(text):
        word = m.group()
        if word[0].isdigit() or (word[0].isupper() and word[1:].islower()):
            seen.setdefault(word, []).append(m)
    for word, places in seen.items():
        if len(places) > 1:
            last = places[-1]
            return text[:last.start()] + ("77" if word[0].isdigit() else "Zorro") + text[last.end():]
    return None


def test_one_edited_occurrence_of_a_repeated_value_loses_no_item(spark):
    for sf in ("sf0.01", "sf0.1"):
        table = spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet")
        items = [(r.item_id, r.text) for r in table.select("item_id", "text").collect()]
        docs = [(i, e) for i, t in items for e in [edited(t)] if e and len(D.TOKEN.findall(t)) >= 2 * D.WINDOW]
        got, _ = run(spark, docs, items)
        assert docs and {(i, i) for i, _ in docs} <= {(d, i) for d, i, _ in got}


def brute_kept(sides):
    """Majority partners both ways, by counting; sides: (at, kind, doc value, item value)."""
    slots = [s for s in sides if s[1] != "w"]
    n = {}
    for _, k, d, i in slots:
        n[k, d, i] = n.get((k, d, i), 0) + 1
    best_i = {(k, d): max((c, dd == i, i) for (kk, dd, i), c in n.items() if (kk, dd) == (k, d))[2] for _, k, d, _ in slots}
    best_d = {(k, i): max((c, d == ii, d) for (kk, d, ii), c in n.items() if (kk, ii) == (k, i))[2] for _, k, _, i in slots}
    return {at for at, k, d, i in sides if k == "w" or (best_i[k, d] == i and best_d[k, i] == d)}


def test_consistent_part_equals_brute_force(spark):
    rnd = random.Random(8)
    rows, want = [], {}
    for a in range(60):
        sides = [(at, k, rnd.choice("ABC"), rnd.choice("ABC")) for at in range(rnd.randint(1, 12)) for k in [rnd.choice("wNM")]]
        rows += [(a, 1, 1, 10, 0, False, *s) for s in sides]
        want[a] = brute_kept(sides)
    df = spark.createDataFrame(rows, "id long, text_hash long, item long, size long, shift long, template boolean, at long, k string, d string, i string")
    got = {a: set() for a in want}
    for r in D._consistent(df).where("kept").collect():
        got[r.id].add(r.at)
    assert got == want
