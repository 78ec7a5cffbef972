import random
import re

import numpy as np
import xxhash

from rankweave.llm import simhash as S
from rankweave.llm.common import materialize

SCHEMA = "doc_id long, text string, fp int, root string"


def brute(text):
    if text is None:
        return 0
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [brute(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, format(fps[i], "016x"), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    vocab = ["w%d" % i for i in range(400)] + ["Éa", "ÀB", "x y"]
    rows = []
    for i in range(60):
        words = rng.choices(vocab, k=rng.choice([1, 2, 3, 30, 150]))
        rows.append((i, "\t".join(words)))
        for c in range(rng.choice([0, 0, 1, 4])):
            copy = list(words)
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((100 + 10 * i + c, " ".join(copy)))
    long = " ".join(rng.choices(vocab, k=200_000))
    rows += [(900, None), (901, ""), (902, " \n"), (903, long), (904, long.upper()), (None, "one two"), (None, None),
             (905, "one  two"), (905, "one  two")]
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA)
    got = [tuple(r) for r in S.simhash_components(df).collect()]
    assert sorted(got, key=str) == brute_components(rows)


def test_drop_keeps_one_of_each_component(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA)
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = {(c, f) for _, f, c in brute_components(rows)}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted({c for c, _ in want})


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.simhash_components(df).count() == 0
    assert S.drop_near_duplicates(df).count() == 0


def test_chunks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(random.Random(1).choices(["aa", "b", "cc c"], k=500)).encode()
    whole = S.fingerprint_bytes(text)
    monkeypatch.setattr(S, "CHUNK_BYTES", 17)
    assert S.fingerprint_bytes(text) == whole == brute(text.decode())


def test_keys_cover_three_bits_and_hot_keys_agree(spark, monkeypatch):
    rng = random.Random(3)
    fps = []
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(6):
            x = base
            for b in rng.sample(range(64), rng.choice([1, 2, 3])):
                x ^= 1 << b
            fps.append(x)
    fps = sorted(set(fps))
    want = {frozenset((a, b)) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 3}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {frozenset((a % 2**64, b % 2**64)) for a, b in S.fingerprint_links(df).collect()}
    assert got == want
    cold = {tuple(r) for r in S.fingerprint_roots(df).collect()}
    monkeypatch.setattr(S, "HOT_ROWS", 2)
    monkeypatch.setattr(S, "BLOCK_ROWS", 3)
    assert {tuple(r) for r in S.fingerprint_roots(df).collect()} == cold


def below_broadcasts(df):
    """Lines of the plan that stand below a broadcast."""
    out, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at > depth:
            out.append(line)
        else:
            depth = at if "BroadcastExchange" in line else None
    return out


def test_no_keys_or_rows_are_broadcast_however_small_spark_counts_them(spark, monkeypatch):
    rng = random.Random(6)
    fps = [int(np.uint64(rng.getrandbits(64)).view(np.int64)) for _ in range(200)]
    stored = materialize(spark.createDataFrame([(f,) for f in fps + [f ^ 1 for f in fps]], "fp long"), "test-fps")
    assert below_broadcasts(S.fingerprint_links(stored)) == []
    monkeypatch.setattr(S, "HOT_ROWS", 2)
    below = below_broadcasts(S.fingerprint_links(stored))
    assert below and not [line for line in below if "fp#" in line]  # the hot keys alone
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in corpus()], SCHEMA)
    assert not [line for line in below_broadcasts(S.simhash_components(docs)) if "__id#" in line]


def test_code_is_perfect():
    low, high, patterns, number = S.golay_tables()
    assert sorted(set(number.tolist())) == [1, 6]
    assert (number == 6).sum() == 1771
