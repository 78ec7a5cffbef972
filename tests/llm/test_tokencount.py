import random

import pytest

from rankweave.llm import tokencount as T

SCORES = {"▁": -3.0, "a": -4.0, "b": -4.0, "ab": -5.0, "▁ab": -6.0, "ba": -5.5, "abba": -7.0, "é": -6.0, "▁a": -3.5}


def brute(word):
    """Best (score, tokens) over every segmentation."""
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + T.BYTE_SCORE * n, -(best[end - 1][1] + n))]
        for start in range(end):
            if word[start:end] in SCORES:
                options.append((best[start][0] + SCORES[word[start:end]], -(best[start][1] + 1)))
        s, t = max(options)
        best.append((s, -t))
    return best[-1][1]


def words():
    rng = random.Random(1)
    return ["".join(rng.choices("abéxक", k=rng.randint(1, 14))) for _ in range(600)]


@pytest.mark.parametrize("nodes", [1 << 18, 5])
def test_counts_equal_every_segmentation(monkeypatch, nodes):
    monkeypatch.setattr(T, "MAX_NODES", nodes)
    monkeypatch.setattr(T, "MAX_COUNTS", 40)
    counts = T.TerminalCounts(SCORES)
    for w in words() * 2:
        assert counts[w.encode()] == brute("▁" + w), w


def test_prefixes_are_shared():
    trie = T.PrefixTrie(SCORES)
    trie.count("▁abba")
    n = len(trie.score)
    trie.count("▁abbab")
    assert len(trie.score) == n + 1


def test_table(spark, monkeypatch):
    monkeypatch.setattr(T, "load_vocabulary", lambda path: SCORES)
    long = "ab " * 100_000 + "a" * 5000
    rows = [(1, "ab abba\tx"), (2, None), (3, ""), (4, " \n"), (None, "ab"), (5, "ab"), (5, "ab"), (6, long)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, c string")
    want = sorted(((i, len((t or "").split()), sum(brute("▁" + w) for w in (t or "").split())) for i, t in rows[:-1]), key=str)
    got = sorted((tuple(r) for r in T.token_counts(df).collect()), key=str)
    assert [g for g in got if g[0] != 6] == want
    assert [g[1] for g in got if g[0] == 6] == [100_001]
    assert T.token_counts(df.limit(0)).count() == 0


def test_public_vocabulary():
    scores = T.load_vocabulary()
    assert len(scores) > 30_000 and all(s < 0 for s in scores.values()) and min(scores.values()) > T.BYTE_SCORE
    assert T.TerminalCounts(scores)["the".encode()] == 1


def test_generations_change_no_count(monkeypatch):
    scores = {"▁a": -1.0, "b": -2.0, "ab": -1.5, "▁": -3.0, "a": -2.5}
    words = [w.encode() for w in ("a", "ab", "ba", "bb", "abab", "x", "é")] * 5
    want = [T.TerminalCounts(scores)[w] for w in words]
    monkeypatch.setattr(T, "MAX_COUNTS", 4)
    small = T.TerminalCounts(scores)
    assert [small[w] for w in words] == want and len(small) <= 2 and len(small.older) <= 2
