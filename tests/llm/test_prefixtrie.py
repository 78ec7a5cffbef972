import hashlib
import random
import zlib

import pytest

from rankweave.llm import prefixtrie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def sequences(rows):
    """conversation -> its (role, text) in order; rows of equal turn must be equal."""
    out = {}
    for c, t, r, x in rows:
        if c is not None:
            out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in out.items()}


def rebuilt(seqs):
    out = {}
    for c, own in seqs.items():
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = seqs.get(base, [])[:h] + own[h:]
    return out


def brute(seqs):
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out, figures = [], {}
    for node in sorted(members, key=len, reverse=True):
        below = [figures[k] for k in kids.get(node, [])]
        saved = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(b[1] for b in below)
        figures[node] = (sum(b[0] for b in below) if below else 1, saved)
        ends = sorted(c for c in members[node] if len(seqs[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]),
                    len(below), *figures[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows, schema=SCHEMA, anew=True):
    turns = pt.ordered_turns(spark.createDataFrame(rows, schema))
    sizes = pt.conversation_sizes(turns)
    found = pt.prefix_trie(*(pt.rebuild(turns) if anew else (turns, sizes)))
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=str)


def talk(rng, c, n, words):
    return [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(words)) for t in range(n)]


def test_rebuilt_conversations(spark):
    rng = random.Random(4)
    words = ["", "a", "bb", "né", "日本"]
    rows = [r for c in [*range(0, 60), *range(200, 230), *range(-130, -95), 305] for r in talk(rng, c, rng.randint(1, 6), words)]
    rows += [(7, None, None, "first"), (9, 3, "user", None), (None, 0, "user", "nobody"), (11, 0, "x", "same"), (11, 0, "x", "same")]
    rows = [r for r in rows if r not in ((11, 0, "user", "a"),)]
    seqs = sequences([r for r in rows if r[0] != 11] + [(11, 0, "x", "same"), (11, 0, "x", "same")])
    rows = [r for r in rows if r[0] != 11 or r[2] == "x"]
    rng.shuffle(rows)
    assert trie(spark, rows) == brute(rebuilt(seqs))


def test_hot_and_long_conversations(spark):
    rng = random.Random(9)
    long = talk(rng, 0, 2 * pt.BLOCK_TURNS + 40, ["x", "yy"])
    # copies of it that end or part at, before and after a block's end, and many copies of a short one
    rows = [(c, *r[1:]) for c in range(1, 9) for r in long[:pt.BLOCK_TURNS * 2 - 3 + c]] + long
    rows += [(50, *r[1:]) for r in long[:pt.BLOCK_TURNS]] + [(50, pt.BLOCK_TURNS, "user", "another end")]
    rows += [(c, t, "user", f"t{t}") for c in range(100, 400) for t in range(3)]
    rows += [r for c in range(400, 500) for r in talk(rng, c, 4, ["x", "y", "z"])]
    rng.shuffle(rows)
    assert trie(spark, rows, anew=False) == brute(sequences(rows))


def test_very_long_text_and_clashing_columns(spark):
    rows = [(c, t, "user", "w" * 300000 if t == 0 else f"{c}", "k", 1, 2, 3) for c in range(3) for t in range(2)]
    schema = SCHEMA + ", conv string, pos int, n int, k1 int"
    assert trie(spark, rows, schema, anew=False) == brute(sequences([r[:4] for r in rows]))


def test_rows_of_equal_turn_keep_one_order(spark):
    rows = [(c, 0, "user", f"t{i}") for i in range(5) for c in range(3)]
    found = trie(spark, rows, anew=False)
    assert [r[3] for r in sorted(found, key=lambda r: r[1])] == [3] * 6
    assert found == trie(spark, rows[::-1], anew=False)


def test_empty_table(spark):
    assert trie(spark, []) == []


def test_turnless_conversations_end_at_the_root(spark):
    # no lender: a conversation shorter than what it would take has no turn left
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "gone")]
    none = hashlib.sha256(str(c).encode()).hexdigest()
    assert trie(spark, rows) == [(c, 0, None, 1, 0, 1, 0, none)]


@pytest.mark.parametrize("second", [False, True])
def test_a_shard_returns_one_row_a_node(second):
    units = [pt.Unit(c, 0, 2, (0, 0), 0, [(1, 1), (2, c % 2)], [5, 1], owned=0 if c == 0 else 3, shared=6) for c in range(900)]
    rows = pt.walk(units, second)
    assert len(rows) == 4 and sorted(r[2] for r in rows) == [0, 1, 2, 2]
