import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest

from rankweave.llm import packed
from rankweave.llm.queries import TOKENIZERS
from rankweave.session import scratch_path

VOCABULARY = f"{TOKENIZERS}/{packed.VOCABULARY}"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def whole(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [packed.END_ID]


@pytest.mark.parametrize("bits", range(1, 33))
def test_bits_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 4096, 70001):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = packed.pack(ids, bits)
        assert len(data) == (n * bits + 7) // 8
        assert np.array_equal(packed.unpack(data, bits, n), ids)
        # bit k of the string is bit k % bits of id k // bits
        string = int.from_bytes(data, "little")
        assert all(string >> (k * bits) & ((1 << bits) - 1) == int(ids[k]) for k in range(min(n, 20)))


def test_width_and_too_large_ids():
    assert [packed.width_of(v) for v in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        packed.pack(np.array([8]), 3)


def test_random_access(tmp_path):
    rng = np.random.default_rng(3)
    name = str(tmp_path / "one.ids")
    docs = [rng.integers(0, 1 << 11, n).astype(np.uint32) for n in rng.integers(0, 60, 200)]
    with open(name, "wb") as f:
        w = packed.FileWriter(f, 11, block=32)
        for at in range(0, 200, 17):
            part = docs[at:at + 17]
            w.append([None if i == 5 else i - 3 for i in range(at, at + len(part))],
                     np.array([len(d) for d in part]), np.concatenate(part))
        assert w.finish() == (200, sum(map(len, docs)))
    file = packed.PackedFile(pafs.LocalFileSystem(), name)
    flat = np.concatenate(docs)
    ids, starts = file.documents(0, 200)
    assert ids == [None if i == 5 else i - 3 for i in range(200)]
    for i in rng.integers(0, 200, 50):
        assert np.array_equal(file.ids(int(starts[i]), int(starts[i + 1])), docs[i])
    for a, b in rng.integers(0, len(flat) + 1, (50, 2)):
        a, b = min(a, b), max(a, b)
        assert np.array_equal(file.ids(int(a), int(b)), flat[a:b])
    file.close()


def encoded(texts):
    out = []
    for lengths, ids in packed.Encoder(VOCABULARY, packed.END_ID).encode(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
    return out


def test_words_equal_whole_texts(library):
    rng = np.random.default_rng(5)
    parts = ["Don't", "l'état", "é", "\u0301", "ΣΑΣ", "İ", "<|endoftext|>", "a<|startoftext|>b", "12345", "...", " ", "\u3000",
             "\u200b", "\x1c", "\x85", "日本語", "한국어", "😀", "ﬁ", "x" * 300, "\x0b", "\r\n", "\t", "\xa0", "  ", "\n", "\x00",
             "|", "a|b", "||", "| |"]
    texts = ["", " ", "\n\n"] + ["".join(parts[i] + [" ", "", "\t"][rng.integers(3)] for i in rng.integers(0, len(parts), 30))
                                 for _ in range(200)]
    assert encoded(texts + [None]) == [whole(library, t) for t in texts + [None]]


def test_small_chunks(monkeypatch, library):
    monkeypatch.setattr(packed, "CHUNK_BYTES", 10)
    monkeypatch.setattr(packed, "JOIN_WORDS", 2)
    monkeypatch.setattr(packed, "KEPT_WORDS", 4)
    texts = [f"w{i % 7} v{i % 3} u{i}" for i in range(60)]
    assert encoded(texts) == [whole(library, t) for t in texts]
    monkeypatch.setattr(packed, "MARK", "ab cd")   # no single id: every word by itself
    assert encoded(texts) == [whole(library, t) for t in texts]


def test_lists_of_ids_are_written_as_they_are(spark):
    path = scratch_path(spark, "packed-test")
    spark.dataSource.register(packed.PackedIds)
    rows = [(1, [3, 0, 7]), (2, None), (4, []), (None, [5])]
    (spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1).write.format(packed.FORMAT).mode("append")
     .option("path", path).option("bits", 3).save())
    got = [(r.doc_id, r.start, r.ids) for r in packed.read_packed(spark, path).collect()]
    assert got == [(1, 0, [3, 0, 7]), (2, 3, []), (4, 3, []), (None, 3, [5])]


def expected(library, rows):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = whole(library, t)
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_table(spark, library):
    rows = [(7, "Some words, and 12 more."), (-4, None), (None, "no id"), (3, ""), (9, "many words here " * 40000),
            (5, "x" * 100000), (1, "A a A"), (2, "A a A")]
    df = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, ids string, tie int").repartition(3)
    path = scratch_path(spark, "packed-test")
    packed.write_packed(df, path, VOCABULARY)
    got = packed.read_packed(spark, path)
    assert got.columns == ["doc_id", "start", "ids"]
    out = sorted((tuple(r) for r in packed.digests(got).collect()), key=lambda r: r[1])
    assert out == expected(library, rows)
    by_id = {r.doc_id: r.ids for r in got.collect()}
    assert all(by_id[i] == whole(library, t) for i, t in rows)
    manifest = packed.read_manifest(path)
    assert manifest["bits"] == 16 and manifest["ids"] == sum(len(x) for x in by_id.values())


def test_small_tasks_and_repeated_rows(spark, library):
    rows = [(i % 20, f"text {i % 5} of {i % 20}") for i in range(200)]
    path = scratch_path(spark, "packed-test")
    packed.write_packed(spark.createDataFrame(rows, "doc_id long, text string"), path, VOCABULARY)
    spark.dataSource.register(packed.PackedIds)
    small = (spark.read.format(packed.FORMAT).option("path", path).option("task_ids", 50).option("batch_ids", 16).load())
    assert small.rdd.getNumPartitions() > 5
    got = sorted((tuple(r) for r in packed.digests(small).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(i for i, _ in rows)
    assert [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got[:-1]]))
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in expected(library, rows))


def test_empty_table(spark):
    path = scratch_path(spark, "packed-test")
    packed.write_packed(spark.createDataFrame([], "doc_id long, text string"), path, VOCABULARY)
    assert packed.digests(packed.read_packed(spark, path)).collect() == []


def test_uncommitted_files_count_for_nothing(spark, library):
    path = scratch_path(spark, "packed-test")
    packed.write_packed(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), path, VOCABULARY)
    with open(f"{path}/part-000000-dead.ids", "wb") as f:
        f.write(b"half a file")
    assert packed.read_packed(spark, path).count() == 2
