"""Token ids in files of fixed bit width.

An id takes the least number of bits that holds the largest id of the
vocabulary. Documents are range-partitioned and sorted by id; every task
encodes its texts and writes one file, so a file holds a run of documents in
order, and the manifest, written when all tasks are done, gives each file's
place among all ids. A task that runs again writes a file of another name, and
only files named in the manifest count.

A file, little-endian:
  magic        8 bytes
  blocks       ``block`` ids each, packed from the lowest bit up; the last may be short
  starts       u64, (documents + 1): ids of the file before each document
  documents    i64 each, then one byte each: 1 if the document's id is not null
  offsets      u64, (blocks + 1): place of each block in the file
  trailer      bits u32, block u32, then u64: documents, ids, place of starts
A range of ids is read by the offsets of its blocks and unpacked with numpy.

Nulls and ties: a null text is empty, every document ends with the end id, a
null document id comes first, rows of equal id are ordered by a hash of the
text, repeated rows stay rows of their own; an empty table gives a manifest
without files. Other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

FORMAT = "packed_ids"
MAGIC = b"PACKID01"
TRAILER = "<IIQQQ"
MANIFEST = "manifest.json"
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: ids of a block; a multiple of 8, so blocks end on whole bytes
BLOCK_IDS = 4096
#: ids of a read task, and of one batch it returns (a document is never cut)
TASK_IDS = 1 << 25
BATCH_IDS = 1 << 18
#: texts encoded at once, in bytes; distinct words joined in one text, and the mark between them
CHUNK_BYTES = 2 << 20
JOIN_WORDS = 128
MARK = "|"
#: letters with a lower case of one letter, and the end of a clause behind one of them
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN_WORD = f"^[{LETTERS}]+$"
SENTENCE_END = rf"([{LETTERS}])([.,;:!?]+)(\s|$)"
PROBES = ["", "It's two words, Été ÀÖØÞß; don't! x?! 12.5 a.b", " \n", "one|two ||", "Ende. Anfang:", "İ. é, ﬁ. e\u0301. 'S."]
#: newest distinct words a worker keeps with their ids
KEPT_WORDS = 1 << 18
SCHEMA = "doc_id long, start long, ids array<int>"


# -- bits ---------------------------------------------------------------------------

def width_of(vocabulary: int) -> int:
    """Least bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a string of bits, each from its lowest bit up."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and bits < 32 and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for at in range(0, len(ids), 1 << 16):
        part = ids[at:at + (1 << 16)]
        planes = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
        out.append(np.packbits(planes.reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a string of bits."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    out = np.zeros(n, "<u4")
    step = 1 << 16
    for at in range(0, n, step):
        m = min(step, n - at)
        part = np.frombuffer(data, np.uint8, (m * bits + 7) // 8, at * bits // 8)
        planes = np.zeros((m, 32), np.uint8)
        planes[:, :bits] = np.unpackbits(part, bitorder="little")[:m * bits].reshape(m, bits)
        out[at:at + m] = np.packbits(planes, axis=1, bitorder="little").view("<u4")[:, 0]
    return out


# -- files --------------------------------------------------------------------------

def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and folder of a path or URI of the shared storage."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path.rstrip("/")
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/").rstrip("/")
    scheme, rest = path.split("://", 1)
    fs, folder = pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")
    return fs, folder.rstrip("/")


class FileWriter:
    """Appends documents to one file."""

    def __init__(self, sink, bits: int, block: int = BLOCK_IDS):
        self.sink, self.bits, self.block = sink, bits, block
        self.starts, self.documents, self.known = [0], [], []
        self.rest = np.zeros(0, np.uint32)
        self.offsets = [len(MAGIC)]
        sink.write(MAGIC)

    def append(self, documents: list, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Documents (None for null) whose ids lie one after the other in ``ids``."""
        self.documents += [d or 0 for d in documents]
        self.known += [d is not None for d in documents]
        self.starts += (self.starts[-1] + np.cumsum(lengths, dtype=np.int64)).tolist()
        flow = np.concatenate([self.rest, ids], dtype=np.uint32, casting="unsafe")
        whole = len(flow) - len(flow) % self.block
        self.sink.write(pack(flow[:whole], self.bits))
        size = self.block * self.bits // 8
        self.offsets += [self.offsets[-1] + size * (k + 1) for k in range(whole // self.block)]
        self.rest = flow[whole:]

    def finish(self) -> tuple[int, int]:
        """Index and trailer; (documents, ids) of the file."""
        if len(self.rest):
            last = pack(self.rest, self.bits)
            self.sink.write(last)
            self.offsets.append(self.offsets[-1] + len(last))
        self.sink.write(np.array(self.starts, "<u8").tobytes())
        self.sink.write(np.array(self.documents, "<i8").tobytes())
        self.sink.write(np.array(self.known, np.uint8).tobytes())
        self.sink.write(np.array(self.offsets, "<u8").tobytes())
        self.sink.write(struct.pack(TRAILER, self.bits, self.block, len(self.documents), self.starts[-1], self.offsets[-1]))
        return len(self.documents), self.starts[-1]


class PackedFile:
    """Random access to one file: documents and ids by number."""

    def __init__(self, fs: pafs.FileSystem, name: str):
        self.file = fs.open_input_file(name)
        size = self.file.size()
        n = struct.calcsize(TRAILER)
        self.bits, self.block, self.n_docs, self.n_ids, self.index = struct.unpack(TRAILER, self.file.read_at(n, size - n))
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{name} is no file of packed ids")
        self.n_blocks = -(-self.n_ids // self.block)

    def _array(self, at: int, kind: str, first: int, last: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.frombuffer(self.file.read_at((last - first) * width, at + first * width), kind)

    def documents(self, first: int, last: int) -> tuple[list, np.ndarray]:
        """Ids of the documents first .. last - 1, and their starts with the end of the last."""
        at = self.index + 8 * (self.n_docs + 1)
        ids = self._array(at, "<i8", first, last)
        known = self._array(at + 8 * self.n_docs, "u1", first, last)
        starts = self._array(self.index, "<u8", first, last + 1).astype(np.int64)
        return [int(i) if k else None for i, k in zip(ids, known)], starts

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids first .. last - 1 of the file, by the blocks that hold them."""
        if last <= first:
            return np.zeros(0, np.uint32)
        one, two = first // self.block, -(-last // self.block)
        offsets = self._array(self.index + 17 * self.n_docs + 8, "<u8", one, two + 1)
        data = self.file.read_at(int(offsets[-1] - offsets[0]), int(offsets[0]))
        n = min(two * self.block, self.n_ids) - one * self.block
        return unpack(data, self.bits, n)[first - one * self.block:last - one * self.block]

    def close(self) -> None:
        self.file.close()


def read_manifest(path: str) -> dict:
    fs, folder = _store(path)
    with fs.open_input_file(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


# -- Spark source and sink ----------------------------------------------------------

def _runs(lists: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lengths, ids) of a column of id lists."""
    yield (pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False),
           lists.flatten().to_numpy(zero_copy_only=False))


@dataclass
class Written(WriterCommitMessage):
    partition: int
    name: str | None
    documents: int
    ids: int


class PackedWriter(DataSourceArrowWriter):
    """One file for each task; rows are (doc_id, ids), or (doc_id, text) to be
    encoded with the option ``vocabulary``, in the order to be kept."""

    def __init__(self, options):
        self.path = options["path"]
        self.bits = int(options["bits"])
        self.block = int(options.get("block", BLOCK_IDS))
        self.vocabulary = options.get("vocabulary")
        self.end_id = int(options.get("end_id", END_ID))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        part = TaskContext.get().partitionId()
        fs, folder = _store(self.path)
        name, sink, writer = None, None, None
        encoder = encoder_of(self.vocabulary, self.end_id) if self.vocabulary else None
        for batch in iterator:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(folder, recursive=True)
                name = f"part-{part:06d}-{os.urandom(6).hex()}.ids"
                sink = fs.open_output_stream(f"{folder}/{name}")
                writer = FileWriter(sink, self.bits, self.block)
            at = 0
            for lengths, ids in encoder.encode(batch.column("text")) if encoder else _runs(batch.column("ids")):
                writer.append(batch.column("doc_id")[at:at + len(lengths)].to_pylist(), lengths, ids)
                at += len(lengths)
        if writer is None:
            return Written(part, None, 0, 0)
        documents, ids = writer.finish()
        sink.close()
        return Written(part, name, documents, ids)

    def commit(self, messages: list) -> None:
        """The manifest: a line for each file, with the ids of all files before it."""
        files, start = [], 0
        for m in sorted((m for m in messages if m and m.name), key=lambda m: m.partition):
            files.append({"name": m.name, "documents": m.documents, "ids": m.ids, "start": start})
            start += m.ids
        fs, folder = _store(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/{MANIFEST}") as f:
            f.write(json.dumps({"format": MAGIC.decode(), "bits": self.bits, "block": self.block, "ids": start,
                                "files": files}).encode())

    def abort(self, messages: list) -> None:
        """Without a manifest the files of the tasks that ended count for nothing."""


@dataclass
class Run(InputPartition):
    """Documents first .. last - 1 of a file whose ids begin at ``start``."""
    name: str | None
    start: int
    first: int
    last: int


class PackedReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.task_ids = int(options.get("task_ids", TASK_IDS))
        self.batch_ids = int(options.get("batch_ids", BATCH_IDS))

    def partitions(self) -> list[Run]:
        runs = []
        for f in read_manifest(self.path)["files"]:
            parts = min(f["documents"], max(1, -(-f["ids"] // self.task_ids)))
            cuts = [f["documents"] * k // parts for k in range(parts + 1)]
            runs += [Run(f["name"], f["start"], a, b) for a, b in zip(cuts, cuts[1:])]
        return runs or [Run(None, 0, 0, 0)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        if run.name is None:
            return
        fs, folder = _store(self.path)
        file = PackedFile(fs, f"{folder}/{run.name}")
        documents, starts = file.documents(run.first, run.last)
        at = 0
        while at < len(documents):
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + self.batch_ids, side="right")) - 1)
            ids = file.ids(int(starts[at]), int(starts[end]))
            lists = pa.ListArray.from_arrays(pa.array((starts[at:end + 1] - starts[at]).astype(np.int32)),
                                             pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(documents[at:end], pa.int64()),
                                              pa.array(starts[at:end] + run.start, pa.int64()), lists],
                                             ["doc_id", "start", "ids"])
            at = end
        file.close()


class PackedIds(DataSource):
    """``spark.read.format("packed_ids")``: (doc_id, start, ids); ``write``
    takes (doc_id, ids) or (doc_id, text) and the option ``bits``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PackedReader:
        return PackedReader(self.options)

    def writer(self, schema, overwrite) -> PackedWriter:
        return PackedWriter(self.options)


# -- encoding -----------------------------------------------------------------------

class Encoder:
    """Ids of whole texts. Where no token of the vocabulary holds white space,
    a word stands alone, and the library encodes each distinct word of a chunk
    once, many in one text with a mark between them. A word that holds the
    mark is encoded by itself. The newest words are kept, as two columns.

    Words of plain letters in lower case need no normalising and no splitting;
    they go through the same model without these steps. Both ways are tried on
    PROBES first, and a vocabulary that answers otherwise gets whole texts."""

    def __init__(self, vocabulary: str, end_id: int):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library, self.light = Tokenizer.from_file(vocabulary), Tokenizer.from_file(vocabulary)
        self.light.normalizer = normalizers.Sequence([])
        self.light.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.end_id = end_id
        coded = self._encode([MARK])[0]
        self.mark = coded[0] if len(coded) == 1 else None
        self.words = pa.array([], pa.large_string())
        self.lists = pa.array([], pa.list_(pa.int32()))
        self.plain, self.by_words = True, True
        whole = [ids + [end_id] for ids in self._encode(PROBES)]
        for self.plain, self.by_words in ((True, True), (False, True), (False, False)):
            self.words, self.lists = self.words[:0], self.lists[:0]
            lengths, ids = self._chunk(pa.array(PROBES, pa.large_string()))
            if [x.tolist() for x in np.split(ids.to_numpy(), np.cumsum(lengths)[:-1])] == whole:
                break

    def _encode(self, texts: list[str], light: bool = False) -> list[list[int]]:
        library = self.light if light else self.library
        return [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def _lists(self, words: pa.Array) -> pa.ListArray:
        """Ids of distinct words."""
        place = pc.index_in(words, value_set=self.words)
        new = words.filter(pc.is_null(place))
        if len(new):
            lengths, ids = self._new_words(new)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(ids))
            known, self.lists = self.lists, pa.concat_arrays([self.lists, lists])
            self.words = pa.concat_arrays([self.words, new])
            place = place.to_numpy(zero_copy_only=False)
            place = np.where(np.isnan(place), len(known) + np.cumsum(np.isnan(place)) - 1, place).astype(np.int64)
        out = self.lists.take(pa.array(place))
        if len(self.words) > KEPT_WORDS:
            # copies, so that what is dropped is let go
            newest = pa.array(np.arange(len(self.words) - KEPT_WORDS // 2, len(self.words)))
            self.words, self.lists = self.words.take(newest), self.lists.take(newest)
        return out

    def _new_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of words the library has to encode: plain ones, others, those with the mark."""
        alone = pc.match_substring(words, MARK).to_numpy(zero_copy_only=False)
        if self.mark is None:
            alone[:] = True
        plain = pc.match_substring_regex(words, PLAIN_WORD).to_numpy(zero_copy_only=False) & ~alone & self.plain
        lengths, parts, order = np.zeros(len(words), np.int64), [np.zeros(0, np.int32)], []
        for kind, step in ((plain, JOIN_WORDS), (~plain & ~alone, JOIN_WORDS), (alone, 1)):
            places = np.nonzero(kind)[0]
            order.append(places)
            part = words.take(pa.array(places))
            texts = (pc.utf8_lower(part) if kind is plain else part).to_pylist()
            for at in range(0, len(texts), step):
                group, to = texts[at:at + step], places[at:at + step]
                ids = np.array(self._encode([f" {MARK} ".join(group)], kind is plain)[0], np.int32)
                marks = np.nonzero(ids == self.mark)[0] if step > 1 else np.zeros(0, np.int64)
                lengths[to] = np.diff(np.append(marks, len(ids)), prepend=-1) - 1
                parts.append(np.delete(ids, marks))
        order, flat = np.concatenate(order), np.concatenate(parts)
        # back to the order of the words
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths[order])).astype(np.int32)), pa.array(flat))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return lengths, lists.take(pa.array(back)).flatten().to_numpy()

    def _chunk(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(lengths, ids) of texts without nulls, end ids included."""
        if not self.by_words:
            coded = [ids + [self.end_id] for ids in self._encode(texts.to_pylist())]
            return np.array([len(x) for x in coded], np.int64), pa.array([i for x in coded for i in x], pa.int32())
        if self.plain:
            texts = pc.replace_substring_regex(texts, SENTENCE_END, r"\1 \2\3")
        parted = pc.ascii_split_whitespace(texts)
        counts = pc.list_value_length(parted).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parted.flatten().dictionary_encode()
        # the last word of the table is the end id
        table = pa.concat_arrays([self._lists(coded.dictionary), pa.array([[self.end_id]], pa.list_(pa.int32()))])
        lengths = pc.list_value_length(table).to_numpy()
        ends = np.cumsum(counts + 1) - 1
        flow = np.full(int(ends[-1]) + 1, len(lengths) - 1, np.int32)
        inner = np.ones(len(flow), bool)
        inner[ends] = False
        flow[inner] = coded.indices.to_numpy(zero_copy_only=False)
        return np.diff(np.cumsum(lengths[flow])[ends], prepend=0), table.take(pa.array(flow)).flatten()

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(lengths, ids) for one run of texts after the other, whole texts of
        CHUNK_BYTES together (one text if it is longer)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        bounds = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            before = int(bounds[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(bounds, before + CHUNK_BYTES, side="right")))
            lengths, ids = self._chunk(texts[at:end])
            yield lengths, ids.to_numpy(zero_copy_only=False)
            at = end


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder_of(vocabulary: str, end_id: int) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    from . import packed as module  # the writer travels by value, its encoders stay

    key = (vocabulary, end_id)
    if key not in module._ENCODERS:
        module._ENCODERS[key] = module.Encoder(vocabulary, end_id)
    return module._ENCODERS[key]


def vocabulary_size(vocabulary: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True)


# -- operator -----------------------------------------------------------------------

def write_packed(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_ID) -> None:
    """Encode every whole text and write the files and the manifest into the
    new folder ``path`` of the shared storage, in ascending order of ids."""
    spark = docs.sparkSession
    spark.dataSource.register(PackedIds)
    bits = width_of(max(vocabulary_size(vocabulary), end_id + 1))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    (ordered.select("doc_id", "text").write.format(FORMAT).mode("append").option("path", path).option("bits", bits)
     .option("vocabulary", vocabulary).option("end_id", end_id).save())


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of the files in ``path``; start counts the ids of all documents before."""
    spark.dataSource.register(PackedIds)
    return spark.read.format(FORMAT).option("path", path).load()


def ids_crc32(ids: Column) -> Column:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    def of(lists: pa.Array) -> pa.Array:
        flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False)).astype("<i4", copy=False)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        return pa.array([zlib.crc32(part) for part in np.split(flat, ends[:-1])] if len(lists) else [], pa.int64())

    return F.arrow_udf(of, "long")(ids)


def digests(packed: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what :func:`read_packed` gives."""
    return packed.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"),
                         ids_crc32(F.col("ids")).alias("ids_crc32"))
