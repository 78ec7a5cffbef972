"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded
to the 23 bits of the perfect binary Golay code. The keys of a segment are
the indices of the codewords within distance 4: the decoded codeword alone
when the segment lies within 2 of it, else that one and five more. Two
segments that differ in at most one bit then share the decoded codeword of
either among the keys of the other. With at most three differing bits over
three segments at most one segment has two errors or more, so two segments
have one error at most: fingerprints are joined on the key pairs of every two
segments, the decoded pair of one side against all pairs of the other, and
every pair is verified by its differing bits.

Nulls and ties: a null text has no words and gets fingerprint zero, like an
empty text; equal texts share a fingerprint and so a component; rows with a
null id take part, the smallest id ignores nulls. An empty table gives an
empty result. Other columns of the table are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, forest, materialize

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
CHUNK_BYTES = 1 << 20

# Generator polynomial of the [23, 12, 7] Golay code; the bits of each segment.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEGMENT_PAIRS = ((0, 1), (0, 2), (1, 2))

#: rows of one side of a key from which its pairs are compared in blocks
HOT_ROWS = 64
BLOCK_ROWS = 2048


# -- fingerprints -----------------------------------------------------------

def _chunks(data: bytes) -> Iterator[bytes]:
    """Pieces of about CHUNK_BYTES, cut at white space."""
    at = 0
    space = re.compile(rb"[\x20\x09-\x0d]")
    while at < len(data):
        cut = space.search(data, at + CHUNK_BYTES)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint_bytes(text: bytes | None, shingle: int = SHINGLE_WORDS) -> int:
    """Fingerprint of one text as an unsigned integer."""
    import xxhash

    if not text:
        return 0
    xxh = xxhash.xxh64_intdigest
    counts, total, carry = np.zeros(64, np.int64), 0, []

    def add(hashes: list[int]) -> None:
        nonlocal counts, total
        octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        seen = np.bincount((octets + 256 * np.arange(8, dtype=np.int64)).ravel(), minlength=2048).reshape(8, 256)
        counts += (seen @ _BYTE_BITS).ravel()
        total += len(hashes)

    for piece in _chunks(text.lower()):
        words = carry + piece.split()
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
            add([xxh(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1:].tolist())])
            carry = words[len(words) - shingle + 1:] if shingle > 1 else []
        else:
            carry = words
    if not total:
        if not carry:
            return 0
        add([xxh(b" ".join(carry), SEED)])
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    """64-bit SimHash of a text over word shingles, as a signed long."""
    def of(texts: pa.Array) -> pa.Array:
        whole = texts.cast(pa.large_binary())
        fps = np.fromiter((fingerprint_bytes(whole[i].as_py(), shingle) for i in range(len(whole))), np.uint64, len(whole))
        return pa.array(fps.view(np.int64))

    return F.arrow_udf(of, "long")(text)


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# -- Golay keys ---------------------------------------------------------------

def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits of a word; by syndrome the
    error patterns of weight 4 or less (the lightest first) and their number."""
    from itertools import combinations

    one = [_remainder(1 << i) for i in range(23)]

    def linear(shift: int, bits: int) -> np.ndarray:
        out = np.zeros(1 << bits, np.int64)
        for i in range(bits):
            out[1 << i:2 << i] = out[:1 << i] ^ one[shift + i]
        return out

    patterns, number = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            syndrome = 0
            for i in places:
                syndrome ^= one[i]
            patterns[syndrome, number[syndrome]] = sum(1 << i for i in places)
            number[syndrome] += 1
    return linear(0, 12), linear(12, 11), patterns, number


def segment_keys(words: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices (12 bits, six columns) of 23-bit words and which of the columns count."""
    low, high, patterns, number = tables
    syndrome = low[words & 4095] ^ high[words >> 12]
    return (words[:, None] ^ patterns[syndrome]) >> 11, np.arange(6) < number[syndrome][:, None]


def _keyed(every: bool):
    """Rows (key, fp): all key pairs of a fingerprint, or the decoded ones only."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = golay_tables()
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(whole), 4096):
                fps = whole[at:at + 4096]
                bits = fps.view(np.uint64)
                keys = [segment_keys(((bits >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64), tables)
                        for s, n in SEGMENTS]
                for p, (i, j) in enumerate(SEGMENT_PAIRS):
                    (ka, ma), (kb, mb) = keys[i], keys[j]
                    if not every:
                        ka, ma, kb, mb = ka[:, :1], ma[:, :1], kb[:, :1], mb[:, :1]
                    pair = (p << 24) | (ka[:, :, None] << 12) | kb[:, None, :]
                    use = ma[:, :, None] & mb[:, None, :]
                    row = np.broadcast_to(fps[:, None, None], pair.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[use]), pa.array(row[use])], names=["key", "fp"])
    return keyed


def _block_links(max_bits: int):
    def links(block: pd.DataFrame) -> pd.DataFrame:
        """Verified links between the two sides of a block, as a spanning forest."""
        a = block.loc[block["side"] == 0, "fp"].to_numpy()
        b = block.loc[block["side"] == 1, "fp"].to_numpy()
        x, y = [], []
        for at in range(0, len(a), 256):
            part = a[at:at + 256]
            i, j = np.nonzero(np.bitwise_count((part[:, None] ^ b[None, :]).view(np.uint64)) <= max_bits)
            u, v = part[i], b[j]
            keep = u < v
            u, v = forest(u[keep], v[keep])
            x.append(u)
            y.append(v)
        if not x:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        u, v = forest(np.concatenate(x), np.concatenate(y))
        return pd.DataFrame({"a": u, "b": v})
    return links


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` within
    ``max_bits`` (3 at most) of each other.

    Keys that hold HOT_ROWS decoded fingerprints or more are compared in
    blocks of at most 2 x BLOCK_ROWS rows, which return a spanning forest of
    the block's verified links; all others by a join. Both verify every pair.
    Tables of keys are never broadcast; those of hot keys are, while small.
    """
    if max_bits > MAX_BITS:
        raise ValueError("the keys find fingerprints within three bits")
    decoded = fps.select("fp").mapInArrow(_keyed(False), "key long, fp long")
    every = fps.select("fp").mapInArrow(_keyed(True), "key long, fp long")
    hot = materialize(decoded.groupBy("key").count().where(F.col("count") >= HOT_ROWS), "simhash-hot")
    a = decoded.withColumnRenamed("fp", "a")
    b = every.withColumnRenamed("fp", "b")
    if hot.isEmpty():
        return _joined(a, b, max_bits)
    stored = materialize(every.join(hot.select("key"), "key", "left_semi"), "simhash-hot-keys")
    # stored, so that its size is known and it, not the rows, is the side to broadcast
    sizes = materialize(stored.groupBy("key").agg(F.count("*").alias("n")).join(hot, "key")
                        .select("key", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("na"),
                                F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("nb")), "simhash-hot-sizes")

    def dealt(rows: DataFrame, own: str, other: str, side: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("fp"), F.col(own)).cast("int")
        all_others = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        out = rows.join(sizes, "key").select("key", "fp", mine.alias(own), all_others.alias(other))
        return out.select("key", F.col("na").alias("i"), F.col("nb").alias("j"), F.lit(side).alias("side"), "fp")

    blocks = dealt(decoded.join(hot.select("key"), "key", "left_semi"), "na", "nb", 0).unionByName(
        dealt(stored, "nb", "na", 1))
    in_blocks = blocks.groupBy("key", "i", "j").applyInPandas(_block_links(max_bits), "a long, b long")
    cold = _joined(a.join(hot.select("key"), "key", "left_anti"), b, max_bits)
    return cold.unionByName(in_blocks)


def _joined(a: DataFrame, b: DataFrame, max_bits: int) -> DataFrame:
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    # a fingerprint has up to 108 keys, for which Spark counts one row: it would broadcast them by that size
    return a.join(b.hint("merge"), (a["key"] == b["key"]) & near).select("a", "b")


def fingerprint_roots(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root) for every fingerprint that links with another one."""
    return connected_components(fingerprint_links(fps, max_bits)).select(F.col("node").alias("fp"), "root")


# -- documents ------------------------------------------------------------------

def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id reachable over links of at most
    ``max_bits`` differing bits (equal fingerprints included)."""
    rows = materialize(docs.select(F.col(id_col).alias("__id"), fingerprint(F.col(text_col), shingle).alias("fp")),
                       "simhash-fp")
    fps = materialize(rows.groupBy("fp").agg(F.min("__id").alias("low")), "simhash-distinct")
    roots = fingerprint_roots(fps, max_bits)
    by_root = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = by_root.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = by_root.join(lows, "root").select("fp", "component_id")
    # every fingerprint has a class; an outer join never broadcasts the documents' rows
    return rows.join(classes, "fp", "left").select(
        F.col("__id").alias(id_col), hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component: the one with the smallest id (nulls
    last; among repeated ids the smallest text hash). All columns stay.

    Texts are fingerprinted once: rows and fingerprints are stored, and later
    steps read the fingerprints alone. Only linked fingerprints are mapped to a
    root; the first row of a root is picked by a window that ranks inside each
    task before the shuffle. The columns of the rows travel in one struct.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    fp = fingerprint(F.col(f"row.`{text_col}`"), shingle).alias("fp")
    rows = materialize(packed.select("row", fp), "simhash-rows")
    fps = materialize(rows.select("fp").distinct(), "simhash-distinct")
    roots = fingerprint_roots(fps, max_bits)
    first = Window.partitionBy("root").orderBy(F.col(f"row.`{id_col}`").asc_nulls_last(), F.xxhash64(f"row.`{text_col}`"))
    return (rows.join(roots, "fp", "left")
            .select("row", F.coalesce("root", "fp").alias("root"))
            .withColumn("nth", F.row_number().over(first)).where("nth = 1").select("row.*"))
