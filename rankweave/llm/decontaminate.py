"""Benchmark decontamination by template canonicalisation.

Numbers, names (capitalised words) and units (unit words behind a number) of
documents and benchmark items become typed placeholders, all other words are
literal. Windows of WINDOW template tokens are hash-joined; windows on the
same diagonal of a document and an item are aligned token by token, and the
alignment counts if its slots are consistent: every value of the item stands
for one value of the document and the other way round. So a question is
found verbatim and with other numbers, names or units.

Names are known by their letter case. So a window that holds a name has a
second, case-blind form, in which names are literal words too, joined the same
way. An alignment is judged on its template windows alone, and on those of
both forms with the values case-folded; either is enough. So a question is
also found in capitals, in lower case and in title case.

A document row meets the benchmark through a bit map of fixed size (two
probes for a window); what passes it is verified by the join. An item shorter
than WINDOW is one window. Windows need MIN_LITERAL literal tokens (an item
shorter than that, none); case-blind ones always do, so a lone name is no hit.

Nulls and ties: null and empty texts have no window; rows equal in id and
text give one result; repeated items give one result for each item id; empty
tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 8
MIN_LITERAL = 3
#: an alignment counts from this share of the item's tokens, or this number of them
MIN_SHARE = 0.5
MIN_TOKENS = 13
#: the bit map has 32 places a window of the benchmark, of 2**20 bits (128 KiB) at least and 2**30 (128 MiB) at most
MAP_BITS = (20, 30)
CHUNK_CHARS = 1 << 19
CACHED_WORDS = 1 << 19

# Unit words, and number words of English.
UNITS = frozenset("""
mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t gram grams kilogram kilograms ton tons
tonne tonnes oz ounce ounces lb lbs pound pounds ml cl l liter liters litre litres gallon gallons s sec second seconds
min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz w kw mw v kv a ma j kj
cal kcal pa kpa bar k c f degree degrees percent euro euros eur dollar dollars usd cent cents gbp yen kmh mph
""".split())
NUMBER_WORDS = frozenset("""
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
""".split())

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+")
SLOTS = {"n": 0x1D8E4E27C47D124F, "N": 0x5B3A9F1E6D2C8B07, "u": 0x7F4A7C159E3779B9}
_KINDS = {code: kind for kind, code in SLOTS.items()}
MULTIPLIER = 0xD6E8FEB86659FD93


def kind_of(token: str) -> str:
    """n: number, N: name, w: literal."""
    if token[0].isdigit():
        return "n"
    if token.lower() in NUMBER_WORDS:
        return "n"
    return "N" if token[0].isupper() and token[1:].islower() else "w"


class _Codes(dict):
    """64-bit code of a token by its template form."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        kind = kind_of(token)
        self[token] = code = SLOTS.get(kind) or xxhash.xxh64_intdigest(token.casefold().encode())
        return code


class _Folded(dict):
    """64-bit code of a name as a literal word."""

    def __missing__(self, token: str) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        self[token] = code = xxhash.xxh64_intdigest(token.casefold().encode())
        return code


def _codes(tokens: list[str], cache: _Codes) -> np.ndarray:
    codes = np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))
    for i in np.flatnonzero(codes[:-1] == np.uint64(SLOTS["n"])) + 1:
        if tokens[i].lower() in UNITS and codes[i] != np.uint64(SLOTS["n"]):
            codes[i] = SLOTS["u"]
    return codes


def _blind(codes: np.ndarray, tokens: list[str], cache: _Folded) -> np.ndarray:
    """Codes with the names as literal words."""
    names = np.flatnonzero(codes == np.uint64(SLOTS["N"]))
    out = codes.copy()
    out[names] = np.fromiter((cache[tokens[i]] for i in names.tolist()), np.uint64, len(names))
    return out


def _hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every window of ``length`` codes."""
    n = max(len(codes) - length + 1, 0)
    h = np.full(n, length, np.uint64)
    for j in range(length if n else 0):
        h = (h ^ codes[j:j + n]) * np.uint64(MULTIPLIER)
        h ^= h >> np.uint64(29)
    return h


def _literal(codes: np.ndarray) -> np.ndarray:
    return ~np.logical_or.reduce([codes == np.uint64(c) for c in SLOTS.values()])


def _pieces(text: str) -> Iterator[list[str]]:
    """Tokens of pieces of the text, cut at white space."""
    at, space = 0, re.compile(r"\s")
    while at < len(text):
        cut = space.search(text, at + CHUNK_CHARS)
        end = cut.start() if cut else len(text)
        yield TOKEN.findall(text, at, end)
        at = end


def windows(text: str | None, lengths: list[int], bits: np.ndarray | None, cache: _Codes,
            folded: _Folded | None = None) -> list[dict]:
    """Windows of a text: place, hash, kinds, kinds in the template, tokens
    case-folded, and slot values as written; those with a name twice, the
    second time case-blind (without ``raw``). With ``bits`` only those that
    the map lets pass."""
    out: list[dict] = []
    context: list[str] = []
    folded = _Folded() if folded is None else folded
    first, longest = 0, max(lengths, default=0)
    for piece in _pieces(text or ""):
        tokens = context + piece
        codes = _codes(tokens, cache) if tokens else np.zeros(0, np.uint64)
        literal = _literal(codes)
        words = literal | (codes == np.uint64(SLOTS["N"]))
        sums, word_sums = (np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in (literal, words))
        blind = _blind(codes, tokens, folded)
        for length in lengths:
            for form in (codes, blind):
                h = _hashes(form, length)
                count = sums[length:] - sums[:-length]
                if not len(h):
                    use = np.zeros(0, bool)
                elif form is codes:
                    use = count >= min(MIN_LITERAL, length)
                else:  # a window without a name is the same in both forms
                    word_count = word_sums[length:] - word_sums[:-length]
                    use = (word_count >= MIN_LITERAL) & (word_count > count)
                if bits is not None:
                    use[use] = _passes(h[use], bits)
                for i in np.flatnonzero(use).tolist():
                    # windows wholly inside the part carried over were given before, their context seen
                    if context and i + length <= len(context):
                        continue
                    own = "".join(_KINDS.get(c, "w") for c in codes[i:i + length].tolist())
                    seen = tokens[i:i + length]
                    out.append({"pos": first + i, "hash": int(h[i].view(np.int64)), "own": own,
                                "kinds": own if form is codes else own.replace("N", "w"),
                                "tokens": [t.casefold() for t in seen],
                                "raw": ["" if k == "w" else t for t, k in zip(seen, own)] if form is codes else None})
        keep = min(len(tokens), longest)
        first += len(tokens) - keep
        context = tokens[len(tokens) - keep:]
    return out


def _places(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << width) - 1)
    return h & mask, (h >> np.uint64(width)) & mask


def _passes(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    a, b = _places(h, (8 * len(bits)).bit_length() - 1)
    return (((bits[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            & ((bits[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1).astype(bool))


WINDOW_TYPE = "array<struct<pos:long,hash:long,kinds:string,own:string,tokens:array<string>,raw:array<string>>>"
_ARROW_TYPE = pa.list_(pa.struct([("pos", pa.int64()), ("hash", pa.int64()), ("kinds", pa.string()),
                                  ("own", pa.string()), ("tokens", pa.list_(pa.string())), ("raw", pa.list_(pa.string()))]))


def _windows_udf(text: Column, lengths: list[int], bits) -> Column:
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache, folded, found = _Codes(), _Folded(), None if bits is None else bits.value
        for texts in batches:
            yield pa.array((windows(x.as_py(), lengths, found, cache, folded) for x in texts), _ARROW_TYPE)

    return F.arrow_udf(of, WINDOW_TYPE)(text)


def _token_counts(text: Column) -> Column:
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([len(TOKEN.findall(x.as_py() or "")) for x in texts], pa.int64())

    return F.arrow_udf(of, "long")(text)


def _items(bench: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Stored windows of the benchmark: (item, size, pos, hash, kinds, own, tokens, raw)."""
    base = materialize(bench.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"),
                                    _token_counts(F.col(text_col)).alias("size")).where("size > 0"), "bench-items")
    short = [r["size"] for r in base.where(F.col("size") < WINDOW).select("size").distinct().collect()]
    parts = []
    for length in sorted({*short, WINDOW}):
        own = base.where(F.col("size") >= WINDOW) if length == WINDOW else base.where(F.col("size") == length)
        parts.append(own.select("item", "size", F.explode(_windows_udf(F.col("text"), [length], None)).alias("w"))
                     .select("item", "size", "w.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return materialize(out, "bench-windows")


def _bit_map(items: DataFrame) -> np.ndarray:
    """Bits with two places set for each window hash, their number by that of
    the windows (MAP_BITS); the driver gets no more than these."""
    size = min(max((32 * items.count()).bit_length(), MAP_BITS[0]), MAP_BITS[1])
    mask = (1 << size) - 1
    places = items.select(F.explode(F.array(
        F.col("hash").bitwiseAND(mask), F.shiftrightunsigned("hash", size).bitwiseAND(mask))).alias("p"))
    bits = np.zeros((1 << size) // 8, np.uint8)
    width = 4096  # bytes of one of Spark's bit maps, which hold the places 1 to 32768 of a bucket
    made = places.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits"))
    for r in made.collect():
        at = (r.bucket - 1) * width
        bits[at:at + width] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", min_share: float = MIN_SHARE,
                  min_tokens: int = MIN_TOKENS) -> DataFrame:
    """One row per document text and item that it holds: id, ``text_hash``
    (XXH64 of the text), item id, its tokens, tokens covered by the longest
    consistent alignment, literal ones among them, slots that differ, and
    whether all of them agree (``verbatim``)."""
    items = _items(bench, item_col, item_text_col)
    lengths = sorted({WINDOW, *[len(r.kinds) for r in items.where(F.length("kinds") < WINDOW).select("kinds").distinct().collect()]})
    bits = docs.sparkSession.sparkContext.broadcast(_bit_map(items))
    text = F.col(text_col)
    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"),
                        F.explode(_windows_udf(text, lengths, bits)).alias("w")).select("id", "text_hash", "w.*")
    found = materialize(found, "doc-windows")
    at = items.select("item", "size", F.col("pos").alias("item_pos"), "hash", "kinds", F.col("own").alias("item_own"),
                      F.col("tokens").alias("item_tokens"), F.col("raw").alias("item_raw"))
    literal_differs = F.exists(
        F.arrays_zip(F.split("kinds", "").alias("k"), F.col("tokens").alias("d"), F.col("item_tokens").alias("i")),
        lambda t: (t["k"] == "w") & (t["d"] != t["i"]))
    pairs = found.join(at, ["hash", "kinds"]).where(~literal_differs)

    def judged(template: bool, theirs: str, ours: str) -> Column:
        # a name of the item is a slot in both forms of a window
        sides = F.arrays_zip(F.split("item_own", "").alias("k"), F.col(theirs).alias("d"), F.col(ours).alias("i"))
        return F.transform(sides, lambda t, j: F.struct(F.lit(template).alias("template"), (F.col("item_pos") + j).alias("at"),
                                                        t["k"].alias("k"), t["d"].alias("d"), t["i"].alias("i")))

    both_forms = judged(False, "tokens", "item_tokens")
    in_template = F.col("raw").isNotNull() & F.col("item_raw").isNotNull()
    token = F.explode(F.when(in_template, F.concat(both_forms, judged(True, "raw", "item_raw"))).otherwise(both_forms))
    tokens = (pairs.select("id", "text_hash", "item", "size", (F.col("pos") - F.col("item_pos")).alias("shift"), token.alias("t"))
              .select("id", "text_hash", "item", "size", "shift", "t.*").distinct())
    aligned = _consistent(tokens).groupBy(*ALIGNMENT).agg(
        F.count_distinct(F.when(F.col("kept"), F.col("at"))).alias("covered"),
        F.count_distinct(F.when(F.col("k") == "w", F.col("at"))).alias("literal"),
        F.count_distinct(F.when(F.col("kept") & (F.col("k") != "w") & (F.col("d") != F.col("i")), F.struct("k", "i"))).alias("changed"),
        F.count_distinct(F.when(~F.col("kept"), F.col("at"))).alias("dropped"))
    good = aligned.where(F.col("covered") >= F.least(F.lit(min_tokens), F.ceil(F.col("size") * min_share)))
    best = F.max(F.struct("covered", "literal", (-F.col("changed") - F.col("dropped")).alias("same"))).alias("best")
    return (good.groupBy("id", "text_hash", "item", "size").agg(best)
            .select(F.col("id").alias(id_col), "text_hash", F.col("item").alias(item_col), F.col("size").alias("item_tokens"),
                    "best.covered", "best.literal", (-F.col("best.same")).alias("changed_slots"),
                    (F.col("best.same") == 0).alias("verbatim")))


ALIGNMENT = ["id", "text_hash", "item", "size", "shift", "template"]


def _consistent(tokens: DataFrame) -> DataFrame:
    """Add ``kept``: literal tokens, and slots whose value is the partner most
    of the item's occurrences have, and the other way round; an equal value
    wins a tie, then the larger one. Where one occurrence of a repeated value
    was edited, that place drops out and the rest of the alignment counts."""
    pair = Window.partitionBy(*ALIGNMENT, "k", "d", "i")
    n, equal = F.count("*").over(pair), F.col("d") == F.col("i")
    counted = tokens.withColumn("n", n)
    most = lambda ours, theirs: F.max(F.struct("n", equal, theirs)).over(Window.partitionBy(*ALIGNMENT, "k", ours))[theirs]
    partners = counted.withColumn("for_d", most("d", "i")).withColumn("for_i", most("i", "d"))
    kept = (F.col("k") == "w") | ((F.col("for_d") == F.col("i")) & (F.col("for_i") == F.col("d")))
    return partners.withColumn("kept", kept)


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text holds no item, with their columns."""
    found = contamination(docs, bench, id_col, text_col, item_col, item_text_col)
    bad = materialize(found.select(F.col("text_hash").alias("__hash")).distinct(), "contaminated")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.join(bad, F.xxhash64(F.col(f"row.`{text_col}`")) == F.col("__hash"), "left_anti").select("row.*")
