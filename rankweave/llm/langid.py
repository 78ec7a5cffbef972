"""Language identification by hierarchical discrimination.

Linear support vector machines over hashed byte n-grams: one machine per
language family against the rest picks the family, then one-versus-one
machines separate the languages inside it. Machines are fitted on every
labelled row, its text whole, by averaged sub-gradient steps on the hinge
loss: hash groups of about ``GROUP_BYTES`` of text are fitted apart, in
parallel, and their machines averaged. Every text is then scored whole.

Nulls and ties: rows without text or label are not learned from; a null text
or one without a letter is ``und`` with score 0, as is every text when no
language was learned. Equal votes go to the language first in name order.
Repeated rows are judged alike, an empty table gives an empty result, and the
columns of the rows, whatever their names, travel in one struct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UNKNOWN = "und"
#: bytes of text fitted at once, and groups that a task fits one after the other
GROUP_BYTES = 4 << 20
TASK_GROUPS = 16
#: weights that travel in one row
SLICE = 1 << 12
#: sizes of the short pieces learned from, in bytes
SNIPPETS = (24, 60, 200, 1000)
HASH_BITS = 18
ORDERS = (1, 2, 3, 4)
#: passes over the rows of a single group; over several groups, as many fewer (one at least)
EPOCHS = 4
STEP, SHRINK = 0.5, 1e-4
CHUNK_BYTES = 1 << 17
REACH = 3.0

# Language families by ISO 639-1 code; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "semitic": ("am", "ar", "he", "mt"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "austronesian": ("id", "jv", "mg", "ms", "tl"),
}


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang.split("-")[0].lower() in langs), f"only:{lang}")


# -- features ---------------------------------------------------------------------

# ASCII that is no letter counts as space
_LETTERS = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def _codes(data: bytes, tail: np.ndarray, space: bool) -> tuple[list[np.ndarray], np.ndarray, bool]:
    """Hashed byte n-grams, by order, that end in this piece of a lower-case
    text; ``tail`` are the last bytes kept before it, ``space`` whether the
    last was one (runs of spaces count once)."""
    b = _LETTERS[np.frombuffer(data, np.uint8)]
    new = b[np.concatenate(([not (space and b[0] == 32)], (b[1:] != 32) | (b[:-1] != 32)))].astype(np.uint32) if len(b) else b.astype(np.uint32)
    flow = np.concatenate([tail, new])
    code, out = flow, []
    for order in ORDERS:
        if order > 1:
            code = code[:-1] * np.uint32(257) + flow[order - 1:]
        salted = code ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)
        hashed = (salted * np.uint32(0x85EBCA6B)) >> np.uint32(32 - HASH_BITS)
        out.append(hashed[max(0, len(tail) - order + 1):])
    return out, flow[len(flow) - min(len(flow), ORDERS[-1] - 1):], bool(b[-1] == 32) if len(b) else space


def _pieces(data: bytes):
    """The n-grams of a text of any length, CHUNK_BYTES at a time."""
    tail, space = np.zeros(0, np.uint32), False
    for at in range(0, len(data) + 2, CHUNK_BYTES):
        # a space before and behind the text
        part = (b" " if at == 0 else b"") + data[max(0, at - 1):at + CHUNK_BYTES - 1]
        if at + CHUNK_BYTES >= len(data) + 2:
            part += b" "
        codes, tail, space = _codes(part, tail, space)
        yield np.concatenate(codes)


def _grams(data: bytes) -> np.ndarray:
    return np.concatenate(list(_pieces(data)))


def _vector(data: bytes) -> tuple[np.ndarray, np.ndarray, float]:
    """N-grams of a text of any length, their counts as a vector of length 1,
    and the factor that makes its products margins (see :func:`predict_bytes`)."""
    if len(data) <= CHUNK_BYTES:
        index, count = np.unique(_grams(data), return_counts=True)
    else:
        whole = np.zeros(1 << HASH_BITS, np.int64)
        for codes in _pieces(data):
            whole += np.bincount(codes, minlength=1 << HASH_BITS)
        index = np.flatnonzero(whole)
        count = whole[index]
    size = np.sqrt((count.astype(float) ** 2).sum())
    return index.astype(np.uint32), (count / size).astype(np.float32), float(size / np.sqrt(count.sum()))


# -- fitting ----------------------------------------------------------------------

@dataclass
class Model:
    """Columns of ``weights``: the machines of ``families`` in order, then those of ``pairs``."""
    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    slopes: np.ndarray
    #: texts whose mean margin, with REACH x spread for its length, stays under the floor are of no learned language
    floor: float = -np.inf
    spread: float = 0.0


def _machine(vectors: list, signs: np.ndarray, rng: np.random.Generator, epochs: int) -> np.ndarray:
    """Averaged sub-gradient descent on the hinge loss, without bias."""
    w, late = np.zeros(1 << HASH_BITS, np.float32), np.zeros(1 << HASH_BITS, np.float32)
    scale, step = 1.0, 0
    for _ in range(epochs):
        for k in rng.permutation(len(vectors)):
            index, value, _ = vectors[k]
            scale *= 1 - STEP * SHRINK
            step += 1
            if signs[k] * scale * float(w[index] @ value) < 1:
                add = (STEP / scale * signs[k]) * value
                w[index] += add
                late[index] += add * np.float32(step - 1)  # the steps before which it did not count
    return (w - late / np.float32(max(step, 1))) * np.float32(scale)


def _snippets(text: bytes, rng: np.random.Generator) -> list[bytes]:
    """The text and pieces of it, cut at spaces, as short texts occur too."""
    out = [text]
    for size in SNIPPETS:
        if len(text) > 2 * size:
            at = int(rng.integers(0, len(text) - size))
            piece = text[at:at + size].split(b" ")
            out.append(b" ".join(piece[1:-1] or piece))
    return out


def _untrained(languages: list[str]) -> Model:
    """The machines that separate these languages, in order, without weights."""
    families = sorted({family_of(x) for x in languages})
    pairs = [(a, b) for f in families for a, b in combinations([x for x in languages if family_of(x) == f], 2)]
    number = (len(families) if len(families) > 1 else 0) + len(pairs)
    return Model(languages, families, pairs, np.zeros((1 << HASH_BITS, number), np.float32), np.ones(number))


def _fit_group(rows: list[tuple[str, str]], shape: Model, seed: int, epochs: int):
    """For each machine of ``shape`` (weights, median of the correct margins,
    number of pieces on the smaller side) from the rows of one group."""
    rng = np.random.default_rng(seed)
    vectors, langs = [], []
    for text, lang in sorted(rows):
        for piece in _snippets(text.encode(), rng):
            if piece.strip():
                vectors.append(_vector(piece))
                langs.append(lang)
    langs = np.array(langs)
    kind = np.array([family_of(x) for x in langs])
    tasks = [(np.arange(len(langs)), kind == f) for f in shape.families] if len(shape.families) > 1 else []
    for a, b in shape.pairs:
        rows_of = np.flatnonzero((langs == a) | (langs == b))
        tasks.append((rows_of, langs[rows_of] == a))
    for rows_of, first in tasks:
        signs, own = np.where(first, 1.0, -1.0), [vectors[i] for i in rows_of]
        w = _machine(own, signs, rng, epochs)
        z = [sign * ratio * float(w[index] @ value) for sign, (index, value, ratio) in zip(signs, own)]
        yield w, float(np.median(z)) if z else 0.0, int(min(first.sum(), (~first).sum()))


#: weight of a group that has rows on one side of a machine only; it counts where no group has both
ONE_SIDED = 1e-6


def _finished(shape: Model, weights: np.ndarray, margins: np.ndarray) -> Model:
    # slope of the logistic curve: half of the correct margins lie above 95 %
    return replace(shape, weights=weights.astype(np.float32), slopes=3.0 / np.maximum(margins, 1e-6))


def fit_rows(rows: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit on (text, language) rows, a single group; texts are lower case."""
    shape = _untrained(sorted({lang for text, lang in rows if text.strip()}))
    fitted = list(_fit_group(rows, shape, seed, EPOCHS))
    weights = np.stack([w for w, _, _ in fitted], axis=1) if fitted else shape.weights
    return _finished(shape, weights, np.array([m for _, m, _ in fitted]))


def _fit_groups(shape: Model, seed: int, epochs: int):
    """Over the rows (bucket, t, l) of a partition in order of the bucket: sums
    of the weighted machines of its groups, SLICE weights a row."""
    machines = shape.weights.shape[1]
    shape = replace(shape, weights=np.zeros((0, machines), np.float32))  # only the names travel

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, total, margins = np.zeros((machines, 1 << HASH_BITS)), np.zeros(machines), np.zeros(machines)

        def take(bucket: int, rows: list[tuple[str, str]]) -> None:
            for k, (w, margin, small) in enumerate(_fit_group(rows, shape, seed + bucket, epochs)):
                share = max(float(small), ONE_SIDED)
                sums[k] += share * w
                total[k] += share
                margins[k] += share * margin

        current, rows = None, []
        for batch in batches:
            for bucket, text, lang in zip(batch["bucket"].tolist(), batch["t"], batch["l"]):
                if bucket != current and rows:
                    take(current, rows)
                    rows = []
                current = bucket
                rows.append((text, lang))
        if rows:
            take(current, rows)
        for k in np.flatnonzero(total):
            yield pd.DataFrame([(int(k), at, sums[k, at:at + SLICE].astype(np.float32).tobytes(), total[k], margins[k])
                                for at in range(0, 1 << HASH_BITS, SLICE)], columns=["machine", "at", "part", "total", "margin"])

    return learn


PARTS = "machine int, at int, part binary, total double, margin double"


def _mean_part(parts: pd.DataFrame) -> pd.DataFrame:
    """The mean of one slice of a machine over the tasks that fitted it."""
    parts = parts.sort_values(["total", "margin"])
    total = float(parts["total"].sum())
    mean = sum(np.frombuffer(x, np.float32).astype(float) for x in parts["part"]) / total
    return pd.DataFrame({"machine": parts["machine"].iloc[:1].tolist(), "at": parts["at"].iloc[:1].tolist(),
                         "part": [mean.astype(np.float32).tobytes()], "total": [total], "margin": [float(parts["margin"].sum()) / total]})


def _labelled(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(t, l) and what else ``docs`` has: lower-case texts with a letter and a label."""
    rows = docs.withColumn("t", F.lower(F.col(text_col))).withColumn("l", F.col(lang_col))
    return rows.where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str | None = None, seed: int = 7) -> Model:
    """Fit on every row with a text that has a letter and a label, texts whole.

    Rows are dealt by a seeded hash of id and text over groups of about
    GROUP_BYTES, fitted apart; a machine is the mean of those of the groups,
    weighted by the number of pieces on its smaller side, and so is the median
    margin behind its slope. Only the means come to the driver: 2**HASH_BITS
    weights for each machine, whatever the size of the table."""
    keys = [F.col(c) for c in (id_col, text_col) if c]
    used = docs.select(*{c: F.col(c) for c in (id_col, text_col, lang_col) if c}.values())
    rows = _labelled(used, text_col, lang_col)
    sizes = {r["l"]: r["size"] for r in rows.groupBy("l").agg(F.sum(F.octet_length("t")).alias("size")).collect()}
    shape = _untrained(sorted(sizes))
    if not shape.weights.shape[1]:
        return shape
    groups = math.ceil(sum(sizes.values()) / GROUP_BYTES)
    tasks = min(groups, max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(groups / TASK_GROUPS)))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(groups)).cast("int")
    dealt = rows.select(bucket.alias("bucket"), "t", "l").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    parts = dealt.mapInPandas(_fit_groups(shape, seed, max(1, EPOCHS // groups)), PARTS)
    weights, margins = shape.weights.copy(), np.zeros(shape.weights.shape[1])
    for r in parts.groupBy("machine", "at").applyInPandas(_mean_part, PARTS).collect():
        weights[r["at"]:r["at"] + SLICE, r["machine"]] = np.frombuffer(r["part"], np.float32)
        margins[r["machine"]] = r["margin"]
    return _finished(shape, weights, margins)


def calibrate(model: Model, docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Set the floor from all rows of ``docs``, which the model has not learned
    from: half of what the least sure of them reaches, so clean texts stay far
    above it."""
    if len(model.families) < 2:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: pa.Array) -> pa.Array:
        whole = texts.cast(pa.large_binary())
        got = [_mean_margin(whole[i].as_py(), shared.value) for i in range(len(whole))]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.int64())],
                                          ["mean", "number"])

    rows = _labelled(docs.select(*{c: F.col(c) for c in (text_col, lang_col)}.values()), text_col, lang_col)
    rows = rows.where(F.col("l").isin(model.languages))
    found = materialize(rows.select(F.arrow_udf(of, "struct<mean:double,number:bigint>")("t").alias("m")).select("m.*"), "margins")
    middle = found.agg(F.percentile_approx("mean", 0.5, 100_000)).first()[0]
    if middle is None:
        return model
    spread = found.agg(F.stddev_pop((F.col("mean") - middle) * F.sqrt("number"))).first()[0]
    least = found.agg(F.min(F.col("mean") + REACH * spread / F.sqrt("number"))).first()[0]
    return replace(model, spread=spread, floor=least / 2)


def _mean_margin(text: bytes, model: Model) -> tuple[float, int]:
    """Mean margin by n-gram of the machine of the likeliest family."""
    families = len(model.families)
    total, number = np.zeros(families), 0
    for codes in _pieces(text):
        total += model.weights[codes, :families].sum(axis=0, dtype=np.float64)
        number += len(codes)
    return float(total[np.argmax(model.slopes[:families] * total)]) / number, number


# -- prediction ---------------------------------------------------------------------

def predict_bytes(text: bytes, model: Model) -> tuple[str, float, bool]:
    """Language and score of one lower-case text, and whether it may be of a learned language."""
    if not model.languages:
        return UNKNOWN, 0.0, False
    total, number = np.zeros(model.weights.shape[1]), 0
    for codes in _pieces(text):
        total += model.weights[codes].sum(axis=0, dtype=np.float64)
        number += len(codes)
    likely = 1 / (1 + np.exp(-np.clip(model.slopes * total / np.sqrt(number), -40, 40)))
    first, many = 0, len(model.families)
    if many > 1:
        k = int(np.argmax(likely[:many]))
        sure, first = float(likely[k] / likely[:many].sum()), many
        family = model.families[k]
        known = bool(total[k] / number + REACH * model.spread / np.sqrt(number) >= model.floor)
    else:
        sure, family, known = 1.0, model.families[0], True
    members = [x for x in model.languages if family_of(x) == family]
    votes = {x: [0, 0.0] for x in members}
    for (a, b), p in zip(model.pairs, likely[first:].tolist()):
        if a in votes:
            votes[a if p >= 0.5 else b][0] += 1
            votes[a][1] += p
            votes[b][1] += 1 - p
    best = min(members, key=lambda x: (-votes[x][0], -votes[x][1], x))
    inside = votes[best][1] / (len(members) - 1) if len(members) > 1 else 1.0
    return best, sure * inside, known


def predict(text: Column, model: Model, spark) -> Column:
    """Struct (lang, score, known) for a text column. The broadcast holds
    2**HASH_BITS floats for each machine, whatever the size of the input."""
    shared = spark.sparkContext.broadcast(model)

    def of(texts: pa.Array) -> pa.Array:
        found = shared.value
        whole = texts.cast(pa.large_binary())
        out = [predict_bytes(whole[i].as_py(), found) if whole[i].is_valid else (UNKNOWN, 0.0, False) for i in range(len(whole))]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()),
                                           pa.array([x[2] for x in out], pa.bool_())], ["lang", "score", "known"])

    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("known"))
    scored = F.arrow_udf(of, "struct<lang:string,score:double,known:boolean>")(F.when(letters, F.lower(text)))
    return F.when(letters, scored).otherwise(unknown)


def held_out(id_col: str) -> Column:
    """Rows kept from the fit: crc32 of the id's text is divisible by 5 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
               calibrated: bool = False) -> Model:
    """Fit on all rows that are not held out; ``calibrated`` sets the floor from all that are."""
    rows = docs.where(F.col(id_col).isNotNull())
    model = fit(rows.where(~held_out(id_col)), text_col, lang_col, id_col)
    return calibrate(model, rows.where(held_out(id_col)), text_col, lang_col) if calibrated else model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score, known): ``row`` holds the columns of ``docs``."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    got = packed.withColumn("p", predict(F.col(f"row.`{text_col}`"), model, docs.sparkSession))
    return got.select("row", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.known").alias("known"))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", wanted: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` whose text is of a learned language, and of one of the
    ``wanted`` if given. A text without a letter goes, and so does one whose
    margins, even allowing for its length, are under the model's floor."""
    found = identify(docs, model, text_col).where(F.col("known") & (F.col("lang_pred") != UNKNOWN))
    if wanted is not None:
        found = found.where(F.col("lang_pred").isin(wanted))
    return found.select("row.*")
