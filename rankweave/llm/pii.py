"""Personal data: keyed surrogates for detected entities.

E-mail addresses, phone and card numbers, IP addresses, social security
numbers, IBANs, hexadecimal secrets and names (behind a title, or led by a
known given name) are cut into units: the local part and the domain of an
address, the digits of a number, each part of a name. A unit is replaced by a
surrogate drawn from a keyed hash of its kind and normal form, so equal units
are replaced alike in every document and layout (coreference). Surrogates keep
kind, script, gender of a given name, letter case, layout, country and network
digits, top-level domain and a valid Luhn sum. Numbers of card length without
that sum, and dotted numbers behind "version", are left alone.

The gender of a given name is that of the title or of the known name in front;
behind a neutral title, that of the known name that follows. It is settled
once for the corpus, so a given name has one surrogate whatever stands before
it: the one gender that it is seen with, else that of the known names, else
neutral.

Distinctness is checked over the whole corpus: of units of a kind with the
same surrogate, or with one that is a unit of the corpus, all but one draw
again until none collides; where short phone numbers leave no room, later
surrogates are longer. Only those that drew again, or whose gender is not
the one of the place they stand in, are kept in a table.

Built from DataFrame functions. Nulls and ties: a null text stays null with 0
entities; the result for a text depends on the text and the corpus only, so
repeated rows are rewritten alike; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

DRAWS = 200
#: draws after which the surrogate of a phone number grows
LONGER = 8

# Titles by gender, given names by gender, syllables by script, endings of given names.
TITLES = {
    "f": "Mrs Ms Miss Frau Señora Sra Señorita Madame Mme Mademoiselle Signora г-жа Госпожа Κυρία",
    "m": "Mr Mister Herr Señor Sr Monsieur Signor г-н Господин Κύριος",
    "u": "Dr Prof Professor Doctor",
}
GIVEN = {
    "f": "Anna Maria Laura Julia Sophie Emma Sarah Marie Claire Camille Lucia Carmen Elena Isabel Katrin Ursula Mary Alice",
    "m": "John Peter Thomas Michael David James Robert Hans Jürgen Stefan Pierre Jean Michel Carlos José Miguel Pablo Luis",
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no ra re",
    "cyrillic": "ба бе би бо да де ди до фа фе фи фо га ге ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре",
    "greek": "βα βε βι βο δα δε δι δο φα φε φι φο γα γε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε",
    "han": "王 李 张 刘 陈 杨 黄 赵 吴 周 徐 孙 马 朱 胡 郭 何 高 林 罗 郑 梁 谢 宋 唐 许 韩 冯 邓 曹 彭 曾",
}
ENDINGS = {
    "latin": {"f": "na ria lina elle", "m": "n ro lan bert", "u": "m ris lex kim"},
    "cyrillic": {"f": "на рия лина ева", "m": "н ров лан дим", "u": "м рис лекс ким"},
    "greek": {"f": "να ρία λίνα εια", "m": "ς ρος λας νης", "u": "μ ρις λεξ κιμ"},
    "han": {"f": "芳 娜 丽 静", "m": "伟 强 军 勇", "u": "文 明 华 平"},
}
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "han": r"\p{IsHan}"}

_WORD = r"\p{Lu}[\p{L}'’-]{1,40}|\p{IsHan}{1,4}"
_NAME_TAIL = rf"(?:{_WORD})(?: (?:{_WORD})){{0,2}}"
_ALL_TITLES = "|".join(t for g in TITLES.values() for t in g.split())
_ALL_GIVEN = "|".join(t for g in GIVEN.values() for t in g.split())
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: patterns by kind, in order of preference where they overlap; every run in them is bounded
PATTERNS = {
    "email": r"(?<![\p{L}\d._%+-])[\p{L}\d._%+-]{1,64}@[\p{L}\d-]{1,63}(?:\.[\p{L}\d-]{1,63}){0,8}\.\p{L}{2,24}",
    "secret": r"(?<![\p{L}\d])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![\p{L}\d])",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){3,7}(?: ?[A-Z\d]{1,3})?(?![\p{L}\d])",
    "ip": rf"(?<![\d.])(?<![vV]ersion )(?<![vV]er\. )(?<![vV])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\p{L}\d.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\p{L}\d])",
    "phone": (r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
              r"|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"),
    "name": rf"(?<!\p{{L}})(?:(?:{_ALL_TITLES})\.? {_NAME_TAIL}|(?:{_ALL_GIVEN}) (?:{_WORD})(?: (?:{_WORD}))?)",
}
ANY = "|".join(PATTERNS.values())
#: every entity has a digit, an at sign, a title or a known given name
HINT = rf"[\d@]|(?<!\p{{L}})(?:{_ALL_TITLES}|{_ALL_GIVEN})|[0-9a-fA-F]{{32}}"


# -- units ---------------------------------------------------------------------------

def _full(pattern: str) -> str:
    return rf"^(?:{pattern})$"


def _words(text: str) -> str:
    return rf"^(?:{'|'.join(text.split())})$"


def _part(kind, raw: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), raw.alias("raw"))


def parts_of(match: Column) -> Column:
    """Units of an entity in order, as structs (kind, raw); ``keep`` and the
    text between units stay."""
    at = F.instr(match, F.lit("@"))
    email = F.array(_part("local", F.substring(match, F.lit(1), at - 1)), _part("keep", F.lit("@")),
                    _part("domain", F.substring(match, at + 1, F.length(match))))
    words = F.split(match, " ")
    bare = F.regexp_replace(words[0], r"\.$", "")
    title = bare.rlike(_words(_ALL_TITLES.replace("|", " ")))
    leads = F.when(bare.rlike(_words(TITLES["u"])), F.coalesce(F.get(words, F.lit(1)), F.lit(""))).otherwise(bare)
    gender = (F.when(leads.rlike(_words(f"{TITLES['f']} {GIVEN['f']}")), "f")
              .when(leads.rlike(_words(f"{TITLES['m']} {GIVEN['m']}")), "m").otherwise("u"))
    last = F.size(words) - 1
    name = F.flatten(F.transform(words, lambda w, i: F.when(i == 0, F.array(F.when(title, _part("keep", w)).otherwise(
        _part(F.concat(F.lit("given_"), gender), w)))).otherwise(F.array(
            _part("keep", F.lit(" ")), F.when(i == last, _part("family", w)).otherwise(
                _part(F.concat(F.lit("given_"), gender), w))))))
    out = F.when(match.rlike(_full(PATTERNS["email"])), email)
    # a long number without a valid sum is no card, and stays
    card = F.when(_luhn(F.regexp_replace(match, r"\D", "")) % 10 == 0, "card").otherwise("keep")
    for kind in ("secret", "iban", "ip", "ssn", "card", "phone"):
        found = _part(card if kind == "card" else kind, match)
        out = out.when(match.rlike(_full(PATTERNS[kind])), F.array(found))
    return out.otherwise(name)


def normal(kind: Column, raw: Column) -> Column:
    """Normal form of a unit: digits of a number, lower case, no spaces."""
    return (F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(raw, r"\D", ""))
            .when(kind == "iban", F.regexp_replace(raw, " ", "")).otherwise(F.lower(raw)))


# -- surrogates ----------------------------------------------------------------------

def _byte(hashed: Column, i) -> Column:
    """Byte i (from 0) of a 64-byte hash in hex, round and round."""
    return F.conv(F.substring(hashed, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _draw(chars: Column, hashed: Column) -> Column:
    """Characters replaced within their class: digits, a-z, A-Z; others stay."""
    def one(c, i):
        b = _byte(hashed, i)
        return (F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), F.char(b % 26 + 97))
                .when(c.rlike("[A-Z]"), F.char(b % 26 + 65)).when(c.rlike(r"\p{L}"), F.char(b % 26 + 97)).otherwise(c))
    return F.array_join(F.transform(chars, one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string."""
    def value(d, i):
        d = d.cast("int")
        return F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda s, x: s + x)


def _name(kind: Column, unit: Column, hashed: Column, attempt: Column) -> Column:
    """A name made of syllables of the unit's script; a given name ends as
    names of its gender do. Later draws are longer."""
    words = lambda text: F.array(*[F.lit(w) for w in text.split()])
    tables = {k: F.struct(words(SYLLABLES[k]).alias("syllables"), words(ENDINGS[k]["f"]).alias("f"), words(ENDINGS[k]["m"]).alias("m"),
                          words(ENDINGS[k]["u"]).alias("u"), F.lit(0 if k == "han" else 1).alias("more")) for k in SYLLABLES}
    table = F.when(unit.rlike(SCRIPTS["cyrillic"]), tables["cyrillic"])
    for script in ("greek", "han"):
        table = table.when(unit.rlike(SCRIPTS[script]), tables[script])

    def made(t):
        syllable = lambda i: F.element_at(t["syllables"], _byte(hashed, i) % 32 + 1)
        body = F.array_join(F.transform(F.sequence(F.lit(0), t["more"] + F.floor(attempt / 3).cast("int")), syllable), "")
        pick = _byte(hashed, F.lit(40)) % 4 + 1
        end = (F.when(kind == "given_f", F.element_at(t["f"], pick)).when(kind == "given_m", F.element_at(t["m"], pick))
               .when(kind == "given_u", F.element_at(t["u"], pick)).otherwise(syllable(F.lit(41))))
        return F.concat(body, end)

    return _let(table.otherwise(tables["latin"]), made)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once and named once in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def surrogate(kind: Column, unit: Column, attempt: Column, key: str) -> Column:
    """Surrogate of a unit in normal form at a draw."""
    hashed = F.sha2(F.concat_ws("|", F.lit(key), kind, unit, attempt.cast("string")), 512)
    state = F.struct(kind.alias("kind"), unit.alias("unit"), attempt.alias("attempt"), hashed.alias("hashed"))
    return _let(state, lambda s: _let(_draw(F.split(s["unit"], ""), s["hashed"]), lambda drawn: _surrogate(
        s["kind"], s["unit"], s["attempt"], s["hashed"], drawn)))


def _surrogate(kind: Column, unit: Column, attempt: Column, hashed: Column, drawn: Column) -> Column:
    n = F.length(unit)
    first = (_byte(hashed, F.lit(63)) % 9 + 1).cast("string")
    more = F.substring(F.translate(F.sha2(hashed, 256), "0123456789", "ghijklmnop"), F.lit(1), F.greatest(F.lit(0), attempt - 2))
    # short numbers run out: later draws are longer by a digit or more
    longer = F.substring(F.translate(F.sha2(hashed, 256), "abcdef", "012345"), F.lit(1),
                         F.greatest(F.lit(0), F.floor((attempt - LONGER) / 4).cast("int") + 1))
    country = F.when(unit.rlike("^[17]"), 1).otherwise(2)
    phone = F.when(n > 10, F.concat(F.substring(unit, F.lit(1), country), first, F.substring(drawn, country + 2, n))).otherwise(
        F.concat(first, F.substring(drawn, F.lit(2), n)))
    phone = F.concat(phone, longer)
    body = F.concat(F.substring(unit, F.lit(1), F.lit(1)), F.substring(drawn, F.lit(2), n - 2))
    check = ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.concat(body, F.when(_luhn(unit) % 10 == 0, check).otherwise(F.substring(drawn, n, F.lit(1))))
    octets = [F.when(unit.startswith("10."), F.lit("10")).otherwise((_byte(hashed, F.lit(0)) % 222 + 1).cast("string"))]
    octets += [_byte(hashed, F.lit(i)).cast("string") for i in (1, 2, 3)]
    hexes = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(hashed, i % 128 + 1, F.lit(1))), "")
    top = F.element_at(F.split(unit, r"\."), -1)
    domain = F.concat(more, F.substring(drawn, F.lit(1), n - F.length(top)), top)
    iban = F.concat(F.substring(unit, F.lit(1), F.lit(2)), F.substring(drawn, F.lit(3), n))
    return (F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", F.concat(first, F.substring(drawn, F.lit(2), n)))
            .when(kind == "ip", F.concat_ws(".", *octets)).when(kind == "secret", hexes).when(kind == "iban", iban)
            .when(kind == "local", F.concat(drawn, more)).when(kind == "domain", domain)
            .otherwise(_name(kind, unit, hashed, attempt)))


def _filled(raw: Column, drawn: Column) -> Column:
    """``drawn`` in the layout and case of ``raw``: its characters replace the
    letters and digits in order; what is left over comes at the end."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    def step(state, c):
        d = F.substring(drawn, state["k"], F.lit(1))
        return F.when(c.rlike(r"[\p{L}\d]"), F.struct(
            F.concat(state["out"], F.when(c.rlike(r"\p{Lu}"), F.upper(d)).otherwise(d)).alias("out"), (state["k"] + 1).alias("k"))
        ).otherwise(F.struct(F.concat(state["out"], c).alias("out"), state["k"].alias("k")))
    return F.aggregate(F.split(raw, ""), start, step, lambda s: F.concat(s["out"], F.substring(drawn, s["k"], F.length(drawn))))


def _rendered(kind: Column, raw: Column, drawn: Column) -> Column:
    upper = (raw == F.upper(raw)) & (raw != F.lower(raw))
    title = raw.rlike(r"^\p{Lu}")
    cased = F.when(upper & (F.length(raw) > 1), F.upper(drawn)).when(title, F.initcap(drawn)).otherwise(drawn)
    return (F.when(kind.isin("phone", "card", "ssn", "iban", "secret"), _filled(raw, drawn))
            .when(kind == "ip", drawn).otherwise(cased))


# -- corpus --------------------------------------------------------------------------

def matches(text: Column) -> Column:
    """Entities of a text in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def drawn_again(units: DataFrame, key: str) -> DataFrame:
    """(kind, unit, attempt) of those units (kind, unit; distinct, stored)
    whose first surrogate would collide."""
    first = surrogate(F.col("kind"), F.col("unit"), F.lit(0), key)
    state = units.select("kind", "unit", F.lit(0).alias("attempt"), first.alias("new"))
    state = materialize(state, "pii-draws")
    for _ in range(DRAWS):
        owner = F.min(F.struct("attempt", "unit")).alias("owner")
        crowded = state.groupBy("kind", "new").agg(owner, F.count("*").alias("n")).where("n > 1")
        clash = state.join(crowded, ["kind", "new"]).where("unit != owner.unit").select("kind", "unit")
        real = state.join(units.select("kind", F.col("unit").alias("new")), ["kind", "new"], "left_semi").select("kind", "unit")
        lost = materialize(clash.union(real).distinct(), "pii-clashes")
        if lost.isEmpty():
            return state.where("attempt > 0").select("kind", "unit", "attempt")
        # the next draw has a name of its own: an alias equal to a column would be read instead of it inside a lambda
        redo = state.join(lost.withColumn("again", F.lit(1)), ["kind", "unit"], "left").withColumn(
            "draw", F.col("attempt") + F.coalesce("again", F.lit(0)))
        drawn = F.when(F.col("again") == 1, surrogate(F.col("kind"), F.col("unit"), F.col("draw"), key))
        state = materialize(redo.select("kind", "unit", F.col("draw").alias("attempt"), drawn.otherwise(F.col("new")).alias("new")),
                            "pii-draws")
    raise RuntimeError(f"units still share a surrogate after {DRAWS} draws")


def settled_kinds(units: DataFrame) -> DataFrame:
    """(kind, unit, settled) of those given names (kind, unit; distinct) whose
    kind in the corpus is another than where they stand."""
    seen = lambda kind: F.max(F.col("kind") == kind)
    known = (F.when(F.col("unit").rlike(_words(GIVEN["f"].lower())), "given_f")
             .when(F.col("unit").rlike(_words(GIVEN["m"].lower())), "given_m").otherwise("given_u"))
    one = (F.when(F.col("f") & ~F.col("m"), "given_f").when(F.col("m") & ~F.col("f"), "given_m").otherwise(known))
    given = units.where(F.col("kind").startswith("given_"))
    made = (given.groupBy("unit").agg(seen("given_f").alias("f"), seen("given_m").alias("m"))
            .select("unit", one.alias("settled")))
    return given.join(made, "unit").where("kind != settled").select("kind", "unit", "settled")


def _unit_key(kind: Column, unit: Column) -> Column:
    return F.concat_ws("|", kind, unit)


def replace_personal_data(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text with surrogates, n_entities."""
    text = F.col(text_col)
    hits = materialize(docs.select(F.xxhash64(text).alias("hash"), matches(text).alias("found"))
                       .where(F.size("found") > 0)
                       .select("hash", F.flatten(F.transform("found", lambda m: F.filter(
                           parts_of(m), lambda p: p["kind"] != "keep"))).alias("parts")), "pii-hits")
    unit = F.struct(F.col("p.kind").alias("kind"), normal(F.col("p.kind"), F.col("p.raw")).alias("unit"))
    exploded = hits.select("hash", F.explode("parts").alias("p")).select("hash", unit.alias("u")).select("hash", "u.*")
    stand = materialize(exploded.select("kind", "unit").distinct(), "pii-stand")
    settled = materialize(settled_kinds(stand), "pii-settled")
    placed = materialize(stand.join(settled, ["kind", "unit"], "left")
                         .select("kind", "unit", F.coalesce("settled", "kind").alias("settled")), "pii-placed")
    units = materialize(placed.select(F.col("settled").alias("kind"), "unit").distinct(), "pii-units")
    again = drawn_again(units, key).withColumnRenamed("kind", "settled")
    differs = (placed.join(again, ["settled", "unit"], "left").where((F.col("kind") != F.col("settled")) | F.col("attempt").isNotNull())
               .select("kind", "unit", F.struct("settled", F.coalesce("attempt", F.lit(0)).alias("attempt")).alias("draw")))
    named = F.struct(_unit_key(F.col("kind"), F.col("unit")).alias("key"), "draw")
    others = materialize(exploded.join(differs, ["kind", "unit"]).select("hash", named.alias("e")).distinct()
                         .groupBy("hash").agg(F.map_from_entries(F.collect_list("e")).alias("draws")), "pii-again")

    def replaced(match: Column) -> Column:
        def drawn(p, u):
            own = F.struct(p["kind"].alias("settled"), F.lit(0).alias("attempt"))
            found = F.coalesce(F.element_at(F.col("draws"), _unit_key(p["kind"], u)), own)
            return _let(found, lambda d: _let(surrogate(d["settled"], u, d["attempt"], key),
                                              lambda new: _rendered(p["kind"], p["raw"], new)))

        def one(p):
            return F.when(p["kind"] == "keep", p["raw"]).otherwise(_let(normal(p["kind"], p["raw"]), lambda u: drawn(p, u)))
        return F.array_join(F.transform(parts_of(match), one), "")

    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), matches(text).alias("found"), F.xxhash64(text).alias("hash"))
    joined = rows.join(others, "hash", "left")
    gaps = F.split("text", ANY, -1)
    new = F.concat(F.array_join(F.transform(F.arrays_zip(F.slice(gaps, 1, F.size("found")).alias("gap"), F.col("found").alias("m")),
                                            lambda z: F.concat(z["gap"], replaced(z["m"]))), ""), F.element_at(gaps, -1))
    return joined.select(F.col("id").alias(id_col), F.when(F.size("found") > 0, new).otherwise(F.col("text")).alias("text"),
                         F.size(F.filter("found", lambda m: F.exists(parts_of(m), lambda p: p["kind"] != "keep"))).alias("n_entities"))
