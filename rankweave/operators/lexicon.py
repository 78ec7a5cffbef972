"""A lexer for inflected Korean learned from the corpus.

Korean joins particles to words, so one noun has many written forms. Stems and
particles are told apart by statistics of all word forms of a corpus, summed by
Spark: a prefix is a stem if its syllables cling together (cohesion) and what
may follow it is open (branching entropy); a particle is an ending that many
different stems take. A stem that is a commoner stem and a particle is no stem
of its own. A form whose longest stem leaves a particle is indexed by the stem,
since particles tell no topics apart; other forms stay as they are.

Cohesion of a prefix of n syllables is (forms with it / forms with its first
syllable) ** (1 / (n - 1)), its entropy that of the next syllable, the end of
the form being one more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, clean_for_tokens, lexical_tokens, remove_urls
from ..session import store

HANGUL = "^[가-힣]{2,}$"
#: syllables of a prefix and of a particle, at most
PREFIX, ENDING = 10, 4
MIN_COUNT = 3
MIN_COHESION = 0.05
MIN_ENTROPY = 0.5
#: stems that must take an ending
MIN_STEMS = 4
#: entries of the model, most frequent first: what a task keeps in memory
MAX_STEMS, MAX_PARTICLES = 200_000, 1_000


def word_forms(texts: DataFrame, text_col: str, pattern: str = HANGUL) -> DataFrame:
    """(form, n): distinct tokens of all texts that match the pattern."""
    tokens = F.explode(lexical_tokens(remove_urls(clean_for_tokens(text_col)))).alias("form")
    return texts.select(tokens).where(F.col("form").rlike(pattern)).groupBy("form").agg(F.count(F.lit(1)).alias("n"))


def prefix_statistics(forms: DataFrame, longest: int = PREFIX) -> DataFrame:
    """(prefix, n, cohesion, entropy) of every prefix of the forms."""
    size = F.explode(F.sequence(F.lit(1), F.least(F.length("form"), F.lit(longest)))).alias("size")
    cut = forms.select("form", "n", size)
    follows = (cut.groupBy(F.substr("form", F.lit(1), F.col("size")).alias("prefix"),
                           F.substr("form", F.col("size") + 1, F.lit(1)).alias("next")).agg(F.sum("n").alias("m")))
    # sum of p ln(1/p) over m of n: ln n - sum(m ln m) / n
    by_prefix = follows.groupBy("prefix").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.ln("m")).alias("mlogm"))
    first = by_prefix.where(F.length("prefix") == 1).select(F.col("prefix").alias("first"), F.col("n").alias("n_first"))
    ratio = F.col("n") / F.col("n_first")
    return (by_prefix.join(first, F.substr("prefix", F.lit(1), F.lit(1)) == F.col("first"))
            .select("prefix", "n", F.when(F.length("prefix") == 1, 1.0)
                    .otherwise(F.pow(ratio, 1.0 / (F.length("prefix") - 1))).alias("cohesion"),
                    F.greatest(F.ln("n") - F.col("mlogm") / F.col("n"), F.lit(0.0)).alias("entropy")))


def stems_of(statistics: DataFrame) -> DataFrame:
    """Prefixes of two syllables and more that stand for themselves."""
    return statistics.where((F.length("prefix") >= 2) & (F.col("n") >= MIN_COUNT) & (F.col("cohesion") >= MIN_COHESION)
                            & (F.col("entropy") >= MIN_ENTROPY)).select(F.col("prefix").alias("stem"), "n")


def particles_of(forms: DataFrame, stems: DataFrame) -> DataFrame:
    """(particle, stems): endings that MIN_STEMS different stems take."""
    size = F.explode(F.sequence(F.greatest(F.lit(2), F.length("form") - ENDING), F.length("form") - 1)).alias("size")
    cuts = forms.where(F.length("form") >= 3).select("form", size)
    split = cuts.select(F.substr("form", F.lit(1), F.col("size")).alias("stem"), F.substr("form", F.col("size") + 1).alias("particle"))
    return (split.join(stems.select("stem"), "stem").groupBy("particle").agg(F.count_distinct("stem").alias("stems"))
            .where(F.col("stems") >= MIN_STEMS))


def plain_stems(stems: DataFrame, particles: DataFrame) -> DataFrame:
    """Stems without those that a commoner stem and a particle make up."""
    size = F.explode(F.sequence(F.greatest(F.lit(2), F.length("stem") - ENDING), F.length("stem") - 1)).alias("size")
    cuts = stems.where(F.length("stem") >= 3).select("stem", "n", size)
    split = cuts.select("stem", "n", F.substr("stem", F.lit(1), F.col("size")).alias("base"),
                        F.substr("stem", F.col("size") + 1).alias("particle"))
    bases = stems.select(F.col("stem").alias("base"), F.col("n").alias("n_base"))
    made = split.join(bases, "base").where(F.col("n_base") > F.col("n")).join(particles.select("particle"), "particle", "left_semi")
    return stems.join(made.select("stem").distinct(), "stem", "left_anti")


@dataclass
class Lexicon:
    """Stems and particles; at most MAX_STEMS and MAX_PARTICLES of them."""
    stems: frozenset
    particles: frozenset

    def stem(self, form: str) -> str:
        """The longest stem whose rest is a particle; the form itself if it is a stem or has none."""
        if form not in self.stems:
            for size in range(len(form) - 1, 1, -1):
                if form[:size] in self.stems and form[size:] in self.particles:
                    return form[:size]
        return form


def learn(texts: DataFrame, text_col: str = "text") -> Lexicon:
    """A lexicon from all texts. The driver gets the entries of the model only."""
    forms = store(word_forms(texts, text_col), "word-forms")
    found = store(stems_of(prefix_statistics(forms)), "all-stems")
    stems = store(plain_stems(found, particles_of(forms, found)), "stems")
    particles = particles_of(forms, stems)
    return Lexicon(
        frozenset(r["stem"] for r in stems.orderBy(F.col("n").desc(), "stem").limit(MAX_STEMS).collect()),
        frozenset(r["particle"] for r in particles.orderBy(F.col("stems").desc(), "particle").limit(MAX_PARTICLES).collect()))


def _offsets(lists: pa.ListArray) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32))


def lexer(lexicon: Lexicon, spark) -> Tokenizer:
    """For ``lexer=`` of the tokeniser, the index and the searches."""
    shared = spark.sparkContext.broadcast(lexicon)

    def of(lists: pa.Array) -> pa.Array:
        # each distinct token of a batch once
        coded = lists.flatten().dictionary_encode()
        stems = pa.array([shared.value.stem(t) for t in coded.dictionary.to_pylist()], pa.string())
        return pa.ListArray.from_arrays(_offsets(lists), stems.take(coded.indices))

    def apply(text: Column) -> Column:
        return F.arrow_udf(of, "array<string>")(lexical_tokens(text))

    return apply
