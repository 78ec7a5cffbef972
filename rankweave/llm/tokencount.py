"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the space mark in front. Distinct pre-tokens are
inserted in a trie; a node stands for a prefix and holds the forward score of
the prefix under a unigram model (the best segmentation, its number of
tokens), computed once from the nodes above it. A terminal's number of tokens
is stored with its pre-token, so a text is a sum of stored counts. Tries and
stored counts live in a task and are bounded (MAX_NODES, MAX_COUNTS): beyond
the bound they start anew, which changes the work and not the counts.

The vocabulary is a public one. Its pieces come in the order of their
merges, so the unigram score of a piece is taken from its rank by Zipf's law,
-log(rank + 1), less a constant; characters that no piece covers cost one
byte token for each byte, as the vocabulary's byte fallback does.

Nulls and ties: a null or empty text has 0 tokens; among segmentations of
equal score the one with fewer tokens counts. Rows are independent, so
repeated rows and empty tables need no care; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
#: score of a byte token, below that of any piece
BYTE_SCORE = -16.0
MAX_NODES = 1 << 18
MAX_COUNTS = 1 << 19
#: longer pre-tokens are scored without a place in the trie
MAX_DEPTH = 128
CHUNK_BYTES = 1 << 20


def load_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Unigram scores of the pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [i for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    order = sorted(pieces, key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -math.log(rank + 2) - 1.0 for rank, i in enumerate(order)}


class PrefixTrie:
    """Forward scores of prefixes."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        #: ends of pieces: a run that is none of them ends no piece, nor do longer ones
        self.ends = {piece[k:] for piece in scores for k in range(len(piece))}
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]

    def count(self, word: str) -> int:
        """Tokens of a pre-token; nodes it shares with earlier ones are reused."""
        node, end, score, tokens = 0, 0, [0.0], [0]
        walk, child, ends, piece_score = len(word) <= MAX_DEPTH, self.child, self.ends, self.scores.get
        for character in word:
            end += 1
            known = child.get((node, character)) if walk else None
            if known is None:
                size = 1 if character < "\x80" else len(character.encode())
                best, least = score[-1] + BYTE_SCORE * size, tokens[-1] + size
                start = end - 1
                while start >= 0 and (run := word[start:end]) in ends:
                    if (own := piece_score(run)) is not None:
                        s = score[start] + own
                        if s > best or s == best and tokens[start] + 1 < least:
                            best, least = s, tokens[start] + 1
                    start -= 1
                if walk:
                    known = child[node, character] = len(self.score)
                    self.score.append(best)
                    self.tokens.append(least)
            else:
                best, least = self.score[known], self.tokens[known]
            node = known
            score.append(best)
            tokens.append(least)
        if len(self.score) > MAX_NODES:
            self.clear()
        return tokens[-1]


class TerminalCounts(dict):
    """Tokens by word (bytes, without the space mark). Two generations are
    kept: when the younger is full it becomes the older one, and words met
    again move back, so common words are never scored anew."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.trie = PrefixTrie(scores)
        self.older: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.trie.count(SPACE_MARK + word.decode("utf-8", "replace"))
        if len(self) >= MAX_COUNTS // 2:
            self.older = dict(self)
            self.clear()
        if len(word) <= MAX_DEPTH:
            self[word] = n
        return n


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    at, space = 0, re.compile(rb"[\x20\x09-\x0d]")
    while at < len(data):
        cut = space.search(data, at + CHUNK_BYTES)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def count_text(data: bytes | None, counts: TerminalCounts) -> tuple[int, int]:
    """Pre-tokens and tokens of a text."""
    words = tokens = 0
    for piece in _pieces(data or b""):
        words += len(piece)
        tokens += sum(map(counts.__getitem__, piece))
    return words, tokens


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: id, n_words (pre-tokens) and n_tokens."""
    # as large as the vocabulary, whatever the size of the input
    scores = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))

    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = TerminalCounts(scores.value)
        for batch in texts:
            whole = batch.cast(pa.large_binary())
            pairs = [count_text(whole[i].as_py(), counts) for i in range(len(whole))]
            yield pa.StructArray.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                              pa.array([p[1] for p in pairs], pa.int64())], ["n_words", "n_tokens"])

    counted: Column = F.arrow_udf(of, "struct<n_words:long,n_tokens:long>")(F.col(text_col))
    return docs.select(F.col(id_col), counted.alias("c")).select(id_col, "c.n_words", "c.n_tokens")
