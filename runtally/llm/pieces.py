"""Token counts: greedy longest-match word pieces by a linear automaton.

The trie of the vocabulary gets a failure link and a count of popped tokens per node, so a
word is read once from left to right: when no child fits, the node's finished tokens are
counted and its link is followed to what is left of the word. Pieces are never built.

A word is a stretch between white space, led by the word mark of the vocabulary. A character
outside the vocabulary counts as many tokens as it has UTF-8 bytes (byte fallback).

Defined results: null, empty and blank texts have no words and no tokens; repeated rows are
counted each; existing ``n_words`` and ``n_tokens`` columns are replaced, all others carried
along; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
#: Distinct short words remembered per Python worker.
REMEMBERED, SHORT = 1 << 18, 64


def load(path: str) -> tuple[str, ...]:
    """The pieces of a vocabulary file, without control, unknown and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    real = (k for k in range(len(model)) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    return tuple(model.id_to_piece(k) for k in real)


class Automaton:
    """Node 0 is the root; ``link`` and ``popped`` say what happens where no child fits."""

    def __init__(self, pieces: Iterable[str]):
        pieces = set(pieces)
        self.child: list[dict[str, int]] = [{}]
        weight = [0]  # tokens if the node ends the word there: 0 for no piece
        # Single characters always end somewhere: as a piece or as their bytes.
        for piece in sorted(pieces | {c for p in pieces for c in p}):
            node = 0
            for c in piece:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    weight.append(0)
                node = self.child[node][c]
            weight[node] = 1 if piece in pieces else len(piece.encode())
        self.link, self.popped = [0] * len(weight), [0] * len(weight)
        queue = deque((0, c, node) for c, node in self.child[0].items())
        while queue:
            parent, c, node = queue.popleft()
            if weight[node]:
                self.popped[node] = weight[node]
            else:
                # what the parent would pop, then on until the character fits
                count, at = self.popped[parent], self.link[parent]
                while c not in self.child[at]:
                    count += self.popped[at]
                    at = self.link[at]
                self.popped[node], self.link[node] = count, self.child[at][c]
            queue += ((node, d, n) for d, n in self.child[node].items())

    def length(self, word: str) -> int:
        child, link, popped = self.child, self.link, self.popped
        count = node = 0
        for c in word:
            while (after := child[node].get(c)) is None and node:
                count += popped[node]
                node = link[node]
            if after is None:
                count += len(c.encode())
            else:
                node = after
        while node:
            count += popped[node]
            node = link[node]
        return count


class Lengths(dict):
    """Tokens of a word; short words are remembered, all are forgotten when there are too many."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.length(MARK + word)
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


@functools.lru_cache(maxsize=2)
def _lengths(pieces: tuple[str, ...]) -> Lengths:
    return Lengths(Automaton(pieces))


def token_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``n_words`` and ``n_tokens``; the vocabulary of ``path`` is broadcast."""
    pieces = df.sparkSession.sparkContext.broadcast(load(path))
    added = T.StructType().add("n_words", "long").add("n_tokens", "long")
    kept = [c for c in df.columns if c not in added.names]

    def work(batches):
        lengths = _lengths(pieces.value)
        for batch in batches:
            names = batch.schema.names
            words = [(x.as_py() or "").split() for x in batch.column(names.index(text))]
            tokens = [sum(map(lengths.__getitem__, w)) for w in words]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(names.index(c)) for c in kept),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array(tokens, pa.int64()),
                ],
                names=[*kept, *added.names],
            )

    return df.mapInArrow(work, T.StructType([*(df.schema[c] for c in kept), *added.fields]))
