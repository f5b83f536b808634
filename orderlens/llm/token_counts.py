"""Word-piece counts by a longest-match automaton, without building pieces.

The vocabulary is a trie over bytes, and the end-of-word mark of its pieces is a
symbol of its own that follows the last byte of each word; so a final piece only
matches at the end of a word. Each node has a failure link and the number of
pieces that are final when the link is taken (LinMaxMatch, Song et al. 2021), so
a word of n bytes takes O(n) steps whatever the pieces are. A word that greedy
matching does not cover, its end included, counts as one unknown piece and one
in `n_unknown`; a tokenizer that merges pairs may still cut such a word.

Words are runs of word characters or of other visible characters of the
lower-case text. Counts of strings without white space are kept in a bounded
memory of each task; that changes no result.

Cases: null and empty texts have zero counts. Repeated rows are counted each.
Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\w+|[^\w\s]+")
_CACHE_WORDS = 200_000
END = 256  # the symbol after the last byte of a word
_END_MARK = "</w>"
_FIELD = 40  # bits of a count when several share an integer


class Automaton:
    def __init__(self, pieces: Iterable[Sequence[int]]):
        self.goto: dict[int, int] = {}
        final, parent = [False], [(0, 0)]
        for piece in pieces:
            at = 0
            for symbol in piece:
                edge = (at << 9) | symbol
                if edge not in self.goto:
                    self.goto[edge] = len(final)
                    final.append(False)
                    parent.append((at, symbol))
                at = self.goto[edge]
            final[at] = at > 0
        self.link = [-1] * len(final)
        self.popped = [0] * len(final)
        below: list[list[int]] = [[] for _ in final]
        for node, (up, _) in enumerate(parent[1:], 1):
            below[up].append(node)
        todo = deque(below[0])
        while todo:
            node = todo.popleft()
            todo.extend(below[node])
            if final[node]:
                self.link[node], self.popped[node] = 0, 1
                continue
            up, symbol = parent[node]
            at, count = self.link[up], self.popped[up]
            while at >= 0 and (at << 9) | symbol not in self.goto:
                at, count = self.link[at], count + self.popped[at]
            if at >= 0:
                self.link[node], self.popped[node] = self.goto[(at << 9) | symbol], count

    def count(self, word: Sequence[int]) -> int:
        """Pieces of a word (bytes, and END if pieces hold it), or -1 if greedy matching gets stuck."""
        at, pieces, goto = 0, 0, self.goto
        for symbol in word:
            while (edge := (at << 9) | symbol) not in goto:
                pieces += self.popped[at]
                at = self.link[at]
                if at < 0:
                    return -1
            at = goto[edge]
        while at > 0:
            pieces += self.popped[at]
            at = self.link[at]
        return pieces if at == 0 else -1


def _byte_names() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in shown}
    return names | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}


def vocabulary(path: str) -> set[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary file as bytes, followed by END where they close a word."""
    names = _byte_names()
    with open(path, encoding="utf-8") as file:
        pieces = json.load(file)["model"]["vocab"]
    return {(*(names[c] for c in piece.removesuffix(_END_MARK)), *((END,) if piece.endswith(_END_MARK) else ())) for piece in pieces}


class _Counts(dict):
    """By string without white space: words, pieces and unknown words, in one integer."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, held: str) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        total = 0
        for word in _WORD.findall(held):
            n = self.automaton.count((*word.encode(), END))
            total += 1 + (max(n, 1) << _FIELD) + ((n < 0) << (2 * _FIELD))
        self[held] = total
        return total


@lru_cache(maxsize=1)
def _counts(path: str) -> _Counts:
    return _Counts(Automaton(sorted(vocabulary(path))))


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, low = _counts(path).__getitem__, (1 << _FIELD) - 1
        for batch in batches:
            found = [sum(map(known, (text.as_py() or "").lower().split())) for text in batch.column(1)]
            counts = [pa.array([(x >> (k * _FIELD)) & low for x in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts], names=["doc_id", "n_words", "n_pieces", "n_unknown"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_pieces, n_unknown."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count_batches(vocabulary_path), "doc_id long, n_words long, n_pieces long, n_unknown long")
