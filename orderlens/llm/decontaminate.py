"""Benchmark items that leak into training texts, found by n-gram seeds and Smith-Waterman alignment.

1. A score of s (MIN_SCORE of the item's n words, rounded up) means s more matches
   than errors. Matches fall into at most one run more than there are errors, so
   at least s - 1 word pairs of the item stand in order in the text, within
   2n - s words. Where s is 1, one word of the item stands there.
2. The item holds n - 1 pairs, so one of any n - s + 1 of them is among those. The
   rarest n - s + 1, by the number of places in the block's items, are the item's
   seeds: rarity decides where to look, and rejects nothing. Around each seed hit
   in a document the item's pairs are counted; stretches with s - 1 of them
   within 2n - s words are candidates.
3. Smith-Waterman over words (1 for a match, -1 for a mismatch or a gap) scores
   the stretch with a margin of 2n words. The score is divided by the
   item's words; at MIN_SCORE and above the document is contaminated.

Items go through in blocks of at most BLOCK_WORDS words (one longer item makes a
block), so that what tasks receive has a fixed bound; each block is one pass
over the documents.

Cases: null or empty items and texts match nothing. Repeated items and
documents are reported each; an item's null id is reported as null. An empty
benchmark or document table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.hashing import Units, grams, tokens

MIN_SCORE = 0.5
BLOCK_WORDS = 500_000
_FILTER_BITS = 22


def _grams(held: np.ndarray, n: int) -> np.ndarray:
    one = Units(0, held, held, held, np.array([0, len(held)]), held, held, held)
    return grams(one, n)[0][: max(0, len(held) - n + 1)]


class Items:
    """A block of benchmark items with their seeds sorted by hash."""

    def __init__(self, ids: list, texts: list, min_score: float = MIN_SCORE):
        self.ids: list = []
        self.words: list[np.ndarray] = []
        for units in tokens(pa.array(texts, pa.string())):
            for k in range(len(units)):
                held = units.hashes[units.bounds[k] : units.bounds[k + 1]]
                if len(held):
                    self.ids.append(ids[units.first + k])
                    self.words.append(held)
        self.needed = [max(1, int(np.ceil(min_score * len(held) - 1e-9))) for held in self.words]
        self.sizes = [min(2, s) for s in self.needed]
        found = [_grams(held, n) for held, n in zip(self.words, self.sizes)]
        self.grams = [np.unique(g) for g in found]
        known, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0))
        hashes, items = [], []
        for k, own in enumerate(found):
            rarest = np.argsort(count[np.searchsorted(known, own)], kind="stable")
            seeds = np.unique(own[rarest[: len(self.words[k]) - self.needed[k] + 1]])
            hashes.append(seeds)
            items.append(np.full(len(seeds), k))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.lengths = sorted(set(self.sizes))
        order = np.argsort(flat, kind="stable")
        self.owner = np.concatenate(items)[order] if hashes else np.zeros(0, np.int64)
        self.seeds, start = np.unique(flat[order], return_index=True)
        self.start = np.append(start, len(flat))
        self.sieve = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.sieve[self.seeds >> np.uint64(64 - _FILTER_BITS)] = True

    def hits(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """(place of the word, seed number) of every seed in a slice of texts, by place."""
        at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in self.lengths:
            rolled, whole = grams(units, n)
            maybe = np.flatnonzero(self.sieve[rolled >> np.uint64(64 - _FILTER_BITS)] & whole)
            seed = np.minimum(np.searchsorted(self.seeds, rolled[maybe]), max(0, len(self.seeds) - 1))
            found = self.seeds[seed] == rolled[maybe] if len(self.seeds) else np.zeros(0, bool)
            at.append(maybe[found])
            which.append(seed[found])
        place, seed = np.concatenate(at), np.concatenate(which)
        order = np.argsort(place, kind="stable")
        return place[order], seed[order]


def local_alignment(text: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best Smith-Waterman score and the place in `text` just behind it."""
    steps = np.arange(len(text) + 1)
    row, best, end = np.zeros(len(text) + 1, dtype=np.int64), 0, 0
    for word in item:
        new = np.maximum(row - 1, 0)
        np.maximum(new[1:], row[:-1] + np.where(text == word, 1, -1), out=new[1:])
        row = np.maximum.accumulate(new + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _stretches(place: np.ndarray, gap: int) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(place) > gap) + 1
    return list(zip([0, *cuts], [*cuts, len(place)]))


def _dense(place: np.ndarray, hits: int, span: int) -> np.ndarray:
    """Those of sorted `place` that lie with `hits` of them or more within `span`."""
    if len(place) < hits:
        return place[:0]
    first = np.flatnonzero(place[hits - 1 :] - place[: len(place) - hits + 1] < span)
    near = np.zeros(len(place) + 1, dtype=np.int64)
    np.add.at(near, first, 1)
    np.add.at(near, first + hits, -1)
    return place[np.cumsum(near[:-1]) > 0]


def _leaks(items: Items, min_score: float):
    def one_text(held: np.ndarray, place: np.ndarray, seed: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        pairs = {n: _grams(held, n) for n in items.lengths}
        times = items.start[seed + 1] - items.start[seed]
        offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        owner = items.owner[np.repeat(items.start[seed], times) + offset]
        place = np.repeat(place, times)
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        bounds = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
        for lo, hi in zip(bounds, bounds[1:]):
            k = owner[lo]
            item, n, needed, own = items.words[k], items.sizes[k], items.needed[k], items.grams[k]
            span = 2 * len(item) - needed
            best: tuple[float, int, int] | None = None
            near = []
            for x, y in _stretches(place[lo:hi], 2 * span):
                at, to = max(0, int(place[lo + x]) - span), int(place[lo + y - 1]) + span + 1
                said = pairs[n][at:to]
                found = own[np.minimum(np.searchsorted(own, said), len(own) - 1)] == said
                near.append(at + np.flatnonzero(found))
            dense = _dense(np.concatenate(near), max(1, needed - 1), span)
            for x, y in _stretches(dense, span) if len(dense) else []:
                at = max(0, int(dense[x]) - 2 * len(item))
                region = held[at : int(dense[y - 1]) + 2 * len(item) + 2]
                score, end = local_alignment(region, item)
                if score >= min_score * len(item) and (best is None or score / len(item) > best[0]):
                    start = end - local_alignment(region[:end][::-1], item[::-1])[1]
                    best = (score / len(item), at + start, at + end)
            if best:
                yield (int(k), *best)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for units in tokens(batch.column(1)):
                place, seed = items.hits(units)
                text = np.searchsorted(units.bounds, place, side="right") - 1
                edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1)) if len(text) else []
                for lo, hi in zip(edges, edges[1:]):
                    start = units.bounds[text[lo]]
                    held = units.hashes[start : units.bounds[text[lo] + 1]]
                    row = units.first + int(text[lo])
                    rows.extend((row, *x) for x in one_text(held, place[lo:hi] - start, seed[lo:hi]))
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([items.ids[r[1]] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.float64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([r[4] for r in rows], pa.int64()),
                ],
                names=["doc_id", "item_id", "score", "first_word", "end_word"],
            )

    return run


def _blocks(benchmark: DataFrame, min_score: float) -> Iterator[Items]:
    ids: list = []
    texts: list = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        n = len((row[1] or "").split())
        if ids and size + n > BLOCK_WORDS:
            yield Items(ids, texts, min_score)
            ids, texts, size = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        size += n
    yield Items(ids, texts, min_score)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """A row for each document and item it holds: doc_id, item_id, score, first_word, end_word.

    Words are runs of letters, digits and characters beyond ASCII in lower case;
    first_word and end_word count them from 0 in the document's best stretch.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    found = None
    for items in _blocks(benchmark, min_score):
        leaks = rows.mapInArrow(_leaks(items, min_score), schema)
        found = leaks if found is None else found.unionByName(leaks)
    return found
