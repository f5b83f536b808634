"""Packing of tokenised documents into sequences: best-fit decreasing, certified by lower bounds.

1. A document is its token ids and an end id; longer ones are cut into pieces of
   the sequence length. Whole pieces are sequences of their own.
2. The rest is dealt by hash to groups of about GROUP pieces. Each group is
   packed by best-fit decreasing, and a dual feasible function bounds from below
   the sequences that any packing of it needs: for every threshold t, pieces
   above capacity - t count 1, pieces below t count 0, the others their length.
3. A group that meets its bound is certified and keeps all but its emptiest
   sequence; a group with a gap gives up every sequence that is not full. What is
   given up goes into fewer groups and is packed again, until one group is left
   or MAX_ROUNDS have passed.

Cases: null text is empty, an empty document is its end id alone. Repeated rows
are documents of their own. An empty table gives no rows. Columns besides doc_id
and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.store import saved

LENGTH = 2048
END_ID = 0
GROUP = 20_000
MAX_ROUNDS = 8
_SLICE_BYTES = 1 << 21
_WORDS_AT_ONCE = 5_000
_CACHE_WORDS = 600_000

# Letters whose lower case is one letter, whatever stands around it, and which no normal form changes; marks
# that neither join each other nor letters to other words than those of the vocabulary's splitter.
_LATIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}"
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
_PLAIN = f"^[{_LATIN}]+[{re.escape(_MARKS)}]*$"


class _Words:
    """Token ids of words, one behind the other in `ids`; forgotten when there are too many."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for piece, k in vocabulary.items() if piece.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids, self.start, self.size = (np.zeros(0, dtype=t) for t in ("<u4", np.int64, np.int64))
        self.end = self._add(pa.array(["\n"], pa.large_string()), [np.array([END_ID])])  # no word holds white space
        self.empty = self._add(pa.array([""], pa.large_string()), [np.zeros(0, dtype=np.int64)])

    def _add(self, words: pa.Array, ids: list[np.ndarray]) -> int:
        first, size = len(self.known), np.fromiter(map(len, ids), np.int64, len(ids))
        self.known = pa.concat_arrays([self.known, words])
        self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.ids = np.concatenate([self.ids, *ids]).astype("<u4")
        return first

    def _encoded(self, words: list[str], letters: bool) -> list[np.ndarray]:
        """The ids of each word. Words of letters only end with one end-of-word piece each, so many can go as one text."""
        out: list[np.ndarray] = []
        for part in (words[k : k + _WORDS_AT_ONCE] for k in range(0, len(words), _WORDS_AT_ONCE)):
            if letters:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(part):
                    out += np.split(ids, cuts[:-1])
                    continue
            out += [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _numbers(self, stems: pa.Array, others: pa.Array) -> np.ndarray:
        """The numbers of stems, which are letters only, and of other words; new ones are encoded."""
        words = pa.concat_arrays([stems, others])
        out = pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().astype(np.int32)
        new = out < 0
        if new.any():
            parts = [words.slice(lo, n).filter(pa.array(new[lo : lo + n])).to_pylist() for lo, n in ((0, len(stems)), (len(stems), len(others)))]
            ids = self._encoded(parts[0], True) + self._encoded(parts[1], False)
            out[new] = self._add(words.filter(pa.array(new)), ids) + np.arange(new.sum())
        return out

    def units(self, words: pa.Array) -> np.ndarray:
        """Two numbers for each of some distinct words: of its stem and of the marks behind it.

        A word of Latin letters is known by its lower case, as the vocabulary has
        no other; marks behind it are a word of their own. Anything else is its own stem.
        """
        if len(self.known) > _CACHE_WORDS:
            self.clear()
        plain = pc.match_substring_regex(words, _PLAIN)
        simple, rest = words.filter(plain), words.filter(pc.invert(plain))
        stems = pc.utf8_lower(pc.utf8_rtrim(simple, _MARKS)).dictionary_encode()
        marks = pc.replace_substring_regex(simple, f"^[{_LATIN}]+", "").dictionary_encode()
        n, m = len(stems.dictionary), len(marks.dictionary)
        numbers = self._numbers(stems.dictionary, pa.concat_arrays([marks.dictionary, rest]))
        out = np.full((len(words), 2), self.empty, dtype=np.int32)
        at = plain.to_numpy(zero_copy_only=False)
        out[at, 0] = numbers[:n][stems.indices.to_numpy()]
        out[at, 1] = numbers[n : n + m][marks.indices.to_numpy()]
        out[~at, 0] = numbers[n + m :]
        return out

    def gathered(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of `units` one behind the other, and where each unit begins."""
        size = self.size[units]
        ends = np.cumsum(size)
        begin = ends - size
        at = np.repeat((self.start[units] - begin).astype(np.int32), size)
        at += np.arange(len(at), dtype=np.int32)
        return self.ids[at], begin


def _text_ids(known: _Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with its end id, one behind the other, and where each text begins (and the last ends).

    The vocabulary drops white space, so a text's ids are those of its words.
    """
    words = pc.ascii_split_whitespace(texts)
    first = words.offsets.to_numpy() - words.offsets[0].as_py()
    held = words.flatten().dictionary_encode()
    pairs = known.units(held.dictionary)[held.indices.to_numpy()].reshape(-1)
    units = np.insert(pairs, 2 * first[1:], known.end)
    ids, begin = known.gathered(units)
    return ids, np.append(begin, len(ids))[2 * first + np.arange(len(first))]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of about _SLICE_BYTES together; a longer text is alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        begin = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begin + _SLICE_BYTES, side="right")))
        yield at, to
        at = to


def _piece_batches(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(path)  # of this task only: idle workers keep no memory
        for batch in batches:
            column = batch.column(1).cast(pa.large_string()).fill_null("")
            for at, to in _slices(column):
                ids, begin = _text_ids(known, column.slice(at, to - at))
                count = -(-np.diff(begin) // length)
                doc = np.repeat(np.arange(to - at), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * length
                cuts = np.append(begin[doc] + start, len(ids))
                for lo in range(0, len(doc), 5_000):
                    hi = min(len(doc), lo + 5_000)
                    offsets = (4 * (cuts[lo : hi + 1] - cuts[lo])).astype(np.int32)
                    data = pa.py_buffer(ids[cuts[lo] : cuts[hi]].tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(at + doc[lo:hi], pa.int64())),
                            pa.array(piece[lo:hi], pa.int32()),
                            pa.array(start[lo:hi], pa.int64()),
                            pa.array(np.diff(cuts[lo : hi + 1]), pa.int64()),
                            pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), data]),
                        ],
                        names=["doc_id", "piece", "start", "length", "ids"],
                    )
            pa.default_memory_pool().release_unused()

    return run


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids (little-endian 32-bit)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(
        _piece_batches(tokenizer_path, length), "doc_id long, piece int, start long, length long, ids binary"
    )


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing of `lengths` needs."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    number, total = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * np.arange(capacity + 1)))
    t = np.arange(capacity // 2 + 1)
    alone = number[-1] - number[capacity - t + 1]  # above capacity - t
    large = number[capacity - t + 1] - number[capacity // 2 + 1]  # above half
    large_total = total[capacity - t + 1] - total[capacity // 2 + 1]
    small_total = total[capacity // 2 + 1] - total[t]
    over = np.maximum(0, small_total - (large * capacity - large_total))
    return int((alone + large + -(-over // capacity)).max())


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, place in it) of each length, and the tokens in each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, places, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has r tokens of room
    for k in order.tolist():
        size = int(lengths[k])
        fitting = open_rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
        else:
            at, left = len(fill), capacity
            fill.append(0)
        bins[k], places[k] = at, fill[at]
        fill[at] += size
        left -= size
        if left:
            room[left].append(at)
            open_rooms |= 1 << left
    return bins, places, np.array(fill, dtype=np.int64)


def _pack_group(round_no: int, last: bool, capacity: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece_key", ignore_index=True)
        lengths = group["length"].to_numpy()
        bins, places, fill = best_fit(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        given = np.zeros(len(fill), dtype=bool)
        if not last:
            if len(fill) > bound:
                given = fill < capacity
            else:
                given[fill.argmin()] = fill.min() < capacity
        number = (round_no << 56) + (int(group["part"].iloc[0]) << 16) + bins
        return pd.DataFrame(
            {
                "piece_key": group["piece_key"],
                "length": lengths,
                "sequence_id": number,
                "offset": places,
                "certified": len(fill) == bound,
                "given": given[bins],
            }
        )

    return run


def packed(tokens: DataFrame, capacity: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(piece_key, sequence_id, offset, certified) of rows (piece_key, length) with lengths from 1 to `capacity`.

    `certified` tells whether the group a piece was packed in met its lower bound.
    """
    whole = tokens.where(F.col("length") == capacity).select(
        "piece_key", (-F.col("piece_key") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified")
    )
    left = tokens.where(F.col("length") < capacity).select("piece_key", "length")
    done = [whole]
    for round_no in range(MAX_ROUNDS):
        groups = max(1, -(-left.count() // group))
        last = groups == 1 or round_no == MAX_ROUNDS - 1
        dealt = left.withColumn("part", F.pmod(F.xxhash64("piece_key", F.lit(round_no)), F.lit(groups)))
        made = saved(
            dealt.groupBy("part").applyInPandas(
                _pack_group(round_no, last, capacity),
                "piece_key long, length long, sequence_id long, offset long, certified boolean, given boolean",
            ),
            "packed",
        )
        done.append(made.where("not given").select("piece_key", "sequence_id", "offset", "certified"))
        if last:
            break
        left = made.where("given").select("piece_key", "length")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def packed_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Every piece of every document with its ids and its place: sequence_id, offset, certified."""
    tokens = saved(
        pieces(docs, tokenizer_path, length).withColumn("piece_key", F.monotonically_increasing_id()), "pieces"
    )
    places = packed(tokens.select("piece_key", "length"), length, group)
    return tokens.join(places, "piece_key").drop("piece_key")
