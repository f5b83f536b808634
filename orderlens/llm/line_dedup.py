"""Removal of blocks of lines that an earlier document holds already.

1. The shortest run of lines in a row with at least `min_words` words, one that
   starts and one that ends at each line, is a seed with a hash. A seed that
   several documents hold pairs each later one with the first holder; so a seed
   with n holders gives n - 1 pairs, rare or frequent. `rarity` of a pair is the
   number of holders of its rarest seed. Each line of a common block lies in a
   seed within the block, and a seed is a block that its first holder holds, so
   pairs with first holders miss none.
2. Each pair is aligned with patience diff: lines that occur once in both texts,
   longest increasing run of their places, then the gaps between, with equal
   lines at both ends of a gap taken first. What stays unmatched is aligned again
   until nothing more matches, so blocks that moved or repeat are found too. Last,
   seeds of the later text that the first holds and no matched run covers are taken.
3. Runs of matched lines with at least `min_words` words in all go from the
   later document. The first holder of a line never loses it, so one copy stays.

Order is by doc_id, then by a hash of the text. Cases: null or empty texts hold
no lines and stay as they are, rows without id too. Empty lines are never
matched. Rows with the same id and text share their result. A document whose
lines are all taken keeps its row with an empty text. Extra columns are kept;
`n_lines` and `lines_removed` are added and take the place of columns of that name.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.hashing import _power_size, _powers, lines, mix, words
from orderlens.llm.store import saved

MIN_WORDS = 10


def _windows(sizes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the shortest runs of lines with `min_words` words that start or end at each line."""
    upto = np.concatenate(([0], np.cumsum(sizes)))
    lines_ = np.arange(len(sizes))
    end = np.searchsorted(upto, upto[:-1] + min_words)
    start = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1
    end = np.maximum(end, lines_ + 1)
    start = np.minimum(start, lines_)
    begun, ended = end <= len(sizes), start >= 0
    return np.concatenate((lines_[begun], start[ended])), np.concatenate((end[begun], lines_[ended] + 1))


def _window_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    power, inverse = _powers(_power_size(len(h)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)])))
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


def _line_batches(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for found, said in zip(lines(batch.column(2)), words(batch.column(2))):
                size = np.diff(np.searchsorted(said.start, np.append(found.start, len(found.data))))
                breaks = np.concatenate(([0], np.cumsum(found.data == 10)))
                texts = np.searchsorted(found.bounds, np.arange(len(found.hashes)), side="right") - 1
                place = breaks[found.start] - breaks[found.text_start[texts]]
                for lo, hi in zip(found.bounds, found.bounds[1:]):
                    h = found.hashes[lo:hi]
                    seeds = _window_hashes(h, *_windows(size[lo:hi], min_words))
                    out[0].append(h.view(np.int64))
                    out[1].append(size[lo:hi])
                    out[2].append(place[lo:hi])
                    out[3].append(np.unique(seeds).view(np.int64))
            arrays = [pa.array(x, pa.list_(t)) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *arrays], names=["id", "th", "hashes", "sizes", "places", "seeds"]
            )

    return run


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of `pairs`, sorted by their first place, whose second places increase."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pos = bisect_left(tails, j)
        back.append(at[pos - 1] if pos else -1)
        tails[pos : pos + 1] = [j]
        at[pos : pos + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int | None]) -> list[tuple[int, int]]:
    """Matched places of two lists of line hashes, increasing in both. None in `b` matches nothing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: i for i, x in enumerate(a[a0:a1], a0) if once_a[x] == 1}
        anchors = sorted((where[x], j) for j, x in enumerate(b[b0:b1], b0) if x in where and once_b[x] == 1)
        if not anchors:  # every common line repeats: the first of each side stands for it
            first_a = {x: i for i, x in reversed(list(enumerate(a[a0:a1], a0)))}
            first_b = {x: j for j, x in reversed(list(enumerate(b[b0:b1], b0)))}
            anchors = sorted((first_a[x], j) for x, j in first_b.items() if x is not None and x in first_a)
        ends = [(a0 - 1, b0 - 1), *_increasing(anchors), (a1, b1)]
        out.extend(ends[1:-1])
        if len(ends) > 2:
            todo.extend((i0 + 1, i1, j0 + 1, j1) for (i0, j0), (i1, j1) in zip(ends, ends[1:]))
    return sorted(out)


def common_blocks(a: list[int], b: list[int], sizes: list[int], min_words: int) -> list[int]:
    """Places of `b` in blocks of at least `min_words` words that `a` holds too."""
    if a == b:
        return list(range(len(b))) if sum(sizes) >= min_words else []
    left: list[int | None] = list(b)
    gone: list[int] = []
    held = set(a)
    while any(x in held for x in left):
        run: list[int] = []
        taken = 0
        matched = patience(a, left)
        for k, (i, j) in enumerate(matched):
            run.append(j)
            if k + 1 == len(matched) or matched[k + 1] != (i + 1, j + 1):
                if sum(sizes[x] for x in run) >= min_words:
                    gone.extend(run)
                for x in run:
                    left[x] = None
                taken += len(run)
                run = []
        if not taken:
            break
    covered = set(gone)
    missed: dict[tuple, list[tuple[int, int]]] = {}
    for s, e in zip(*(x.tolist() for x in _windows(np.array(sizes), min_words))):
        if held.issuperset(b[s:e]) and not covered.issuperset(range(s, e)):
            missed.setdefault(tuple(b[s:e]), []).append((s, e))
    where: dict[int, list[int]] = {}
    for i, x in enumerate(a if missed else []):
        where.setdefault(x, []).append(i)
    for seed, places in missed.items():
        if any(tuple(a[i : i + len(seed)]) == seed for i in where[seed[0]]):
            covered.update(k for s, e in places for k in range(s, e))
    return sorted(covered)


def _align(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sizes, places = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            gone = [[p[k] for k in common_blocks(x, y, s, min_words)] for x, y, s, p in zip(a, b, sizes, places)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(gone, pa.list_(pa.int32()))], names=["id", "th", "gone"]
            )

    return run


def _left(text: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines at the positions in `gone`, in one pass over their lines."""

    def one(text: str | None, gone: np.ndarray | None) -> str | None:
        if text is None:
            return None
        lines = text.split("\n")
        keep = np.ones(len(lines), dtype=bool)
        keep[gone] = False
        return "\n".join(line for line, kept in zip(lines, keep.tolist()) if kept)

    return pd.Series([one(t, g) for t, g in zip(text, gone)], dtype=object)


def deduplicated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with blocks that an earlier document holds taken out of `text`, plus n_lines and lines_removed."""
    text = F.col("text").cast("string")
    key = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    lined = saved(
        key.where("id is not null and text is not null").mapInArrow(
            _line_batches(min_words),
            "id long, th long, hashes array<long>, sizes array<int>, places array<int>, seeds array<long>",
        ),
        "lines",
    )
    me = F.struct("id", "th").alias("me")
    held = lined.select(me, F.explode("seeds").alias("seed"))
    firsts = held.groupBy("seed").agg(F.min("me").alias("first"), F.max("me").alias("last"), F.count("*").alias("holders"))
    later = held.join(firsts.where("first <> last").select("seed", "first", "holders"), "seed").where("me > first")
    pairs = saved(later.groupBy("me", "first").agg(F.min("holders").alias("rarity")), "pairs", lined.count())

    once = lined.groupBy("id", "th").agg(*(F.first(c).alias(c) for c in ("hashes", "sizes", "places")))
    earlier = once.select(F.struct("id", "th").alias("first"), F.col("hashes").alias("a"))
    wide = once.select(me, F.col("hashes").alias("b"), "sizes", "places").join(pairs, "me").join(earlier, "first")
    gone = wide.select("me.id", "me.th", "a", "b", "sizes", "places").mapInArrow(
        _align(min_words), "id long, th long, gone array<int>"
    )
    gone = gone.where("size(gone) > 0").groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("__gone"))

    keyed = docs.drop("n_lines", "lines_removed").withColumn("__id", F.col("doc_id").cast("long")).withColumn("__th", F.xxhash64(text))
    gone = gone.withColumnsRenamed({"id": "__id", "th": "__th"})
    parts = F.split("text", "\n")
    # Else a filter on the result gets a call of its own, and each task a second Python worker that stays.
    once_only = F.pandas_udf(_left, "string").asNondeterministic()
    left = once_only(F.when(F.col("__gone").isNotNull(), text), F.col("__gone"))  # other rows send no text to Python
    return (
        keyed.join(gone, ["__id", "__th"], "left")
        .withColumn("n_lines", F.when(F.length("text") > 0, F.size(parts)).otherwise(0))
        .withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left))
        .withColumn("lines_removed", F.coalesce(F.size("__gone"), F.lit(0)))
        .drop("__id", "__th", "__gone")
    )
