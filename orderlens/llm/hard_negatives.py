"""Hard negatives by exact integer scores: tiles of anchors and candidates, multiplied by Strassen's recursion.

1. Components become integers. Rows are put in order of label and number and cut
   into blocks; anchors likewise. A block is one row: ids, labels and a matrix.
2. A tile is a block of anchors and a block of candidates, joined by their
   numbers, and `product` multiplies it: both matrices are padded with zeros to
   even sides, seven half-size products replace eight, additions are exact in
   int64 (modulo 2**64, which no score reaches).
3. First pass, over the tiles that share a label: each task keeps a heap of the
   best positives of an anchor. Heaps of tiles merge by keeping the best of both,
   in the task and then by anchor.
4. Second pass, over all tiles: the positives' scores set the windows, and a heap
   for each anchor and positive keeps the best rows of other labels inside.

No tile is left out, no heap drops a row that the result needs, and what a task
holds is bounded by the tile. The scores of all anchors against all rows are
computed, so work grows with their product, as an exact search asks for.

Cases: rows with a null label, id or vector or a null or non-finite component
take no part, nor do rows of a norm of 2**20 or more, whose scores would not fit.
Rows that share an id are one row: that of the smallest label, then vector.
Shorter vectors count as padded with zeros. Ties go to the smaller id. Anchors without other rows of their label, and
pairs without a row in the window, give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.order import by_ranges, numbered
from orderlens.llm.store import saved

SCALE = 256
ANCHORS, CANDIDATES = 1024, 4096  # rows of a block
STRIP = 256  # anchors multiplied at a time
LEAF = 32  # no matrix with a shorter side is split
NORM = 2.0**56  # of squares of integers: below it a hundred times a score fits in a long
NONE = np.iinfo(np.int64).min
_BLOCK = "block long, ids binary, labels binary, width long, kind string, matrix binary"


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64 matrices by Strassen's recursion."""
    rows, inner, cols = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, cols) < 2 * LEAF:
        return _leaf(a, b)
    a, b = _even(a), _even(b)
    r, k, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :k], a[:r, k:], a[r:, :k], a[r:, k:]
    b11, b12, b21, b22 = b[:k, :c], b[:k, c:], b[k:, :c], b[k:, c:]
    out = np.empty((2 * r, 2 * c), dtype=np.int64)
    m = product(a11 + a22, b11 + b22)
    out[:r, :c] = m
    out[r:, c:] = m
    m = product(a21 + a22, b11)
    out[r:, :c] = m
    out[r:, c:] -= m
    m = product(a11, b12 - b22)
    out[:r, c:] = m
    out[r:, c:] += m
    m = product(a22, b21 - b11)
    out[:r, :c] += m
    out[r:, :c] += m
    m = product(a11 + a12, b22)
    out[:r, :c] -= m
    out[:r, c:] += m
    out[r:, c:] += product(a21 - a11, b11 + b12)
    out[:r, :c] += product(a12 - a22, b21 + b22)
    return out[:rows, :cols]


def _even(m: np.ndarray) -> np.ndarray:
    return np.pad(m, [(0, side % 2) for side in m.shape]) if m.shape[0] % 2 or m.shape[1] % 2 else m


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A small product: in doubles where they hold every partial sum exactly, else in int64."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), dtype=np.int64)
    top = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, highest first, ties to the smaller column."""
    width = scores.shape[1]
    k = min(k, width)
    spread = 1 << (width - 1).bit_length()
    if width > 4 * k and np.abs(scores, where=scores > NONE, out=np.zeros_like(scores)).max(initial=0) < 2**62 // spread:
        keyed = np.where(scores > NONE, scores * spread + (spread - 1 - np.arange(width)), NONE)
        part = np.argpartition(keyed, width - k, axis=1)[:, width - k :]
        order = np.argsort(-np.take_along_axis(keyed, part, axis=1), axis=1, kind="stable")
        return np.take_along_axis(part, order, axis=1)
    return np.lexsort((np.broadcast_to(np.arange(width), scores.shape), -np.maximum(scores, NONE + 1)), axis=1)[:, :k]


class Heaps:
    """The k best (score, id) of each of several rows. Heaps merge with what another tile or task found."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.scores = np.full((rows, k), NONE, dtype=np.int64)
        self.ids = np.zeros((rows, k), dtype=np.int64)

    def merge(self, lo: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in scores and ids of rows from `lo` on."""
        hi = lo + len(scores)
        scores, ids = np.hstack([self.scores[lo:hi], scores]), np.hstack([self.ids[lo:hi], ids])
        order = np.lexsort((ids, -np.maximum(scores, NONE + 1)), axis=1)[:, : self.k]
        self.scores[lo:hi], self.ids[lo:hi] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def integer_rows(rows: DataFrame, vector: str, label: Column | str, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; q is floor(scale * component)."""
    component = lambda x: x.cast("double")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(component(x)) & (F.abs(component(x)) < 2.0**40))
    name = F.col(label) if isinstance(label, str) else label
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), name.cast("long").alias("label"), F.col(vector).alias("v"))
    plain = plain.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    plain = plain.where(sound)
    whole = plain.select("vec_id", "label", F.transform("v", lambda x: F.floor(component(x) * scale)).alias("q"))
    norm = F.aggregate("q", F.lit(0.0), lambda sum_, x: sum_ + x.cast("double") * x.cast("double"))
    return whole.where(norm < NORM).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")


def _packed(rows: pa.Table) -> pa.Table:
    """One row of a block's rows, in order of id; the matrix in the narrowest integers that hold it."""
    rows = rows.sort_by("vec_id")
    q = rows["q"].combine_chunks()
    sizes = np.diff(q.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    matrix = np.zeros((len(rows), width), dtype=np.int64)
    matrix[np.arange(width)[None, :] < sizes[:, None]] = q.flatten().to_numpy()
    kind = next(t for t in ("<i2", "<i4", "<i8") if (matrix.astype(t) == matrix).all())
    extra = {}
    if "positives" in rows.column_names:
        each = pa.concat_arrays(rows["positives"].chunks)
        each = each.cast(pa.list_(each.type.value_type))
        extra["positives"] = pa.ListArray.from_arrays(pa.array([0, len(each)], pa.int32()), each)
    return pa.table(
        {
            "block": rows["block"][:1],
            "ids": [rows["vec_id"].to_numpy().astype("<i8").tobytes()],
            "labels": [rows["label"].to_numpy().astype("<i8").tobytes()],
            "width": [width],
            "kind": [kind],
            "matrix": [matrix.astype(kind).tobytes()],
            **extra,
        }
    )


def _matrix(width: int, kind: str, data: bytes, to: int) -> np.ndarray:
    plain = np.frombuffer(data, kind).astype(np.int64)
    return np.pad(plain.reshape(len(plain) // width if width else 0, width), ((0, 0), (0, to - width)))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray, int, np.ndarray]]:
    """(anchor block, candidate ids and labels, first anchor of a strip, its scores) of every tile."""
    for batch in batches:
        for k in range(batch.num_rows):
            tile = batch.slice(k, 1).to_pylist()[0]
            ids, labels = np.frombuffer(tile["c_ids"], "<i8"), np.frombuffer(tile["c_labels"], "<i8")
            width = max(tile["width"], tile["c_width"])
            n = len(tile["ids"]) // 8
            own = _matrix(tile["width"], tile["kind"], tile["matrix"], width) if tile["width"] else np.zeros((n, width), np.int64)
            others = _matrix(tile["c_width"], tile["c_kind"], tile["c_matrix"], width) if tile["c_width"] else np.zeros((len(ids), width), np.int64)
            others = np.ascontiguousarray(others.T)
            for lo in range(0, n, STRIP):
                yield tile, ids, labels, lo, product(own[lo : lo + STRIP], others)


def _by_block(strips: Iterator[tuple], found) -> Iterator[pa.RecordBatch]:
    """Runs `found.take(...)` over strips and emits the heaps whenever the block of anchors changes."""
    for tile, *rest in strips:
        if found.block != tile["block"]:
            yield from found.rows()
            found.start(tile)
        found.take(*rest)
    yield from found.rows()


class _Positives:
    def __init__(self, k: int):
        self.k, self.block, self.heaps = k, None, None

    def start(self, tile: dict) -> None:
        self.block = tile["block"]
        self.ids, self.labels = np.frombuffer(tile["ids"], "<i8"), np.frombuffer(tile["labels"], "<i8")
        self.heaps = Heaps(len(self.ids), self.k)

    def take(self, ids: np.ndarray, labels: np.ndarray, lo: int, scores: np.ndarray) -> None:
        hi = lo + len(scores)
        fit = (self.labels[lo:hi, None] == labels[None, :]) & (self.ids[lo:hi, None] != ids[None, :])
        scores = np.where(fit, scores, NONE)
        at = best(scores, self.k)
        self.heaps.merge(lo, np.take_along_axis(scores, at, axis=1), ids[at])

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.heaps is not None:
            row, at = np.nonzero(self.heaps.scores > NONE)
            columns = [self.ids[row], self.heaps.ids[row, at], self.heaps.scores[row, at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "positive_score"])
        self.heaps = None


class _Windows:
    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high, self.block, self.heaps = k, low, high, None, None

    def start(self, tile: dict) -> None:
        self.block = tile["block"]
        self.ids, self.labels = np.frombuffer(tile["ids"], "<i8"), np.frombuffer(tile["labels"], "<i8")
        rows = [(row, p["positive_id"], p["positive_score"]) for row, some in enumerate(tile["positives"]) for p in some or ()]
        self.anchor, self.positive, self.score = (np.array(c, dtype=np.int64) for c in (zip(*rows) if rows else ((), (), ())))
        self.heaps = Heaps(len(rows), self.k)

    def take(self, ids: np.ndarray, labels: np.ndarray, lo: int, scores: np.ndarray) -> None:
        other = self.labels[lo : lo + len(scores), None] != labels[None, :]
        scores = np.where(other, scores, NONE)
        first, last = np.searchsorted(self.anchor, [lo, lo + len(scores)])
        for at in range(first, last, STRIP):
            to = min(last, at + STRIP)
            mine, reach = scores[self.anchor[at:to] - lo], self.score[at:to, None]
            least, most = -((-self.low * reach) // 100), (self.high * reach) // 100
            inside = np.where((mine >= least) & (mine <= most), mine, NONE)
            where = best(inside, self.k)
            self.heaps.merge(at, np.take_along_axis(inside, where, axis=1), ids[where])

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.heaps is not None:
            row, at = np.nonzero(self.heaps.scores > NONE)
            columns = [self.ids[self.anchor[row]], self.positive[row], self.score[row], self.heaps.ids[row, at], self.heaps.scores[row, at]]
            names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
        self.heaps = None


def _joined(anchors: DataFrame, candidates: DataFrame, tiles: DataFrame) -> DataFrame:
    """A row for each tile (block, other) with both blocks' columns, dealt to about a task a tile."""
    wide = candidates.select(F.col("block").alias("other"), *[F.col(c).alias(f"c_{c}") for c in ("ids", "labels", "width", "kind", "matrix")])
    parts = max(1, min(tiles.count(), 100_000))
    both = tiles.join(anchors, "block").join(wide, "other")
    return both.repartition(parts, "block", "other").sortWithinPartitions("block", "other")


def _first(found: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    """The k best of the heaps of all tiles; `rank` from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc(f"{name}_score"), f"{name}_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows from `integer_rows`.

    Negatives of a pair are the best rows of another label whose score is from
    `low` to `high` percent of the positive's.
    """
    placed = saved(numbered(by_ranges(rows.withColumn("__all", F.lit(0)), "__all", "label", "vec_id"), "__all", "rows").drop("__all", "n"), "placed")
    of_label = placed.groupBy("label").agg(F.min("position").alias("lo"), F.max("position").alias("hi"))
    blocks = lambda position: F.expr(f"{position} div {CANDIDATES}")
    packed = placed.withColumn("block", blocks("position")).select("block", "vec_id", "label", "q")
    candidates = saved(packed.groupBy("block").applyInArrow(_packed, _BLOCK), "candidates")

    chosen = placed.where(anchors).drop("position").withColumn("__all", F.lit(0))
    chosen = numbered(by_ranges(chosen, "__all", "label", "vec_id"), "__all", "chosen").drop("__all", "n")
    chosen = saved(chosen.withColumn("block", F.expr(f"position div {ANCHORS}")).drop("position"), "anchors")
    own = chosen.groupBy("block").applyInArrow(_packed, _BLOCK)
    held = chosen.select("block", "label").distinct().join(of_label, "label")
    reach = held.groupBy("block").agg(F.min(blocks("lo")).alias("lo"), F.max(blocks("hi")).alias("hi"))
    tiles = saved(reach.select("block", F.explode(F.sequence("lo", "hi")).alias("other")), "tiles")
    found = _joined(own, candidates, tiles).mapInArrow(
        lambda batches: _by_block(_tiles(batches), _Positives(n_positives)), "anchor_id long, positive_id long, positive_score long"
    )
    positives = saved(_first(found, ["anchor_id"], n_positives, "positive"), "positives")

    pairs = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("positives")
    )
    sought = chosen.join(pairs, "vec_id")
    kind = "array<struct<rank: int, positive_id: long, positive_score: long>>"
    sought = sought.select("block", "vec_id", "label", "q", F.col("positives").cast(kind).alias("positives"))
    own = saved(sought.groupBy("block").applyInArrow(_packed, f"{_BLOCK}, positives array<{kind}>"), "sought")
    last = candidates.agg(F.max("block")).select(F.coalesce("max(block)", F.lit(0))).first()[0]
    tiles = saved(own.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("other")), "tiles")
    found = _joined(own, candidates, tiles).mapInArrow(
        lambda batches: _by_block(_tiles(batches), _Windows(n_negatives, low, high)),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    out = _first(found, ["anchor_id", "positive_id"], n_negatives, "negative")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
