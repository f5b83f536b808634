"""Nearest vectors by multi-index hashing of learned binary codes.

1. On a bounded sample, TABLES rotations are learned by iterative quantisation
   (PCA, then a rotation that brings the sample close to its own signs). The
   signs of a rotated vector are its code, one 64-bit word for each 64 bits.
2. A code is split into substrings of 16 bits, and every batch of rows is
   indexed by each of them. Two codes within distance r agree in some substring
   up to r // substrings bits (pigeonhole), so probing the values that near in
   every substring finds every code within r.
3. The first radius of a query is the smallest at which the sample, without the
   query itself, lets expect CANDIDATES rows. All codes within it are reranked on
   the vectors in double precision; each task keeps its k best of a query, the
   best of those win.
4. The k-th best distance found bounds that of any row still missed. The radius
   widens to what the codes of REACH of the sample's pairs at about that distance
   need (to all bits where fewer than k were found or the sample has no such
   pairs), and the codes between both radii are reranked too. So the radius
   follows recall, not a count of rows.

Every row is indexed. Queries go in blocks of QUERY_BLOCK, each read against the
whole index. Cases: vectors that are null, zero, of another length than most of
the sample, or hold null or non-finite components take no part. A query's own
vec_id is no candidate. A repeated query id is searched once, with the smallest
of its vectors; repeated candidates are candidates each. Ties go to the smaller
vec_id. Null ids take no part. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.store import saved

SAMPLE = 20_000
TABLES = 4
CANDIDATES = 1000
REACH = 0.9  # share of the sample's pairs at a distance whose codes the radius for it covers
ANCHORS, NEAR, GROUP = 400, 200, 500  # pairs of the sample: of so many rows, with so many nearest, in groups of equal size
QUERY_BLOCK = 2000
_ROUNDS = 30


def _usable(column: str) -> Column:
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class Codes:
    """Learned rotations; a code has TABLES * width bits, width the vectors' length rounded up to 64."""

    def __init__(self, sample: np.ndarray):
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        width = sample.shape[1]
        bits = -(-width // 64) * 64
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1]
        projected = centred @ axes
        self.maps = []
        for table in range(TABLES):
            rng = np.random.default_rng(table)
            turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0][:width]
            for _ in range(_ROUNDS):
                signs = np.where(projected @ turn >= 0, 1.0, -1.0)
                left, _, right = np.linalg.svd(projected.T @ signs, full_matrices=False)
                turn = left @ right
            self.maps.append(axes @ turn)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """Codes of vectors, as rows of 64-bit words."""
        bits = np.concatenate([(vectors - self.mean) @ m >= 0 for m in self.maps], axis=1)
        return np.packbits(bits, axis=1).view(np.uint64)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class _Reach:
    """Radius in bits that covers REACH of the sample's pairs at a distance between vectors."""

    def __init__(self, sample: np.ndarray, codes: np.ndarray):
        far, bits = [np.zeros(0)], [np.zeros(0, np.int64)]
        for i in range(min(ANCHORS, len(sample))):
            apart = np.sqrt(((sample - sample[i]) ** 2).sum(axis=1))
            near = np.argpartition(apart, min(NEAR, len(apart) - 1))[: NEAR + 1]
            near = near[near != i]
            far.append(apart[near])
            bits.append(_distance(codes[near], codes[i]))
        distance, differ = np.concatenate(far), np.concatenate(bits)
        order = np.argsort(distance, kind="stable")
        groups = max(1, len(order) // GROUP)
        parts = [part for part in np.array_split(order, groups) if len(part)]
        self.limits = np.array([distance[part[-1]] for part in parts])
        needed = [np.quantile(differ[part], REACH, method="higher") for part in parts]
        self.radii = np.append(np.maximum.accumulate(np.array(needed, dtype=np.int64)), 64 * codes.shape[1])

    def of(self, distances: np.ndarray) -> np.ndarray:
        return self.radii[np.searchsorted(self.limits, distances)]


class _Index:
    """Rows of one batch by the values of each 16-bit substring of their codes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = codes.view(np.uint16)
        self.lists = []
        for part in self.parts.T:
            order = np.argsort(part, kind="stable")
            values, start = np.unique(part[order], return_index=True)
            self.lists.append((values, start, np.append(start[1:], len(order)), order))

    def within(self, code: np.ndarray, radius: int, beyond: int = -1) -> np.ndarray:
        """Rows whose code differs from `code` in at most `radius` and more than `beyond` bits."""
        pieces = code.view(np.uint16)
        share, rest = divmod(radius, len(pieces))
        hit = np.zeros(len(self.codes), dtype=bool)
        for k, (values, start, end, order) in enumerate(self.lists):
            reach = share if k <= rest else share - 1
            near = np.bitwise_count(values ^ pieces[k]) <= reach if reach >= 0 else np.zeros(len(values), bool)
            lengths = np.where(near, end - start, 0)
            hit[order[np.repeat(near, end - start)] if lengths.sum() else order[:0]] = True
        rows = np.flatnonzero(hit)
        apart = _distance(self.codes[rows], code)
        return rows[(apart <= radius) & (apart > beyond)]


def _code_batches(codes: Codes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = codes.of(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([x.tobytes() for x in found], pa.binary())], names=["vec_id", "vector", "code"]
                )

    return run


def _search(ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, radii: np.ndarray, beyond: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            own, held = batch.column(0).to_numpy(), _matrix(batch.column(1))
            words = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(len(own), -1)
            index = _Index(words)
            for q in range(len(ids)):
                rows = index.within(codes[q], int(radii[q]), int(beyond[q]))
                rows = rows[own[rows] != ids[q]]
                if len(rows):
                    score = np.sqrt(((held[rows] - vectors[q]) ** 2).sum(axis=1))
                    score, names = np.concatenate((best[q][0], score)), np.concatenate((best[q][1], own[rows]))
                    top = np.lexsort((names, score))[:k]
                    best[q] = score[top], names[top]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(ids, [len(s) for s, _ in best]), pa.int64()),
                pa.array(np.concatenate([n for _, n in best]) if len(best) else [], pa.int64()),
                pa.array(np.concatenate([s for s, _ in best]) if len(best) else [], pa.float64()),
            ],
            names=["query_id", "vec_id", "score"],
        )

    return run


def nearest(
    embeddings: DataFrame, queries: DataFrame, k: int = 10, candidates: int = CANDIDATES, sample_rows: int = SAMPLE
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each query, by Euclidean distance."""

    def clean(df: DataFrame) -> DataFrame:
        return df.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
        ).where(_usable("vector") & F.col("vec_id").isNotNull())

    rows = clean(embeddings)
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()
    if not picked:
        return empty
    width = Counter(len(r.vector) for r in picked).most_common(1)[0][0]
    picked = [r for r in picked if len(r.vector) == width]
    sample, sample_ids = np.array([r.vector for r in picked]), np.array([r.vec_id for r in picked])
    codes = Codes(sample)
    sample_codes = codes.of(sample)
    reach = _Reach(sample, sample_codes)
    fits = F.size("vector") == width
    index = saved(rows.where(fits).mapInArrow(_code_batches(codes), "vec_id long, vector array<double>, code binary"), "codes")
    total = index.count()
    share = min(1.0, candidates / total)
    asked = clean(queries).where(fits).groupBy("vec_id").agg(F.min("vector").alias("vector"))

    found, block = None, []

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)

    def first_radius(query: int, code: np.ndarray) -> int:
        apart = _distance(sample_codes[sample_ids != query], code)
        wanted = max(0, int(np.ceil(share * len(apart))) - 1)
        return 64 * len(code) if share == 1.0 or not len(apart) else int(np.partition(apart, wanted)[wanted])

    def searched(block: list) -> DataFrame:
        ids, vectors = np.array([r[0] for r in block]), np.array([r[1] for r in block])
        words = codes.of(vectors)
        radii = np.array([first_radius(q, w) for q, w in zip(ids, words)])
        schema = "query_id long, vec_id long, score double"
        none = np.full(len(ids), -1)
        near = saved(best(index.mapInArrow(_search(ids, vectors, words, radii, none, k), schema)).drop("rank"), "near")
        worst = near.groupBy("query_id").agg(F.max("score").alias("d"), F.count("*").alias("n")).where(F.col("n") >= k)
        bound = {r.query_id: r.d for r in worst.collect()}
        wide = reach.of(np.array([bound.get(q, np.inf) for q in ids.tolist()]))
        more = np.flatnonzero(wide > radii)
        if not len(more):
            return near
        beyond = _search(ids[more], vectors[more], words[more], wide[more], radii[more], k)
        return near.unionByName(index.mapInArrow(beyond, schema))

    for row in asked.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            found = searched(block) if found is None else found.unionByName(searched(block))
            block = []
    if block:
        found = searched(block) if found is None else found.unionByName(searched(block))
    if found is None:
        return empty
    return best(found).select("query_id", "rank", "vec_id", "score")
