"""Near-duplicate groups by SetSketch registers (Ertl, 2021).

1. `sketch`: every text becomes its set of distinct five-word shingles and a
   SetSketch of it: register i holds the smallest of exponentially distributed
   hashes of the set, on a logarithmic scale of base b, truncated to 16 bits.
   Sketches merge by the larger register (`merge_registers`).
2. Texts with the same set are one class, with a number of its own.
3. Four registers make a band. Classes that share a band key are candidates.
   With 24 bands a pair at similarity 0.85 is missed once in fifty million, one at
   0.80 three times in a million.
4. Candidates of a bucket meet its smallest member first, then two members
   chosen by hash, and only where the bucket still falls into several components.
   `estimated` takes the similarity that makes the observed counts of larger,
   smaller and equal registers likeliest; pairs for which that is MARGIN standard errors
   below the threshold go (`reaches`), the rest are confirmed on their full shingle sets. Of pairs just
   at 0.85 this estimate loses one in 17 million, at 0.80 one in 28 million.
5. What still shares a bucket across components is compared in bounded blocks
   (members outside the bucket's largest component against all others; members
   are dealt to blocks by hash, as many as their shingles ask for), each pair by
   registers, then by full sets. No pair of a bucket is left out, and
   no task emits more links than its block has members.

Cases: null or empty texts and texts without words have no shingles, their
component is their own id. Rows without id take no part (component null, kept).
Rows that share an id are one document: their texts, if they differ, are linked
to each other, and each to what it resembles. Repeated rows share their component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.graph import components
from orderlens.llm.hashing import mix, shingle_sets
from orderlens.llm.store import FILE_ROWS, saved

BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
BASE = 1.001  # of the register scale
RATE = 20.0  # of the exponential hashes: keeps registers of small sets above 0
TOP = 2**16 - 1
MARGIN = 6.0  # standard errors by which an estimate may fall short before a pair goes
BLOCK_SHINGLES = 400_000
TASK_ROWS = 2_000  # block members for each task that compares them

_rng = np.random.default_rng(7)
_XOR = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)[:, None]
_ODD1 = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)[:, None] | np.uint32(1)
_ODD2 = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)[:, None] | np.uint32(1)
_BAND_SALT = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)

SET = ["s0", "s1", "n_shingles"]  # tell the sets apart
SKETCH_FIELDS = "n_shingles long, s0 long, s1 long, registers binary, bands array<long>"


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch of a non-empty set of 64-bit hashes."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(short), 2048):
        x = (short[None, at : at + 2048] ^ _XOR) * _ODD1
        x ^= x >> np.uint32(15)
        x *= _ODD2
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(axis=1), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def _sums(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums that tell a set from others of its size."""
    if not len(shingles):
        return 0, 0
    return int(shingles.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(shingles)).view(np.int64))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, s0, s1, regs, keys = [], [], [], [], []
        for shingles in shingle_sets(batch.column(1)):
            sizes.append(len(shingles))
            for column, value in zip((s0, s1), _sums(shingles)):
                column.append(value)
            if not len(shingles):
                regs.append(None)
                keys.append([])
                continue
            row = registers(shingles)
            regs.append(row.tobytes())
            keys.append(mix(row.view(np.uint64) ^ _BAND_SALT).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(s0, pa.int64()),
                pa.array(s1, pa.int64()),
                pa.array(regs, pa.binary()),
                pa.array(keys, pa.list_(pa.int64())),
            ],
            names=["doc_id", "n_shingles", "s0", "s1", "registers", "bands"],
        )


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, size and two sums of the shingle set, registers, band keys) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_sketch_batches, f"doc_id long, {SKETCH_FIELDS}")


def estimated(n_u: np.ndarray, n_v: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Likeliest similarity of pairs of sets of known sizes, of whose registers `above` are larger and `below` smaller.

    The log-likelihood is concave in the similarity; a ternary search finds its top.
    """
    u = n_u / (n_u + n_v)
    v = 1.0 - u
    equal = REGISTERS - above - below

    def share(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = share(np.maximum(u - v * j, 0)), share(np.maximum(v - u * j, 0))
        tiny = 1e-300
        return above * np.log(p + tiny) + below * np.log(q + tiny) + equal * np.log(np.maximum(1 - p - q, 0) + tiny)

    lo, hi = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(40):
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        rising = likelihood(a) < likelihood(b)
        lo, hi = np.where(rising, a, lo), np.where(rising, hi, b)
    return (lo + hi) / 2


def reaches(n_u: np.ndarray, n_v: np.ndarray, above: np.ndarray, below: np.ndarray, least: float) -> np.ndarray:
    """Whether `estimated` is `least` or more, for `least` up to the ratio of the sizes.

    As the log-likelihood is concave, it still rises at `least` where its top lies
    beyond: one look at its slope takes the place of the search.
    """
    if least <= 0:
        return np.ones(len(n_u), dtype=bool)
    u = n_u / (n_u + n_v)
    v = 1.0 - u
    x, y = 1 - (u - v * least) * (BASE - 1) / BASE, 1 - (v - u * least) * (BASE - 1) / BASE
    p, q = np.maximum(-np.log(x) / np.log(BASE), 1e-300), np.maximum(-np.log(y) / np.log(BASE), 1e-300)
    fall_p, fall_q = v / x, u / y  # of p and q, up to a common factor
    equal = REGISTERS - above - below
    return equal * (fall_p + fall_q) / (1 - p - q) >= above * fall_p / p + below * fall_q / q


def _plausible(n_u, n_v, reg_u: np.ndarray, reg_v: np.ndarray, percent: int) -> np.ndarray:
    """Pairs that sizes and registers leave in reach of the threshold."""
    t = percent / 100
    keep = 100 * np.minimum(n_u, n_v) >= percent * np.maximum(n_u, n_v)
    fits = np.flatnonzero(keep)
    reg_u, reg_v = np.broadcast_to(reg_u, reg_v.shape)[fits], reg_v[fits]
    above, below = np.count_nonzero(reg_u > reg_v, axis=1), np.count_nonzero(reg_u < reg_v, axis=1)
    error = np.sqrt(t * (1 - t) / REGISTERS)
    keep[fits] = reaches(n_u[fits].astype(float), n_v[fits].astype(float), above, below, t - MARGIN * error)
    return keep


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = _plausible(
                    batch.column(2).to_numpy(), batch.column(3).to_numpy(), _rows(batch.column(4)), _rows(batch.column(5)), percent
                )
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_())
            )

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Runs of equal values of column `key` of a sorted stream."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), batch.num_rows]
        if held and held[-1].column(key)[-1].as_py() != names[0]:
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(cuts, cuts[1:]):
            held.append(batch.slice(lo, hi - lo))
            if hi < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _members_in_reach(percent: int):
    """Of each block, the members with a plausible partner in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(batches):
            side = block["straggler"].to_numpy()
            roots, sizes = block["root"].to_numpy(), block["n_shingles"].to_numpy()
            regs = _rows(block["registers"].combine_chunks())
            hit = np.zeros(len(side), dtype=bool)
            within = block["within"][0].as_py()
            for i in np.flatnonzero(side):
                apart = roots != roots[i]
                others = np.flatnonzero(apart[i + 1 :]) + i + 1 if within else np.flatnonzero(~side & apart)
                if len(others):
                    near = _plausible(np.full(len(others), sizes[i]), sizes[others], regs[i][None, :], regs[others], percent)
                    if near.any():
                        hit[i] = True
                        hit[others[near]] = True
            yield from block.select(["block", "node", "root", "straggler", "within"]).filter(pa.array(hit)).to_batches()

    return run


def _links_in_block(percent: int):
    """Links between components that the full sets of a block's members confirm; at most one for each member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _groups(batches):
            nodes, side = block["node"].to_numpy(), block["straggler"].to_numpy()
            roots = block["root"].to_numpy().copy()
            within = block["within"][0].as_py()
            sets = list(shingle_sets(block["text"]))
            bounds = np.cumsum([0, *map(len, sets)])
            local, ids = np.unique(np.concatenate(sets), return_inverse=True)
            sizes, mark = np.diff(bounds), np.zeros(len(local) + 1, dtype=np.int64)
            out: list[tuple[int, int]] = []
            for i in np.flatnonzero(side):
                own = ids[bounds[i] : bounds[i + 1]]
                mark[own] = 1
                running = np.concatenate(([0], np.cumsum(mark[ids])))
                both = running[bounds[1:]] - running[bounds[:-1]]
                mark[own] = 0
                linked = (100 * both >= percent * (sizes + sizes[i] - both)) & (sizes > 0)
                for k in np.flatnonzero(linked & (roots != roots[i]) & (within | ~side)):
                    if roots[k] != roots[i]:
                        out.append((int(nodes[i]), int(nodes[k])))
                        roots[roots == roots[k]] = roots[i]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"]
            )

    return run


def _with_roots(buckets: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return buckets.withColumn("root", F.col("node"))
    roots = components(links)
    return buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _by_hash(salt: int) -> Column:
    return F.xxhash64("node", F.lit(salt))


def _meetings(buckets: DataFrame, salts: list[int]) -> DataFrame:
    """Pairs of each bucket member and the bucket's chosen members of other components."""
    member = F.struct("node", "root")
    chosen = [F.min(member)] if not salts else [F.min_by(member, _by_hash(s)) for s in salts]
    heads = (
        buckets.groupBy("key")
        .agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.array(*chosen).alias("heads"))
        .where("lo < hi")
        .select("key", F.explode("heads").alias("head"))
    )
    met = buckets.join(heads, "key").where("root <> head.root")
    return met.select(F.greatest("node", "head.node").alias("a"), F.least("node", "head.node").alias("b")).distinct()


def _confirmed(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    def side(name: str, *columns: str) -> DataFrame:
        return classes.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    wide = pairs.join(side("a", "n_shingles", "registers"), "a").join(side("b", "n_shingles", "registers"), "b")
    likely = wide.select("a", "b", "n_shingles_a", "n_shingles_b", "registers_a", "registers_b").mapInArrow(
        _likely(percent), "a long, b long"
    )
    text = [texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"]
    read = likely.join(text[0], "a").join(text[1], "b").select("a", "b", "text_a", "text_b")
    return read.mapInArrow(_linked(percent), "a long, b long")


def _blocks(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of buckets with several components, dealt to blocks of bounded size; each pair across components shares one."""
    many = buckets.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    left = buckets.join(many, "key")
    sizes = left.join(classes.select("node", "n_shingles"), "node")
    roots = sizes.groupBy("key", "root").agg(F.struct(F.count("*").alias("c"), "root", F.sum("n_shingles").alias("s")).alias("held"))
    kinds = roots.groupBy("key").agg(F.max("held").alias("main"), F.sum("held.s").alias("s"))
    parts = kinds.select(
        "key",
        F.col("main.root").alias("main"),
        F.expr(f"cast((s - main.s) div {BLOCK_SHINGLES} as int)").alias("s_last"),
        F.expr(f"cast(main.s div {BLOCK_SHINGLES} as int)").alias("m_last"),
    )
    straggler = F.col("root") != F.col("main")
    part = F.pmod(_by_hash(3), F.when(straggler, F.col("s_last")).otherwise(F.col("m_last")) + 1).cast("int")
    rows = left.join(parts, "key").withColumn("straggler", straggler).withColumn("part", part).drop("main")
    among = rows.where("straggler").select(
        "*", F.explode(F.sequence(F.lit(0), "s_last")).alias("other"), F.lit(True).alias("within")
    )
    across = rows.select(
        "*",
        F.explode(F.when(F.col("straggler"), F.sequence(F.lit(0), "m_last")).otherwise(F.sequence(F.lit(0), "s_last"))).alias("other"),
        F.lit(False).alias("within"),
    )
    low, high = F.least("part", "other"), F.greatest("part", "other")
    mine, theirs = F.when(F.col("straggler"), F.col("part")).otherwise(F.col("other")), F.when(
        F.col("straggler"), F.col("other")
    ).otherwise(F.col("part"))
    return among.withColumn("block", F.xxhash64("key", "within", low, high)).unionByName(
        across.withColumn("block", F.xxhash64("key", "within", mine, theirs))
    ).select("block", "node", "root", "straggler", "within")


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column(0)))
        sums = [_sums(shingles) for shingles in sets]
        columns = [[s0 for s0, _ in sums], [s1 for _, s1 in sums], list(map(len, sets))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["text", *SET])


def _texts(docs: DataFrame, classes: DataFrame, several: DataFrame, files: int) -> DataFrame:
    """(node, text): one text of each class. An id in `several` has texts of several classes; those are told apart by their sets."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    clear = classes.join(several, "doc_id", "left_anti").select("doc_id", "node")
    plain = ids.join(clear, "doc_id").groupBy("node").agg(F.max("text").alias("text")).coalesce(files)
    mixed = classes.join(several, "doc_id", "left_semi").select("doc_id", "node", *SET)
    told = ids.join(mixed.select("doc_id").distinct(), "doc_id", "left_semi").select("text").distinct()
    told = told.mapInArrow(_set_batches, "text string, s0 long, s1 long, n_shingles long")
    return plain.unionByName(told.join(mixed, SET).groupBy("node").agg(F.max("text").alias("text")))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * common shingles >= percent * all shingles;
    component_id is the smallest doc_id reachable over links.
    """
    rows = saved(sketch(docs), "sketches")
    n = rows.count()
    some = rows.where("n_shingles > 0 and doc_id is not null")
    kinds = some.groupBy(*SET).agg(
        F.min("doc_id").alias("doc_id"), F.first("registers").alias("registers"), F.first("bands").alias("bands")
    )
    # Groups keep no memory of a partition that they have read, so a task may read several.
    classes = saved(kinds.coalesce(n // FILE_ROWS + 1).withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    buckets = saved(keyed.join(shared, "key").select("key", "node"), "buckets", n)

    same_id = some.groupBy("doc_id", *SET).agg(F.lit(1).alias("one")).join(classes.select(*SET, "node"), SET)
    same_id = saved(same_id.select("doc_id", "node"), "held", n)
    several = same_id.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("doc_id", "a")
    links = saved(same_id.join(several, "doc_id").where("node > a").select("a", F.col("node").alias("b")), "confirmed", n)
    texts = saved(_texts(docs, classes.join(buckets.select("node").distinct(), "node", "left_semi"), several, n // FILE_ROWS + 1), "texts")

    for salts in ([], [1, 2]):
        rooted = _with_roots(buckets, links)
        found = _confirmed(_meetings(rooted, salts), classes, texts, percent)
        links = saved(links.unionByName(found), "confirmed", n)

    blocks = saved(_blocks(saved(_with_roots(buckets, links), "rooted", n), classes), "blocks", n)
    tasks = blocks.count() // TASK_ROWS + 1
    sort = lambda df: df.repartition(tasks, "block").sortWithinPartitions("block", "node")
    reach = sort(blocks.join(classes.select("node", "n_shingles", "registers"), "node")).select(
        "block", "node", "root", "straggler", "within", "n_shingles", "registers"
    )
    reach = reach.mapInArrow(_members_in_reach(percent), "block long, node long, root long, straggler boolean, within boolean")
    last = sort(saved(reach, "reach", n).join(texts, "node")).select("block", "node", "root", "straggler", "within", "text")
    links = saved(links.unionByName(last.mapInArrow(_links_in_block(percent), "a long, b long")), "confirmed", n)

    named = classes.select(*SET, "node", "doc_id").join(components(links), "node", "left")
    named = saved(named.select(*SET, "doc_id", F.coalesce("root", "node").alias("root")), "named", n)
    least = saved(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least", n)
    named = named.join(least, "root").select(*SET, "component_id")
    out = rows.select("doc_id", *SET).join(named, SET, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
