"""Shards along a Hilbert curve over metadata, for files that several columns can prune.

1. Each dimension is quantised by its own percentiles, at most 2**BITS - 1 cut
   points each; these few values are all that comes to the driver. Strings are
   ranked as whole values: counts by distinct value are dealt by ranges, and a
   value's level follows from the rows with smaller values.
2. The Hilbert index of the quantised point (Skilling's transform) is the cell.
3. Rows are ranked by (cell, salt, order columns). Counts by cell and salt are
   summed up first; only the rank within one salt of one cell needs the rows
   together, so a cell with a third of all rows is spread over SALTS tasks.
4. The ranking is cut into runs: of equal row counts, at most one apart (law
   `rows`), or of near equal sizes (law `bytes`).

Equal texts with equal metadata lie in one cell, not necessarily in one shard.
Cases: a null dimension is the lowest value; null texts have no bytes. Rows that
tie in every order column are ordered by a hash of the row. An empty table gives
no rows. The columns shard, slot and law are added and take the place of columns
of that name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.order import by_ranges
from orderlens.llm.store import saved

BITS = 5
SALTS = 64
ROW_BYTES = 8


def _quantised(value: Column, cuts: Sequence[float] | Sequence[str]) -> Column:
    if not cuts:
        return F.lit(0).cast("long")
    return F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= value)).cast("long")


def _text_cuts(values: DataFrame, bits: int) -> list[str]:
    """The smallest string of every level but the lowest.

    `values` has one column, `value`. A string's level is the share of rows with
    smaller strings, so one that many rows hold takes a level alone. Distinct
    strings are ordered within ranges; only counts of ranges meet in one task.
    """
    counts = values.groupBy("value").agg(F.count("*").alias("n"))
    ranged = saved(by_ranges(counts, "value").withColumn("part", F.spark_partition_id()), "text-ranges")
    parts = ranged.groupBy("part").agg(F.sum("n").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"), F.sum("held").over(Window.partitionBy()).alias("rows"))
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    ranked = ranged.join(F.broadcast(parts), "part").withColumn("below", below)
    levels = ranked.withColumn("level", F.expr(f"(below * {1 << bits}) div rows")).where("level > 0")
    return sorted(r.cut for r in levels.groupBy("level").agg(F.min("value").alias("cut")).collect())


def hilbert_index(coordinates: Sequence[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point with `bits`-bit coordinates."""
    n = len(coordinates)
    steps = F.array(
        *(F.struct(F.lit(1 << q).cast("long").alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(n))
    )

    def undo(x: Column, step: Column) -> Column:
        first, own, low = x[0], F.get(x, step["i"]), step["q"] - 1
        high = own.bitwiseAND(step["q"]) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        return F.transform(
            x,
            lambda v, k: F.when(k == 0, first.bitwiseXOR(F.when(high, low).otherwise(swap)))
            .when((k == step["i"]) & ~high, v.bitwiseXOR(swap))
            .otherwise(v),
        )

    zero = F.lit(0).cast("long")
    x = F.aggregate(steps, F.array(*coordinates), undo) if bits > 1 else F.array(*coordinates)
    gray = F.transform(x, lambda _, k: F.aggregate(F.slice(x, 1, k + 1), zero, lambda a, b: a.bitwiseXOR(b)))
    masks = F.array(*(F.lit(1 << q).cast("long") for q in range(bits - 1, 0, -1))) if bits > 1 else F.array().cast("array<bigint>")

    def placed(g: Column) -> Column:
        flip = F.aggregate(
            masks, zero, lambda t, q: F.when(g[n - 1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)
        )
        order = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(1 << q).cast("long").alias("q")) for q in range(bits - 1, -1, -1) for d in range(n)))
        return F.aggregate(
            order,
            zero,
            lambda h, s: h * 2 + F.when(F.get(g, s["d"]).bitwiseXOR(flip).bitwiseAND(s["q"]) != 0, 1).otherwise(0),
        )

    return F.transform(F.array(gray), placed)[0]


def with_cell(df: DataFrame, dimensions: Mapping[str, Column], bits: int = BITS) -> DataFrame:
    """`df` with the Hilbert cell of its quantised dimensions (numbers or strings) as `__cell`."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    texts = {n for n, kind in df.select(*(c.alias(n) for n, c in dimensions.items())).dtypes if kind == "string"}
    cuts = {name: _text_cuts(df.select(dimensions[name].alias("value")), bits) for name in sorted(texts)}
    numbers = [F.percentile_approx(c, shares, 10_000).alias(name) for name, c in dimensions.items() if name not in texts]
    if numbers:
        found = df.agg(*numbers).first().asDict()
        cuts |= {name: sorted(set(found[name] or [])) for name in found}
    return df.withColumn("__cell", hilbert_index([_quantised(c, cuts[name]) for name, c in dimensions.items()], bits))


def _row_hash(df: DataFrame) -> Column:
    """A hash of all columns; those that hold maps take part as JSON."""
    held = [F.to_json(F.struct(F.col(f"`{n}`"))) if "map<" in kind else F.col(f"`{n}`") for n, kind in df.dtypes]
    return F.xxhash64(*held)


def hilbert_shards(
    df: DataFrame,
    shards: int,
    dimensions: Mapping[str, Column],
    order: Sequence[str],
    law: str = "rows",
    bits: int = BITS,
) -> DataFrame:
    """All rows of `df` with law, shard (0 to shards - 1) and slot (gapless from 0 in each shard)."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"law must be rows or bytes, not {law}")
    plain = df.drop("shard", "slot", "law")
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + ROW_BYTES
    celled = (
        with_cell(plain, dimensions, bits)
        .withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
        .withColumn("__size", size if law == "bytes" else F.lit(1).cast("long"))
    )
    counts = saved(celled.groupBy("__cell", "__salt").agg(F.count("*").alias("n"), F.sum("__size").alias("s")), "cells")
    cells = counts.groupBy("__cell").agg(F.sum("n").alias("cn"), F.sum("s").alias("cs"))
    # At most 2**(bits * dimensions) rows, whatever the table holds.
    below = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "__cell",
        *(F.coalesce(F.sum(c).over(below), F.lit(0)).alias(f"{c}_before") for c in ("cn", "cs")),
        *(F.sum(c).over(Window.partitionBy()).alias(f"{c}_all") for c in ("cn", "cs")),
    )
    within = Window.partitionBy("__cell").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(F.broadcast(cells), "__cell").select(
        "__cell",
        "__salt",
        (F.col("cn_before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("__rank0"),
        (F.col("cs_before") + F.coalesce(F.sum("s").over(within), F.lit(0))).alias("__size0"),
        F.col("cn_all").alias("__rows"),
        F.col("cs_all").alias("__total"),
    )
    tied = [*order, _row_hash(plain)]
    inside = Window.partitionBy("__cell", "__salt").orderBy(*tied)
    ranked = celled.join(starts, ["__cell", "__salt"]).withColumn("__rank", F.col("__rank0") + F.row_number().over(inside) - 1)
    if law == "rows":
        shard = F.expr(f"(__rank * {shards}) div __rows")
        first = F.expr(f"(shard * __rows + {shards - 1}) div {shards}")
        out = ranked.withColumn("shard", shard).withColumn("slot", F.col("__rank") - first)
    else:
        upto = F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        middle = F.col("__size0") * 2 + upto * 2 - F.col("__size")
        sized = ranked.withColumn("__middle", middle)
        sized = sized.withColumn("shard", F.expr(f"least({shards - 1}, (__middle * {shards}) div (2 * __total))"))
        firsts = sized.groupBy("shard").agg(F.min("__rank").alias("__first"))
        out = sized.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("__rank") - F.col("__first"))
    return out.select(*plain.columns, F.lit(law).alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
