"""Exact quantiles of whole-number columns without gathering values in one task.

The built-in ``percentile`` keeps every distinct value in the memory of a single
task, which is right only where the number of distinct values is bounded by
construction (``descend=False``). Otherwise, at every size, the wanted ranks are
found by counting: values are counted in coarse,
order-preserving cells, the few cells that hold a wanted rank are kept, and only
those are counted again in finer cells, until a cell is one value. Counting has
a map-side step, so repeated values collapse early and no cell size depends on
how the data is skewed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.frames import as_struct, rows_from_columns
from orderlens.functions.numeric import rnd

# First level: this many cells per power of two. Second level: at most 2**21
# cells inside one first-level cell. For magnitudes up to 2**53 a second-level
# cell then spans at most 2**20 whole numbers, which bounds the third level.
CELLS_PER_OCTAVE = 16384
SECOND_LEVEL_BITS = 20

# Before the first level, runs of this many of its cells are counted as one: at
# most 1,700 runs of a column meet in one task, and then the cells of few runs.
RUN_BITS = 10


# A logarithmic cell number that never decreases as v grows. The coalesce states
# that it is never NULL: otherwise each level would get its own NULL filter
# pushed below the shared shuffle, which could then not be reused.
_COARSE = (
    f"coalesce(cast(signum(double(v)) * floor(log2(abs(double(v)) + 1) * {CELLS_PER_OCTAVE}) as bigint), 0L)"
)

# Cell number inside a known range [low, high], at most 2**(bits + 1) different.
_FINE = f"shiftright(v - low, greatest(0, int(ceil(log2(high - low + 1D))) - {SECOND_LEVEL_BITS}))"

# Whole numbers add up to the same sum in any order.
_EXACT_SUM = "sum(cast(v AS decimal(19,0)) * cast(cnt AS decimal(19,0)))"

_CARRIED = ["first(n) AS n", "first(mean) AS mean"]


def _sql_double(x: float) -> str:
    return f"double('{float(x)!r}')"


def _wanted_ranks(probs: Sequence[float]) -> str:
    """Array of (tag, zero-based rank): tag 2i is the rank below prob i, 2i+1 above."""
    items = []
    for i, p in enumerate(probs):
        position = f"double(n - 1) * {_sql_double(p)}"
        items.append(f"named_struct('tag', {2 * i}, 'rank', bigint(floor({position})))")
        items.append(f"named_struct('tag', {2 * i + 1}, 'rank', bigint(ceil({position})))")
    return f"array({', '.join(items)})"


def _cells_with_ranks(cells: DataFrame, parent: str, order: str, wanted: str) -> DataFrame:
    """Keep the cells that contain a wanted rank, with ranks relative to the cell.

    The window runs over the cells of one parent, whose number is bounded.
    """
    upto = f"sum(cnt) OVER (PARTITION BY {parent} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    hit = f"filter({wanted}, w -> w.rank >= _upto - cnt AND w.rank < _upto)"
    relative = "transform(_hit, w -> named_struct('tag', w.tag, 'rank', w.rank - (_upto - cnt)))"
    kept = cells.selectExpr("*", f"{upto} AS _upto").selectExpr("*", f"{hit} AS _hit").filter("size(_hit) > 0")
    return kept.drop("wanted").selectExpr("*", f"{relative} AS wanted")


def value_counts(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Rows (d, v, cnt): how often value ``v`` occurs in the ``d``-th column.

    Every level of the search starts from this frame. Its shuffle is written
    once and read by all levels, so whatever lies below runs once.
    """
    units = df.select(*[c.cast("bigint").alias(f"_v{i}") for i, c in enumerate(columns)])
    pairs = ", ".join(f"named_struct('d', {i}, 'v', _v{i})" for i in range(len(columns)))
    values = units.selectExpr(f"inline(array({pairs}))").filter("v IS NOT NULL")
    return values.groupBy("d", "v").agg(F.count(F.lit(1)).alias("cnt"))


def _ranked_values(counts: DataFrame, probs: Sequence[float], descend: bool) -> DataFrame:
    """Rows (d, n, mean, v, tag): the value at every wanted rank of column ``d``."""
    totals = ["sum(cnt) OVER (PARTITION BY d) AS n", "double(sum(_sum) OVER (PARTITION BY d)) AS _total"]
    if descend:
        coarse = counts.selectExpr("d", "v", "cnt", f"{_COARSE} AS cell").selectExpr("*", f"shiftright(cell, {RUN_BITS}) AS run")
        runs = coarse.groupBy("d", "run").agg(*map(F.expr, ["sum(cnt) AS cnt", f"{_EXACT_SUM} AS _sum"]))
        runs = runs.selectExpr("*", *totals).selectExpr("d", "run", "cnt", "n", "_total / n AS mean")
        found = _cells_with_ranks(runs, "d", "run", _wanted_ranks(probs))
        cells = (
            coarse.join(F.broadcast(found.select("d", "run", "n", "mean", "wanted")), ["d", "run"])
            .groupBy("d", "run", "cell", "wanted")
            .agg(*map(F.expr, ["sum(cnt) AS cnt", "min(v) AS low", "max(v) AS high", *_CARRIED]))
        )
        found = _cells_with_ranks(cells, "d, run", "cell", "wanted")
    else:
        cells = counts.selectExpr("d", "v AS cell", "cnt", "v AS low", "v AS high", "cast(v AS decimal(19,0)) * cast(cnt AS decimal(19,0)) AS _sum")
        cells = cells.selectExpr("*", *totals).selectExpr("d", "cell", "cnt", "low", "high", "n", "_total / n AS mean")
        found = _cells_with_ranks(cells, "d", "cell", _wanted_ranks(probs))
    if descend:
        # All joins broadcast at most 2 * len(probs) rows per column.
        fine = (
            coarse.join(F.broadcast(found.select("d", "cell", "low", "high", "n", "mean", "wanted")), ["d", "cell"])
            .selectExpr("d", "cell", f"{_FINE} AS sub", "v", "cnt", "n", "mean", "wanted")
            # An array can be a hash key but not a hash buffer, so it rides along as a key.
            .groupBy("d", "cell", "sub", "wanted")
            .agg(*map(F.expr, ["sum(cnt) AS cnt", "min(v) AS low", "max(v) AS high", *_CARRIED]))
        )
        found = _cells_with_ranks(fine, "d, cell", "sub", "wanted")
        single = (
            coarse.join(
                F.broadcast(found.select("d", "cell", "sub", "low", "high", "n", "mean", "wanted")), ["d", "cell"]
            )
            .filter("v BETWEEN low AND high")
            .selectExpr("d", "cell", "sub", "v AS low", "cnt", "n", "mean", "wanted")
        )
        found = _cells_with_ranks(single, "d, cell, sub", "low", "wanted")
    return found.selectExpr("d", "n", "mean", "low AS v", "explode(wanted.tag) AS tag")


def deviations(counts: DataFrame) -> DataFrame:
    """Rows (d, dev): sample deviation of every column, from its value counts.

    The mean is known before squares are summed, so columns far from zero lose
    no digits. Both steps read the shuffle that the quantile search reads.
    """
    means = counts.groupBy("d").agg(*map(F.expr, ["sum(cnt) AS n", f"double({_EXACT_SUM}) / sum(cnt) AS mean"]))
    squares = counts.join(F.broadcast(means), "d").groupBy("d").agg(
        F.first("n").alias("n"), F.expr("sum((v - mean) * (v - mean) * cnt)").alias("squares")
    )
    return squares.selectExpr("d", "CASE WHEN n > 1 THEN sqrt(squares / (n - 1)) END AS dev")


def order_statistics(
    df: DataFrame,
    columns: Mapping[str, Column],
    probs: Sequence[float],
    descend: bool = True,
) -> DataFrame:
    """For every column and probability: the two neighbouring order statistics.

    Returns ``(dim, prob, n, mean, lo, hi, frac)``; the continuous quantile is
    ``lo + frac * (hi - lo)``. Columns are BIGINT expressions with magnitudes up
    to 2**53; NULLs are ignored. ``descend=False`` ranks all distinct values at
    once, for columns with a bounded number of them.
    """
    counts = value_counts(df, list(columns.values()))
    return statistics_of_counts(counts, list(columns), probs, descend)


def statistics_of_counts(
    counts: DataFrame, names: Sequence[str], probs: Sequence[float], descend: bool
) -> DataFrame:
    """:func:`order_statistics` on value counts that already exist."""
    hits = _ranked_values(counts, probs, descend)
    labels = ", ".join(f"'{n}'" for n in names)
    prob = f"element_at(array({', '.join(map(_sql_double, probs))}), p + 1)"
    both = (
        hits.groupBy("d", F.expr("int(floor(tag / 2)) AS p"))
        .agg(
            *map(
                F.expr,
                [
                    "first(n) AS n",
                    "first(mean) AS mean",
                    "max(v) FILTER (WHERE tag % 2 = 0) AS lo",
                    "max(v) FILTER (WHERE tag % 2 = 1) AS hi",
                ],
            )
        )
        .selectExpr(f"element_at(array({labels}), d + 1) AS dim", f"{prob} AS prob", "n", "mean", "lo", "hi")
    )
    return both.selectExpr("*", "double(n - 1) * prob - floor(double(n - 1) * prob) AS frac")


def interpolated(lo: Column, hi: Column, frac: Column) -> Column:
    return lo.cast("double") + frac * (hi - lo).cast("double")


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, tuple[Column, float]],
    probs: Sequence[float],
    digits: int | None = 6,
    descend: bool = True,
) -> DataFrame:
    """Continuous quantiles as ``(dim, prob, n, mean, value)`` rows.

    ``columns`` maps a name to a BIGINT expression and the number of those units
    per output unit, e.g. 100 for cents or 3.6e9 for microseconds in hours.
    ``digits`` rounds away the last-bit noise of the interpolation.
    """
    stats = order_statistics(df, {n: c for n, (c, _) in columns.items()}, probs, descend)
    pairs = ", ".join(f"'{n}', {_sql_double(u)}" for n, (_, u) in columns.items())
    units = F.expr(f"element_at(map({pairs}), dim)")
    value = interpolated(F.col("lo"), F.col("hi"), F.col("frac")) / units
    value = value if digits is None else rnd(value, digits)
    return stats.select("dim", "prob", "n", (F.col("mean") / units).alias("mean"), value.alias("value"))


def quantile_row(
    df: DataFrame,
    columns: Mapping[str, tuple[Column, float]],
    probs: Mapping[str, float],
    digits: int | None = 6,
    descend: bool = True,
    deviation: bool = False,
) -> DataFrame:
    """The same quantiles as one row, with a column ``<name>_<suffix>`` each.

    ``probs`` maps suffix to probability. ``<name>_n`` and ``<name>_mean`` hold
    the number of values and their mean, ``<name>_dev`` with ``deviation`` their
    sample deviation. ``descend=False`` takes the built-in
    aggregate, for columns with a bounded number of distinct values.
    """
    build = _searched_row if descend else _percentile_row
    raw = build(df, [c for c, _ in columns.values()], list(probs.values()), deviation)
    out = []
    for d, (name, (_, unit)) in enumerate(columns.items()):
        out += [f"n{d} AS {name}_n", f"mean{d} / {_sql_double(unit)} AS {name}_mean"]
        out += [f"dev{d} / {_sql_double(unit)} AS {name}_dev"] if deviation else []
        for i, suffix in enumerate(probs):
            value = f"q{d}[{i}] / {_sql_double(unit)}"
            if digits is not None:
                value = f"double(round(cast({value} as decimal(28,10)), {digits}))"
            out.append(f"{value} AS {name}_{suffix}")
    return raw.selectExpr(*out)


def _percentile_row(df: DataFrame, columns: Sequence[Column], probs: Sequence[float], deviation: bool) -> DataFrame:
    """Count, mean, deviation and quantile array of each column, by built-in aggregates."""
    points = f"array({', '.join(map(_sql_double, probs))})"
    units = df.select(*[c.cast("bigint").alias(f"v{d}") for d, c in enumerate(columns)])
    parts = []
    for d in range(len(columns)):
        parts += [f"count(v{d}) AS n{d}", f"avg(v{d}) AS mean{d}", f"percentile(v{d}, {points}) AS q{d}"]
        parts += [f"stddev_samp(v{d}) AS dev{d}"] if deviation else []
    return units.selectExpr(*parts)


def _searched_row(df: DataFrame, columns: Sequence[Column], probs: Sequence[float], deviation: bool) -> DataFrame:
    """The same row from the counting search."""
    counts = value_counts(df, columns)
    hits = _ranked_values(counts, probs, True)
    if deviation:
        hits = hits.unionByName(deviations(counts), allowMissingColumns=True)
    picked, out = [], []
    for d in range(len(columns)):
        picked += [f"max(n) FILTER (WHERE d = {d}) AS n{d}", f"max(mean) FILTER (WHERE d = {d}) AS mean{d}"]
        picked += [f"max(dev) FILTER (WHERE d = {d}) AS dev{d}"] if deviation else []
        picked += [f"max(v) FILTER (WHERE d = {d} AND tag = {t}) AS v{d}_{t}" for t in range(2 * len(probs))]
        values = []
        for i, p in enumerate(probs):
            position = f"(double(n{d} - 1) * {_sql_double(p)})"
            low, high = f"v{d}_{2 * i}", f"v{d}_{2 * i + 1}"
            values.append(f"double({low}) + ({position} - floor({position})) * double({high} - {low})")
        out += [f"coalesce(n{d}, 0L) AS n{d}", f"mean{d}", *([f"dev{d}"] if deviation else []), f"array({', '.join(values)}) AS q{d}"]
    return hits.selectExpr(*picked).selectExpr(*out)


def quantile_struct(*args, **kwargs) -> Column:
    """:func:`quantile_row` as a scalar struct that can be used in any frame."""
    return as_struct(quantile_row(*args, **kwargs))


def winsorize(
    df: DataFrame, column: str, unit_digits: int, upper: float = 0.99, out: str | None = None
) -> DataFrame:
    """Cap a column at its own upper quantile; NULL stays NULL."""
    units = F.rint(F.col(column) * float(10**unit_digits)).cast("bigint")
    cap = quantile_struct(df, {"v": (units, 10.0**unit_digits)}, {"cap": upper}, digits=None)
    return df.withColumn("_cap", cap).withColumn(
        out or column, F.when(F.col(column).isNotNull(), F.least(F.col(column).cast("double"), F.col("_cap.v_cap")))
    ).drop("_cap")


def describe_numeric(
    df: DataFrame, columns: Mapping[str, tuple[Column, float]], digits: int = 4
) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max per column, in rows.

    Quartiles are exact and interpolated, unlike those of ``DataFrame.summary``.
    All statistics come from one set of value counts, so ``df`` runs once.
    ``_ord`` is the position of the statistic.
    """
    stats = {"min": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "max": 1.0}
    row = quantile_row(df, columns, stats, digits, deviation=True)
    shown = {"count": "n", "mean": "mean", "std": "dev", "min": "min", "25%": "q25", "50%": "q50", "75%": "q75", "max": "max"}
    return rows_from_columns(
        row,
        [
            {"_ord": F.lit(i), "stat": F.lit(stat), **{n: rnd(F.col(f"{n}_{field}"), digits) for n in columns}}
            for i, (stat, field) in enumerate(shown.items())
        ],
    )
