"""Range buckets, quantile bins and rule-based labels as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderlens.functions.numeric import as_column


def bucket_index(value: Column | str, edges: Sequence[float]) -> Column:
    """Index of the right-closed range that holds ``value``; the last one is open."""
    value = as_column(value)
    branches = F.when(value <= F.lit(edges[0]), F.lit(0))
    for position, edge in enumerate(edges[1:], start=1):
        branches = branches.when(value <= F.lit(edge), F.lit(position))
    return F.when(value.isNotNull(), branches.otherwise(F.lit(len(edges))))


def bucket_label(index: Column | str, labels: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(label) for label in labels]), as_column(index) + 1)


def bin_count(edges: Sequence[str]) -> Column:
    """How many bins remain once equal neighbouring edges are merged.

    ``edges`` are SQL expressions in ascending order.
    """
    return F.expr(" + ".join(f"int({high} > {low})" for low, high in zip(edges, edges[1:])))


def bin_index(value: str, edges: Sequence[str]) -> Column:
    """Zero-based bin of ``value`` among merged, right-closed quantile edges.

    It is the number of distinct edges after the first that lie below the value.
    Written as a sum of comparisons so that it stays in generated code.
    """
    passed = [f"int({high} > {low} AND {high} < {value})" for low, high in zip(edges, edges[1:])]
    return F.expr(" + ".join(passed))


def ascending_score(value: str, edges: Sequence[str]) -> Column:
    return bin_index(value, edges) + 1


def descending_score(value: str, edges: Sequence[str]) -> Column:
    return bin_count(edges) - bin_index(value, edges)


def named(code: str, labels: Mapping[str, str]) -> Column:
    """The label of a code expression; NULL for an unknown code."""
    quote = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    pairs = ", ".join(f"{quote(k)}, {quote(v)}" for k, v in labels.items())
    return F.expr(f"element_at(map({pairs}), {code})")
