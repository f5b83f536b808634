"""Merkle manifest of a data set: a digest for each row, a tree for each group, a witness for each row.

A leaf is H (lower-case hex SHA-256) of the row's fields, each `-` if null, else
its UTF-8 byte count, `:` and its value. In each group the leaves ascend by the
given order; while several nodes remain, every FAN consecutive ones become their
H. The groups' roots, by group (null first), make one more tree.

1. Leaves are dealt by ranges and numbered (`order.numbered`), so a group that
   holds most rows is many ranges.
2. Aligned blocks of FAN ** LEVELS nodes are appended to an open tree one node after the
   other (`Appender`): a subtree that is still open holds partial witnesses of its
   leaves; when its last sibling comes, its node and the siblings' digests extend
   them. What closes a block is one node, a further append of the next round.
3. From the last round back, each block appends its nodes again and adds to their
   witnesses that of the block's own node.

A witness is the path to the root: at each step the place in the run and the
digests of the others, left to right. `folded` recomputes a root from it.

Cases: any column may be null; null groups are a group, null order values come
first. Rows equal in group and order are ordered by their digest. Repeated rows
are leaves of their own. An empty table gives no rows. A group or the data set
with a single node is that node. Columns named like the results are replaced.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.order import by_ranges, numbered
from orderlens.llm.store import saved

FAN = 16
LEVELS = 3  # of a block, if not given
WITNESS = "array<struct<at: int, siblings: string>>"
_ARROW_WITNESS = pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.string())]))
_NODE = "tree string, position long, n long, digest string"


def leaf_digest(*fields: Column) -> Column:
    """Hex digest of a row's fields; byte counts keep neighbours apart."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


class Appender:
    """An open tree: `witness[i]` grows whenever a subtree above the i-th appended node closes."""

    def __init__(self) -> None:
        self.open: list[list[tuple[str, range]]] = [[]]
        self.witness: list[list[tuple[int, str]]] = []

    def append(self, digest: str) -> None:
        at = len(self.witness)
        self.witness.append([])
        self._push(0, digest, range(at, at + 1))

    def _push(self, level: int, digest: str, below: range) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append((digest, below))
        if len(self.open[level]) == FAN:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [digest for digest, _ in run]
        for at, (_, below) in enumerate(run):
            step = (at, "".join(digests[:at] + digests[at + 1 :]))
            for i in below:
                self.witness[i].append(step)
        parent = sha256("".join(digests).encode()).hexdigest()
        self._push(level + 1, parent, range(run[0][1].start, run[-1][1].stop))

    def finish(self, height: int) -> str:
        """Close what is open below `height` and give the node there."""
        for level in range(height):
            if self.open[level]:
                self._close(level)
        return self.open[height][0][0]


def _height(nodes: int, levels: int) -> int:
    """Levels that a block of a tree of `nodes` closes: all of a block if the tree has several, else up to its root."""
    height = 0
    while height < levels and nodes > FAN**height:
        height += 1
    return height


def _appended(nodes: pa.Table, levels: int) -> tuple[Appender, str]:
    tree = Appender()
    for digest in nodes["digest"].to_pylist():
        tree.append(digest)
    return tree, tree.finish(_height(nodes["n"][0].as_py(), levels))


def _closed_block(levels: int, nodes: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("position")
    _, root = _appended(nodes, levels)
    n = -(-nodes["n"][0].as_py() // FAN**levels)
    return pa.table({"tree": nodes["tree"][:1], "position": nodes["block"][:1], "n": [n], "digest": [root]})


def _witnessed_block(levels: int, nodes: pa.Table, above: pa.Table) -> pa.Table:
    nodes = nodes.sort_by("position")
    out = nodes.select([c for c in nodes.column_names if c not in ("n", "block")])
    if not nodes.num_rows:
        return out.append_column("top", pa.array([], pa.string())).append_column("witness", pa.array([], _ARROW_WITNESS))
    tree, _ = _appended(nodes, levels)
    upper = [(step["at"], step["siblings"]) for step in above["witness"][0].as_py()]
    steps = [step for own in tree.witness for step in (*own, *upper)]
    ends = np.cumsum([0, *(len(own) + len(upper) for own in tree.witness)])
    pairs = pa.StructArray.from_arrays(
        [pa.array([at for at, _ in steps], pa.int32()), pa.array([digests for _, digests in steps], pa.string())],
        fields=list(_ARROW_WITNESS.value_type),
    )
    witness = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
    return out.append_column("top", pa.array([above["top"][0].as_py()] * len(nodes), pa.string())).append_column("witness", witness)


def _in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"position div {FAN**levels}"))


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """`nodes` (tree, position, n, digest), then the closed blocks of each round, until every tree is one node."""
    rounds = [nodes]
    largest = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        small = _in_blocks(rounds[-1].select("tree", "position", "n", "digest"), levels)
        closed = small.groupBy("tree", "block").applyInArrow(lambda nodes: _closed_block(levels, nodes), _NODE)
        rounds.append(saved(closed, "merkle"))
        if largest <= FAN**levels:
            return rounds
        largest = -(-largest // FAN**levels)


def _descended(rounds: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The first of `rounds` with `top` and `witness`, given those (tree, position, top, witness) of the last."""
    for nodes in reversed(rounds[:-1]):
        kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name != "n"]
        blocks = _in_blocks(nodes, levels).groupBy("tree", "block").cogroup(above.groupBy("tree", "position"))
        add = lambda low, high: _witnessed_block(levels, low, high)
        above = blocks.applyInArrow(add, ", ".join([*kept, "top string", f"witness {WITNESS}"]))
    return above


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf", levels: int = LEVELS) -> DataFrame:
    """`rows` with subroot (of the row's group), root and witness; `leaf` names the column of digests.

    A block has `levels` levels, FAN ** levels nodes.

    Give narrow rows: they are shuffled, their texts are not needed any more.
    """
    names = [c for c in rows.columns if c not in ("subroot", "root", "witness")]
    renamed = rows.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(names)])
    at = {c: f"__{i}" for i, c in enumerate(names)}
    tree = F.coalesce(F.concat(F.lit("="), F.col(at[group]).cast("string")), F.lit("-"))  # null comes first
    leaves = saved(
        renamed.withColumn("tree", tree).withColumn("digest", F.col(at[leaf])).withColumn("__made", F.monotonically_increasing_id()),
        "leaves",
    )
    ranged = by_ranges(leaves, "tree", *[at[c] for c in order], "digest", "__made").drop("__made")
    trees = _rounds(numbered(ranged, "tree", "leaves-in-order"), levels)
    groups = trees[-1].select(F.lit("").alias("tree"), "digest", F.col("tree").alias("name"))
    whole = _rounds(numbered(by_ranges(groups, "tree", "name"), "tree", "groups"), levels)
    top = whole[-1].select("tree", "position", F.col("digest").alias("top"), F.lit(None).cast(WITNESS).alias("witness"))
    top = top.withColumn("witness", F.coalesce("witness", F.array().cast(WITNESS)))
    named = _descended(whole, top, levels).select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("position"), F.struct("digest", "top").alias("tops"), "witness"
    )
    named = saved(named, "group-witnesses")
    below = named.select("tree", "position", F.col("tops.digest").alias("top"), "witness")
    out = _descended(trees, below, levels)
    root = whole[-1].agg(F.max("digest").alias("digest")).select("digest").scalar()
    return out.select(
        *[F.col(at[c]).alias(c) for c in names], F.col("top").alias("subroot"), root.alias("root"), F.col("witness")
    )


def proof_digest(witness: Column) -> Column:
    """H of all siblings of a witness, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda step: step["siblings"]), "").cast("binary"), 256)


def folded(digest: Column, witness: Column) -> Column:
    """The root that `digest` leads to with the siblings of `witness`."""

    def up(node: Column, step: Column) -> Column:
        cut = step["at"] * 64
        left, right = F.substring(step["siblings"], F.lit(1), cut), F.substring(step["siblings"], cut + 1, F.lit(64 * FAN))
        return F.sha2(F.concat(left, node, right).cast("binary"), 256)

    return F.aggregate(witness, digest, up)
