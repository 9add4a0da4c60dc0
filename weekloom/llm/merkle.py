"""Merkle manifest of a table: a tree of digests per key, a tree over the keys, and a witness per row.

A leaf is the digest of a row. Per key the leaves, in the order of their id, are the lowest level; while a
level has several nodes, every ``arity`` consecutive ones (the last run may have fewer, even one) become
their digest. The roots of the keys, in the order of the keys, are the leaves of one more such tree.

Rows get their place from a range partitioning by (key, id), so a key that holds most of the table is
spread over tasks, and blocks of ``arity ** BLOCK_LEVELS`` consecutive leaves are the units of work. Inside a
block digests are appended one by one: an appended node attaches a partial witness, the siblings to its
left, to the open subtree it joins, and each sibling completed later extends the witnesses already there.
The roots of the blocks are then appended in the same way, tier by tier, until one block is left per
key. Witnesses travel back down: what a tier found above a block is handed to each of its leaves.

Cases: null ids come first and a null key is a key of its own, the first; rows with equal ids are ordered by
their leaf; equal rows are leaves of their own with equal digests, whichever comes first; a text of any
length is digested where it lies and never shuffled; an empty table gives an empty result; only the columns
named are digested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.session import write_table

ARITY = 8
# Levels inside a block: 8 ** 4 leaves, 64 bytes each.
BLOCK_LEVELS = 4


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def record_digest(columns: Sequence[Column]) -> Column:
    """Digest of a row: each value as ``-`` where null, else its number of bytes, a colon and itself."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


class _Open:
    """A node whose children are still coming: their digests, and the witness each has so far."""

    __slots__ = ("digests", "left", "right", "members")

    def __init__(self):
        self.digests: list[str] = []
        self.left: list[str] = []
        self.right: list[str] = []
        self.members: list = []

    def add(self, node: str, member) -> None:
        self.right = [witness + node for witness in self.right]
        self.left.append("".join(self.digests))
        self.right.append("")
        self.digests.append(node)
        self.members.append(member)


class WitnessTree:
    """Digests appended one by one; afterwards each has its path of (siblings left, siblings right) to the root."""

    def __init__(self, arity: int = ARITY):
        self.arity = arity
        self.open: list[_Open] = [_Open()]
        # Per leaf (its open parent, its place there, the step of that parent once it is complete).
        self.steps: list[list] = []

    def append(self, leaf: str) -> None:
        step = [None, 0, None]
        self.steps.append(step)
        self._add(0, leaf, step)

    def _add(self, level: int, node: str, step: list) -> None:
        if level == len(self.open):
            self.open.append(_Open())
        at = self.open[level]
        step[0], step[1] = at, len(at.digests)
        at.add(node, step)
        if len(at.digests) == self.arity:
            self._close(level)

    def _close(self, level: int) -> None:
        """The subtree is complete: its digest is appended one level up, and its leaves go on from there."""
        at = self.open[level]
        self.open[level] = _Open()
        above = [None, 0, None]
        for step in at.members:
            step[2] = above
        self._add(level + 1, digest("".join(at.digests)), above)

    def finish(self, levels: int | None = None) -> str:
        """The root; with ``levels`` the tree has exactly that many, as part of a larger one."""
        level = 0
        while True:
            if level == len(self.open):
                self.open.append(_Open())
            at = self.open[level]
            above = any(o.digests for o in self.open[level + 1 :])
            last = not above and (len(at.digests) == 1 if levels is None else level == levels)
            if last:
                return at.digests[0]
            if at.digests:
                self._close(level)
            level += 1

    def path(self, leaf: int) -> tuple[list[str], list[str]]:
        """Per level the digests of the siblings on the left and on the right, each joined."""
        left, right = [], []
        step = self.steps[leaf]
        # The step of the root was added to a level that never closed and has no step above.
        while step[2] is not None:
            at, place = step[0], step[1]
            left.append(at.left[place])
            right.append(at.right[place])
            step = step[2]
        return left, right


def fold(node: str, left: Sequence[str], right: Sequence[str]) -> str:
    """The root that a node and its witness lead to."""
    for a, b in zip(left, right):
        node = digest(a + node + b)
    return node


def _tree(nodes: Sequence[str], arity: int, levels: int, whole: bool) -> tuple[WitnessTree, str]:
    tree = WitnessTree(arity)
    for node in nodes:
        tree.append(node)
    return tree, tree.finish(None if whole else levels)


def placed(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``, the place in its tree from 0, and ``total``, the tree's number of rows.

    Ranges of (tree, order, row number) are dealt out and sorted; a range adds what lies before it.
    """
    # The row number splits ranges even where rows are equal; equal rows may stand in any order.
    numbered = write_table(rows.withColumn("_row", F.monotonically_increasing_id()), "unplaced")
    ranged = numbered.repartitionByRange(tree, *order, "_row").sortWithinPartitions(tree, *order, "_row")
    ranged = ranged.drop("_row").withColumn("_seq", F.monotonically_increasing_id())
    ranged = write_table(ranged, "ranged")
    part = F.shiftright("_seq", 33)
    # One row per range and tree: their number is that of the ranges plus that of the trees.
    counts = ranged.groupBy(tree, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    counts = write_table(counts, "range-counts")
    own = Window.partitionBy(tree)
    before = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        F.col(tree).alias("_tree"),
        F.col("_part").alias("_p"),
        F.sum("_n").over(own).alias("total"),
        (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    mine = F.col(tree).eqNullSafe(F.col("_tree")) & (part == F.col("_p"))
    joined = ranged.join(write_table(offsets, "range-offsets"), mine)
    return joined.withColumn("pos", F.col("_seq") + F.col("_shift")).drop("_seq", "_tree", "_p", "_shift")


def _blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """The next tier ``(tree, pos, node, total)``: the roots of the blocks of ``nodes``."""
    size = arity**levels

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        total = table.column("total")[0].as_py()
        _, root = _tree(table.column("node").to_pylist(), arity, levels, total <= size)
        return pa.table(
            {
                "tree": table.column("tree")[:1],
                "pos": pa.array([table.column("pos")[0].as_py() // size], pa.int64()),
                "node": pa.array([root], pa.string()),
                "total": pa.array([-(-total // size)], pa.int64()),
            }
        )

    kind = nodes.schema["tree"].dataType.simpleString()
    grouped = nodes.select("tree", "pos", "node", "total").groupBy("tree", F.expr(f"pos div {size}"))
    return grouped.applyInArrow(run, f"tree {kind}, pos long, node string, total long")


_ABOVE = "pos long, left array<string>, right array<string>, subroot string, root string"


def _witnessed(nodes: DataFrame, above: DataFrame, arity: int, levels: int, run_rows, schema: str) -> DataFrame:
    """``run_rows`` on each block of ``nodes``: its table, its tree, and the witness above it."""
    size = arity**levels

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        whole = table.column("total")[0].as_py() <= size
        tree, _ = _tree(table.column("node").to_pylist(), arity, levels, whole)
        return run_rows(table, tree, {c: upper.column(c)[0].as_py() for c in ("left", "right", "subroot", "root")})

    below = nodes.groupBy("tree", F.expr(f"pos div {size}").alias("_block"))
    # cogroup matches null keys, as groupBy does.
    return below.cogroup(above.groupBy("tree", F.col("pos").alias("_block"))).applyInArrow(run, schema)


def _paths(table: pa.Table, tree: WitnessTree, upper: dict) -> pa.Table:
    """The witness of every node: its own in the block and that above the block."""
    paths = [tree.path(i) for i in range(table.num_rows)]
    strings = pa.list_(pa.string())
    return pa.table(
        {
            "tree": table.column("tree"),
            "pos": table.column("pos"),
            "left": pa.array([a + upper["left"] for a, _ in paths], strings),
            "right": pa.array([b + upper["right"] for _, b in paths], strings),
            "subroot": pa.array([upper["subroot"]] * len(paths), pa.string()),
            "root": pa.array([upper["root"]] * len(paths), pa.string()),
        }
    )


def _tiers(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """``nodes`` and the tiers of block roots above, the last with one node per tree."""
    tiers = [nodes]
    while tiers[-1].where("total > 1").take(1):
        # A tree that is down to one node stays as it is while others go on.
        tiers.append(write_table(_blocks(tiers[-1], arity, levels), "block-roots"))
    return tiers


def witnesses(leaves: DataFrame, run_rows, schema: str, arity: int = ARITY, levels: int = BLOCK_LEVELS) -> DataFrame:
    """``run_rows`` on blocks of ``leaves(tree, pos, node, total, ...)``, with the witness above each block."""
    tiers = _tiers(leaves, arity, levels)
    if len(tiers) == 1:  # single leaves only, each its own root
        tiers.append(leaves.select("tree", "pos", "node", "total"))
    subroots = tiers[-1].select(F.lit(0).alias("_one"), F.col("tree").alias("_key"), "node")
    keys = write_table(placed(subroots, "_one", ("_key",)).withColumnRenamed("_one", "tree"), "subroots")
    top = _tiers(keys, arity, levels)
    kind = leaves.schema["tree"].dataType.simpleString()
    above = top[-1].select(
        "tree",
        "pos",
        F.array().cast("array<string>").alias("left"),
        F.array().cast("array<string>").alias("right"),
        F.lit(None).cast("string").alias("subroot"),
        F.col("node").alias("root"),
    )
    for tier in reversed(top[:-1]):
        above = write_table(_witnessed(tier, above, arity, levels, _paths, f"tree int, {_ABOVE}"), "witnesses")
    # From places in the tree of keys to the keys themselves.
    above = keys.select("pos", "_key", "node").join(above.drop("tree"), "pos").select(
        F.col("_key").alias("tree"), F.lit(0).cast("long").alias("pos"), "left", "right", F.col("node").alias("subroot"), "root"
    )
    for tier in reversed(tiers[1:-1]):
        above = write_table(_witnessed(tier, above, arity, levels, _paths, f"tree {kind}, {_ABOVE}"), "witnesses")
    return _witnessed(leaves, above, arity, levels, run_rows, schema)


def manifest(
    rows: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    key_col: str = "lang",
    tampered: dict[str, Column] | None = None,
    tampered_where: Column | None = None,
    arity: int = ARITY,
    levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)`` per row.

    ``tampered`` replaces columns of the rows that meet ``tampered_where``: their leaf is digested anew and
    folded with the witness of the row as it was. ``verified`` says whether that still gives the root.
    """
    own = record_digest([F.col(c) for c in columns])
    changed = record_digest([(tampered or {}).get(c, F.col(c)) for c in columns])
    other = F.when(tampered_where, changed) if tampered and tampered_where is not None else F.lit(None)
    leaves = rows.select(
        F.col(id_col).alias("_id"), F.col(key_col).alias("tree"), own.alias("node"), other.cast("string").alias("shown")
    )
    leaves = write_table(placed(leaves, "tree", ("_id", "node")), "leaves")

    def prove(table: pa.Table, tree: WitnessTree, upper: dict) -> pa.Table:
        proofs, folded = [], []
        tail = "".join(a + b for a, b in zip(upper["left"], upper["right"]))
        for i, (node, shown) in enumerate(zip(table.column("node").to_pylist(), table.column("shown").to_pylist())):
            left, right = tree.path(i)
            proofs.append(digest("".join(a + b for a, b in zip(left, right)) + tail))
            folded.append(fold(fold(shown or node, left, right), upper["left"], upper["right"]))
        n = table.num_rows
        return pa.table(
            {
                "_id": table.column("_id"),
                "leaf": table.column("node"),
                "subroot": pa.array([upper["subroot"]] * n, pa.string()),
                "root": pa.array([upper["root"]] * n, pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(folded, pa.string()),
                "verified": pa.array([f == upper["root"] for f in folded], pa.bool_()),
            }
        )

    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return witnesses(leaves, prove, schema, arity, levels).withColumnRenamed("_id", id_col)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())
