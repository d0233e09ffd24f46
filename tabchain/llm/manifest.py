"""Merkle manifest of a dataset, with a witness per row, by incremental witnesses.

Rows are leaves of one tree per source, in the order of their ids; the roots of the
sources are the leaves of a last tree. A node is the hash of up to three children.

A block of consecutive leaves, aligned to a power of three, is appended leaf by
leaf: what is not yet complete is a short list of open subtrees, each with the
span of its leaves. When a subtree's siblings are complete, the siblings' digests
extend the witnesses of all leaves of its span, and the three become one open
subtree a level higher. The roots of all blocks are appended in the same way a
round later, until a tree has one node; what their witnesses gain holds for every
leaf below. Blocks are rows of their own to Spark, so a source of any size is many
tasks, and a task holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabchain.llm.common import stored

ARITY = 3
#: Levels of a block: 3 ** 8 = 6,561 leaves.
BLOCK_LEVELS = 8

STEP = "struct<left:binary,right:binary>"
_STEP = pa.struct([("left", pa.binary()), ("right", pa.binary())])
_APPENDED = pa.schema(
    [("tree", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("root", pa.binary()), ("path", pa.list_(_STEP))]
)
_APPENDED_SQL = f"tree string, block long, row long, root binary, path array<{STEP}>"
_ROW_BITS = 33  # monotonically_increasing_id: partition above, row number below


def leaf_text(columns: list[Column]) -> Column:
    """What a leaf hashes: per value its UTF-8 byte count, a colon, and itself; ``-`` for null."""

    def framed(column: Column) -> Column:
        value = column.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.concat(*map(framed, columns))


def hashed(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def tree_key(source: Column) -> Column:
    """Name of a source's tree. In byte order, no source (null) comes first."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit(""))


def node(children: list[bytes]) -> bytes:
    return sha256("".join(c.hex() for c in children).encode()).digest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Block:
    """Open subtrees of a block, and the witnesses of its leaves as far as they are known."""

    def __init__(self, levels: int):
        self.levels = levels
        self.rows: list[int] = []
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(levels + 1)]
        self.left: list[list[bytes]] = [[] for _ in range(levels)]
        self.right: list[list[bytes]] = [[] for _ in range(levels)]

    def append(self, row: int, digest: bytes) -> None:
        at = len(self.rows)
        self.rows.append(row)
        for side in (*self.left, *self.right):
            side.append(b"")
        self.open[0].append((digest, at, at + 1))
        level = 0
        while level < self.levels and len(self.open[level]) == ARITY:
            self._complete(level)
            level += 1

    def _complete(self, level: int) -> None:
        """The open subtrees of a level become one; each one's witnesses gain the others."""
        run, self.open[level] = self.open[level], []
        digests = [digest for digest, _, _ in run]
        for k, (_, first, end) in enumerate(run):
            self.left[level][first:end] = [b"".join(digests[:k])] * (end - first)
            self.right[level][first:end] = [b"".join(digests[k + 1 :])] * (end - first)
        self.open[level + 1].append((node(digests), run[0][1], run[-1][2]))

    def root(self) -> bytes:
        """Completes what is open, shorter runs as they are."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.open[self.levels][0][0]

    def table(self, tree: str, number: int) -> pa.RecordBatch:
        root, n = self.root(), len(self.rows)
        sides = [
            pa.array([side[level][k] for k in range(n) for level in range(self.levels)], pa.binary())
            for side in (self.left, self.right)
        ]
        offsets = pa.array(range(0, n * self.levels + 1, self.levels) if self.levels else [0] * (n + 1), pa.int32())
        path = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(sides, fields=list(_STEP)))
        same = [pa.array([value] * n, kind) for value, kind in ((tree, pa.string()), (number, pa.int64()))]
        return pa.RecordBatch.from_arrays(
            [*same, pa.array(self.rows, pa.int64()), pa.array([root] * n, pa.binary()), path], schema=_APPENDED
        )


def _append_all(block_levels: int):
    """Appends rows of ``(tree, block, position, n, row, digest)``, which come in this order."""
    size = ARITY**block_levels

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("tree", "block", "n", "row", "digest"))
            for tree, number, n, row, digest in zip(*columns, strict=True):
                if key != (tree, number):
                    if block is not None:
                        yield block.table(*key)
                    key, block = (tree, number), Block(height(n) if n <= size else block_levels)
                block.append(row, digest)
        if block is not None:
            yield block.table(*key)

    return run


def appended(nodes: DataFrame, block_levels: int) -> DataFrame:
    """``(tree, block, row, root, path)`` of ``(tree, position, n, row, digest)``, a row per node."""
    size = ARITY**block_levels
    return (
        nodes.withColumn("block", F.expr(f"position div {size}"))
        .repartition("tree", "block")
        .sortWithinPartitions("tree", "block", "position")
        .select("tree", "block", "n", "row", "digest")
        .mapInArrow(_append_all(block_levels), _APPENDED_SQL)
    )


def positioned(ordered: DataFrame) -> DataFrame:
    """Adds ``position`` in its tree and ``n``, the tree's leaves.

    ``ordered`` is stored, with ``id`` numbering partitions and rows in the order of
    trees and leaves. Partitions of a tree are counted and the counts summed up, so a
    tree of any size costs one row per partition.
    """
    part = F.shiftright("id", _ROW_BITS).alias("part")
    starts = ordered.groupBy("tree", part).agg(F.min("id").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(
        "tree", "part", "first",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"), F.sum("rows").over(tree).alias("n"),
    )
    return (
        ordered.withColumn("part", part)
        .join(starts, ["tree", "part"])
        .withColumn("position", F.col("before") + F.col("id") - F.col("first"))
        .drop("part", "first", "before")
    )


def in_order(leaves: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Leaves sorted by ranges of tree, ``order`` and row, stored with their ``id``."""
    keys = [F.col("tree"), *order, F.col("row")]
    return stored(
        leaves.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("id", F.monotonically_increasing_id()),
        name,
    )


def witnesses(nodes: DataFrame, block_levels: int) -> tuple[DataFrame, DataFrame]:
    """``(tree, row, root, path)`` for each of ``(tree, position, n, row, digest)``, and ``(tree, root)``.

    Every round appends the roots of the blocks of the round before.
    """
    size = ARITY**block_levels
    rounds, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while True:
        done = stored(appended(nodes, block_levels), "manifest-witnesses")
        rounds.append(done)
        if most <= size:
            break
        most = -(-most // size)
        # The n of a tree whose root is known is 1 from here on: it is appended as it is.
        sizes = nodes.groupBy("tree", F.expr(f"position div {size}").alias("block")).agg(F.first("n").alias("n"))
        roots = done.groupBy("tree", "block").agg(F.first("root").alias("digest"))
        nodes = roots.join(sizes, ["tree", "block"]).select(
            "tree", F.col("block").alias("position"), F.expr(f"(n + {size - 1}) div {size}").alias("n"),
            F.col("block").alias("row"), "digest",
        )
    last = rounds[-1]
    found = last.select("tree", "row", "root", "path")
    for done in reversed(rounds[:-1]):
        above = found.select("tree", F.col("row").alias("block"), "root", F.col("path").alias("above"))
        found = done.drop("root").join(above, ["tree", "block"])
        found = found.select("tree", "row", "root", F.concat("path", "above").alias("path"))
    return found, last.groupBy("tree").agg(F.first("root").alias("root"))


def folded(leaf: Column, path: Column) -> Column:
    """Root (hexadecimal) that a leaf (hexadecimal) and its witness lead to."""
    text = lambda side: F.lower(F.hex(side))
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(text(step["left"]), digest, text(step["right"])), 256))


def proof(path: Column) -> Column:
    """The siblings of a witness, level by level, left to right, in hexadecimal."""
    return F.lower(F.array_join(F.transform(path, lambda s: F.concat(F.hex(s["left"]), F.hex(s["right"]))), ""))


def manifest(
    docs: DataFrame,
    columns: list[str],
    extra: dict[str, Column] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """``(doc_id, leaf, subroot, root, path, *extra)``, a row per row; digests are binary.

    ``columns`` are what a leaf hashes. ``path`` is the witness: per level, from the
    leaf to the root, the digests left and right of the node, each side in one binary
    value. ``extra`` names further expressions over ``docs`` to be kept.

    A null value is hashed as ``-``, an empty text as ``0:``. Rows without a source
    are a tree of their own, the first; rows without an id come first in their tree.
    Rows of a tree that repeat an id follow by their leaf, so whole copies are
    neighbours and each has a witness of its own. A tree of one leaf has the leaf as
    its root, and a lone tree's root is the root of all. No rows give no rows.
    Columns that aren't named are ignored, whatever their names.
    """
    extra = extra or {}
    kept = {f"extra_{k}": value for k, value in enumerate(extra.values())}
    leaves = stored(
        docs.select(
            tree_key(F.col(source_col)).alias("tree"), F.col(id_col).alias("doc_id"),
            hashed(leaf_text([F.col(c) for c in columns])).alias("digest"), F.monotonically_increasing_id().alias("row"),
            *[value.alias(name) for name, value in kept.items()],
        ),
        "manifest-leaves",
    )
    order = [F.asc_nulls_first("doc_id"), F.col("digest")]
    ordered = in_order(leaves.select("tree", "doc_id", "digest", "row"), order, "manifest-order")
    found, subroots = witnesses(positioned(ordered).select("tree", "position", "n", "row", "digest"), block_levels)

    # The last tree: its leaves are the roots of the others, in the order of their keys.
    tops = subroots.select(
        F.lit("").alias("tree"), F.col("tree").alias("key"), F.col("root").alias("digest"), F.xxhash64("tree").alias("row")
    )
    tops = in_order(tops, [F.col("key")], "manifest-tops")
    above, _ = witnesses(positioned(tops).select("tree", "position", "n", F.col("id").alias("row"), "digest"), block_levels)
    trees = tops.select(F.col("key").alias("tree"), F.col("id").alias("row")).join(
        above.select("row", "root", F.col("path").alias("above")), "row"
    )
    return (
        leaves.join(found.select("row", F.col("root").alias("subroot"), "path"), "row")
        .join(trees.drop("row"), "tree")
        .select(
            "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "above").alias("path"),
            *[F.col(name).alias(as_name) for name, as_name in zip(kept, extra, strict=True)],
        )
    )
