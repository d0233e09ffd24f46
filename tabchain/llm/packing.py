"""Best-fit decreasing packing of documents into fixed windows.

Documents are packed in blocks of a bounded number of tokens, each block within
one task. Overlong documents are first cut into full windows. The remainders go,
longest first, into the open window that they leave fullest; a segment tree over
remaining capacities finds it. Then the emptiest windows are dissolved: their
pieces are cut to fill what the others lack, and the last one is cut at powers of
two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabchain.llm.tokens import encoder, vocabulary_path

WINDOW = 4096
END_ID = 2
#: Tokens that a task gathers before it packs them. Bounds its memory.
BLOCK_TOKENS = 1 << 21

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())]
)
#: A piece: number of the document in its block, first token, number of tokens.
Piece = tuple[int, int, int]


class CapacityTree:
    """Open windows by remaining capacity; finds the least capacity that suffices."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, capacity: int, window: int) -> None:
        self.open.setdefault(capacity, []).append(window)
        node = self.leaves + capacity
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return ``(capacity, window)`` of the tightest fit, if any."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            self.count[node] -= 1
            node >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: list[int], window: int = WINDOW) -> list[list[Piece]]:
    """Windows of pieces: full windows of long documents, then best-fit decreasing."""
    full, rests = [], []
    for doc, n in enumerate(lengths):
        cut = n - n % window
        full += [[(doc, at, window)] for at in range(0, cut, window)]
        if n > cut:
            rests.append((doc, cut, n - cut))
    rests.sort(key=lambda p: (-p[2], p[0]))
    tree, bins = CapacityTree(window), []
    for piece in rests:
        found = tree.take(piece[2])
        if found is None:
            found = window, len(bins)
            bins.append([])
        capacity, number = found
        bins[number].append(piece)
        if capacity > piece[2]:
            tree.add(capacity - piece[2], number)
    return full + bins


def settle(windows: list[list[Piece]], window: int = WINDOW) -> list[list[Piece]]:
    """Fill what windows lack with pieces of the emptiest; cut the last at powers of two."""
    used = [sum(p[2] for p in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda k: (-used[k], k))
    head, tail = 0, len(order) - 1
    settled: list[list[Piece]] = []
    spare: list[Piece] = []
    while head <= tail:
        current = windows[order[head]]
        lack = window - used[order[head]]
        head += 1
        while lack:
            if not spare:
                if head > tail:
                    break
                spare = list(windows[order[tail]])
                tail -= 1
            doc, at, n = spare.pop()
            taken = min(n, lack)
            current = [*current, (doc, at, taken)]
            lack -= taken
            if taken < n:
                spare.append((doc, at + taken, n - taken))
        if lack:
            settled += powers_of_two(current)
        else:
            settled.append(current)
    if spare:
        left = sum(p[2] for p in spare)
        if left:
            settled += powers_of_two(spare)
    return settled


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The same tokens in windows whose lengths are powers of two, the longest first."""
    total, out, queue = sum(p[2] for p in pieces), [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        need = total & (1 << bit)
        current = []
        while need:
            doc, at, n = queue.pop()
            taken = min(n, need)
            current.append((doc, at, taken))
            need -= taken
            if taken < n:
                queue.append((doc, at + taken, n - taken))
        if current:
            out.append(current)
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``.

    A document is the ids of its whole text and ``end_id``; a null or empty text is
    the end id alone. Each id lies in exactly one piece; ``ids`` holds them as
    little-endian unsigned 32-bit numbers. A sequence is padded to ``window``
    unless its length is a power of two. Rows that repeat, also in their ids, are
    documents of their own; a null id stays null. Other columns are ignored. No
    rows give no rows.

    Tasks pack what they read, without a shuffle; sequence numbers hold the task's
    number in their upper bits.
    """
    path = path or vocabulary_path()
    end = np.array([end_id], "<u2").tobytes()

    def packed(ids: list, tokens: list[bytes], sequence: int) -> Iterator[tuple[int, pa.RecordBatch]]:
        lengths = [len(t) // 2 for t in tokens]
        rows: list = [[], [], [], [], [], [], []]
        for pieces in settle(best_fit(lengths, window), window):
            offset = 0
            for doc, start, n in pieces:
                values = np.frombuffer(tokens[doc], "<u2", n, 2 * start).astype("<u4").tobytes()
                for column, v in zip(rows, (ids[doc], start, n, lengths[doc], sequence, offset, values), strict=True):
                    column.append(v)
                offset += n
            sequence += 1
            if len(rows[0]) >= 1000:
                yield sequence, pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, _ARROW, strict=True)], schema=_ARROW)
                rows = [[], [], [], [], [], [], []]
        yield sequence, pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = encoder(path)
        sequence = TaskContext.get().partitionId() << 36
        ids, tokens, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                tokens.append(words.encode(text) + end)
                held += len(tokens[-1]) // 2
                if held >= block_tokens:
                    for sequence, out in packed(ids, tokens, sequence):
                        yield out
                    ids, tokens, held = [], [], 0
        if ids:
            for sequence, out in packed(ids, tokens, sequence):
                yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
