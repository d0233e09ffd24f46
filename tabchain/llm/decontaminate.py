"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is cut into k + 1 pieces. A passage within
the budget holds at least one piece unchanged, so the places where a piece occurs
are the only ones to look at. An automaton over all pieces finds them in one pass;
Myers' bit-parallel edit distance verifies each place with the whole item.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed per character of an item.
ERROR_SHARE = 0.08
#: Characters of items that one pass over the documents looks for. A larger
#: benchmark takes more passes; this bounds what is broadcast and the automaton.
BLOCK_CHARS = 4_000_000

SCHEMA = "doc_id long, item_id long, distance int, start long, end long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]
)


def normalised(text: str | None) -> str:
    """Lower case, runs of white space as one blank."""
    return " ".join((text or "").lower().split())


def bit_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for k, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << k
    return masks


def distances(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> Iterator[int]:
    """Myers: least edits of the pattern ending at each character of ``text``.

    The match may start anywhere, or at the text's start if ``anchored``.
    """
    full = (1 << m) - 1
    top = 1 << (m - 1)
    up, down, score = full, 0, m
    carry = 1 if anchored else 0
    for c in text:
        equal = masks.get(c, 0)
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        plus = down | (~(horizontal | up) & full)
        minus = up & horizontal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = ((plus << 1) | carry) & full
        minus = (minus << 1) & full
        up = minus | (~(vertical | plus) & full)
        down = plus & vertical
        yield score


class Matcher:
    """All items of one block, ready to search texts."""

    def __init__(self, items: list[tuple[int | None, str]], share: float = ERROR_SHARE):
        import ahocorasick

        self.items = [(i, t, int(len(t) * share)) for i, t in ((i, normalised(t)) for i, t in items) if t]
        self.masks: dict[int, tuple[dict[str, int], dict[str, int]]] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, budget) in enumerate(self.items):
            cuts = [len(text) * j // (budget + 1) for j in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(text[a:b], []).append((number, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Per item, merged stretches of the text that its pieces point to."""
        found: dict[int, list[list[int]]] = {}
        for last, (n, places) in self.automaton.iter(text):
            for number, at in places:
                _, item, budget = self.items[number]
                begin = last + 1 - n - at
                low, high = max(0, begin - budget), min(len(text), begin + len(item) + budget)
                found.setdefault(number, []).append([low, high])
        for number, spans in found.items():
            spans.sort()
            merged = spans[:1]
            for low, high in spans[1:]:
                if low <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], high)
                else:
                    merged.append([low, high])
            found[number] = merged
        return found

    def best(self, number: int, window: str) -> tuple[int, int, int] | None:
        """``(distance, start, end)`` of the first best match within the budget."""
        _, item, budget = self.items[number]
        if number not in self.masks:
            self.masks[number] = bit_masks(item), bit_masks(item[::-1])
        forward, backward = self.masks[number]
        least, end = budget + 1, -1
        for k, d in enumerate(distances(forward, len(item), window)):
            if d < least:
                least, end = d, k + 1
        if end < 0:
            return None
        reach = window[max(0, end - len(item) - least) : end][::-1]
        for k, d in enumerate(distances(backward, len(item), reach, anchored=True)):
            if d == least:
                return least, end - k - 1, end
        return least, end, end

    def leaks(self, text: str | None) -> list[tuple[int | None, int, int, int]]:
        """``(item, distance, start, end)`` of every item within its budget of the text."""
        text = normalised(text)
        if not text or not self.items:
            return []
        out = []
        for number, spans in self.windows(text).items():
            found = [(m[0], low + m[1], low + m[2]) for low, high in spans if (m := self.best(number, text[low:high]))]
            if found:
                out.append((self.items[number][0], *min(found)))
        return sorted(out, key=lambda r: (r[2], r[3], r[0] is not None, r[0]))


_MATCHERS: dict[tuple, Matcher] = {}


def _matcher(block: tuple, share: float) -> Matcher:
    """One matcher per process and block; ``block`` is its name and broadcast items."""
    name, shared = block
    if (name, share) not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name, share] = Matcher(shared.value, share)
    return _MATCHERS[name, share]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator:
    """Names and broadcast lists of items of about ``block_chars`` characters each."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.length("text") + F.lit(16))).first()[0] or 0
    count = max(1, -(-size // block_chars))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(count)))
    for block in range(count):
        rows = numbered.filter(F.col("block") == block).orderBy("item_id", "text").collect()
        yield uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in rows])


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    share: float = ERROR_SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``(doc_id, item_id, distance, start, end)``: the best match of each item in each row.

    Texts are compared in lower case with runs of white space as one blank; ``start``
    and ``end`` count characters of that form. An item matches within
    ``share`` of its length in edits. Null and empty texts and items match nothing.
    Rows that repeat are searched each for itself; so are items. Null ids stay null.
    Other columns are ignored. No rows or no items give no rows.
    """

    def search(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(block, share)
            for batch in batches:
                found: list[list] = [[], [], [], [], []]
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    for leak in matcher.leaks(text.as_py()):
                        for column, value in zip(found, (doc_id.as_py(), *leak), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(found, _ARROW, strict=True)], schema=_ARROW)

        return run

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in blocks(benchmark, item_col, item_text, block_chars):
        part = texts.mapInArrow(search(block), SCHEMA)
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ``text`` holds no item."""
    at = docs.columns.index("text")

    def drop(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(block, share)
            for batch in batches:
                clean = [not matcher.leaks(t.as_py()) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for block in blocks(benchmark, "item_id", "text", block_chars):
        docs = docs.mapInArrow(drop(block), docs.schema)
    return docs
