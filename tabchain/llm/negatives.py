"""Hard-negative mining by Kronecker-packed products.

The components of several candidates are biased until none is negative and put
side by side into separated fields of one wide integer. One multiplication by a
component of an anchor then multiplies all of them; since no field can overflow,
the sums over the components are read off the fields, and the biases are taken
away again. Scores are exact integers.

Anchors meet all rows in cells of a grid. A cell holds a bounded number of
components on either side, whatever the labels are, and passes on only the best
few of each anchor, which a window over the anchor combines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabchain.llm.common import stored

SCALE = 256
LABELS = 10
POSITIVES = 5
NEGATIVES = 10
#: Bounds of a negative's score, in hundredths of the positive's.
BAND = (30, 90)

#: Vector components that a cell of the grid holds at most, on average over cells:
#: 512 anchors and 16,384 candidates of 64 components.
ANCHOR_COMPONENTS = 512 * 64
CANDIDATE_COMPONENTS = 16_384 * 64
#: Words of partial sums that a task holds at a time.
WORDS_AT_ONCE = 1 << 19

#: Bits of a machine word that are used, and candidates per integer where it is too narrow.
WORD_BITS = 62
WIDE_FIELDS = 16
#: Scores beyond 64 bits are held at the ends of that range.
LARGEST = (1 << 63) - 1


class PackedCandidates:
    """Candidates' integer components, several candidates to one wide integer."""

    def __init__(self, components: np.ndarray, anchors: np.ndarray):
        """``components`` (candidates x d) and ``anchors`` (any x d), both of integers."""
        self.count, self.depth = components.shape
        self.shift = -min(0, *(int(x.min(initial=0)) for x in (components, anchors)))
        largest = [int(x.max(initial=0)) + self.shift for x in (components, anchors)]
        self.bits = max(1, (largest[0] * largest[1] * max(1, self.depth)).bit_length())
        narrow = self.bits <= WORD_BITS
        self.fields = WORD_BITS // self.bits if narrow else WIDE_FIELDS
        self.kind = np.uint64 if narrow else object
        biased = (components.astype(object) if not narrow else components) + self.shift
        padding = -self.count % self.fields
        biased = np.vstack([biased, np.zeros((padding, self.depth), biased.dtype)]).astype(self.kind)
        parts = biased.reshape(len(biased) // self.fields, self.fields, self.depth)
        self.words = np.zeros((self.depth, len(parts)), self.kind)
        for field in range(self.fields):
            self.words |= parts[:, field].T << self._number(field * self.bits)
        self.sums = components.astype(object if not narrow else np.int64).sum(axis=1)

    def _number(self, value: int):
        return np.uint64(value) if self.kind is np.uint64 else value

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products (anchors x candidates), as 64-bit numbers."""
        exact = object if self.kind is object else np.int64
        biased = (anchors.astype(exact) + self.shift).astype(self.kind)
        total = np.zeros((len(anchors), self.words.shape[1]), self.kind)
        for row, anchor in zip(total, biased, strict=True):
            for component, words in zip(anchor, self.words, strict=True):
                row += words * component
        mask = self._number((1 << self.bits) - 1)
        unpacked = np.empty((*total.shape, self.fields), self.kind)
        for field in range(self.fields):
            unpacked[:, :, field] = (total >> self._number(field * self.bits)) & mask
        products = unpacked.reshape(len(anchors), -1)[:, : self.count].astype(exact)
        # (a + s)(c + s) = ac + s(a + s) + sc, summed over the components
        own = biased.astype(exact).sum(axis=1) * self.shift
        products = products - own[:, None] - (self.sums * self.shift)[None, :]
        if exact is object:
            products = np.clip(products, -LARGEST, LARGEST)
        return products.astype(np.int64)


def best(scores: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` places of ``among`` (ascending) with the highest scores, ties by place."""
    if len(among) > n:
        found = scores[among]
        least = np.partition(found, len(found) - n)[len(found) - n]
        among = among[found >= least]
    return among[np.argsort(-scores[among], kind="stable")[:n]]


def band(positive: int) -> tuple[int, int]:
    """Least and largest score of a negative that counts beside a positive of this score."""
    return -(-BAND[0] * positive // 100), BAND[1] * positive // 100


def _integers(lists: pa.Array) -> np.ndarray:
    """Matrix of components, short vectors filled up with zeros."""
    rows = [np.asarray(x, np.float64) for x in lists.to_numpy(zero_copy_only=False)]
    matrix = np.zeros((len(rows), max(map(len, rows), default=0)))
    for row, values in zip(matrix, rows, strict=True):
        row[: len(values)] = values
    if np.abs(matrix).max(initial=0) < 1 << 53:
        return matrix.astype(np.int64)
    return np.array([[int(x) for x in row] for row in matrix], object)


class Cell:
    """Anchors and candidates of one cell; candidates in the order that breaks ties."""

    def __init__(self, anchors: pa.Table, candidates: pa.Table):
        candidates = candidates.sort_by([("vec_id", "ascending"), ("row", "ascending")])  # nulls last
        self.anchors, self.candidates = anchors, candidates
        left = _integers(anchors["components"].combine_chunks())
        right = _integers(candidates["components"].combine_chunks())
        width = max(left.shape[1], right.shape[1])
        self.left, self.right = (
            np.hstack([m, np.zeros((len(m), width - m.shape[1]), m.dtype)]) for m in (left, right)
        )
        self.label = anchors["label"].to_numpy()
        self.row = anchors["row"].to_numpy()
        self.other_label = candidates["label"].to_numpy()
        self.other_row = candidates["row"].to_numpy()

    def scored(self, same: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per anchor: its number, the candidates of its own (or of other) labels, their scores."""
        for label in np.unique(self.label):
            among = np.flatnonzero((self.other_label == label) == same)
            mine = np.flatnonzero(self.label == label)
            if not len(among):
                continue
            packed = PackedCandidates(self.right[among], self.left[mine])
            step = max(1, WORDS_AT_ONCE // packed.words.shape[1])
            for first in range(0, len(mine), step):
                some = mine[first : first + step]
                for k, scores in zip(some, packed.scores(self.left[some]), strict=True):
                    yield int(k), among, scores


def _taken(cell: Cell, found: list[tuple], schema: pa.Schema, names: list[str]) -> pa.Table:
    """Rows of ``(anchor, candidate, score, *more)``; ids are taken from the cell."""
    columns = list(zip(*found, strict=True)) if found else [()] * (3 + len(names))
    mine, other = (pa.array(c, pa.int64()) for c in columns[:2])
    values = {
        "anchor_row": cell.anchors["row"].take(mine),
        "anchor_id": cell.anchors["vec_id"].take(mine),
        "row": cell.candidates["row"].take(other),
        "vec_id": cell.candidates["vec_id"].take(other),
        "score": pa.array(columns[2], pa.int64()),
    } | {name: pa.array(c, schema.field(name).type) for name, c in zip(names, columns[3:], strict=True)}
    return pa.table({f.name: values[f.name] for f in schema}, schema=schema)


_FOUND = [(c, pa.int64()) for c in ("anchor_row", "anchor_id", "row", "vec_id", "score")]
_POSITIVES = pa.schema(_FOUND)
_NEGATIVES = pa.schema([*_FOUND, ("positive", pa.int32())])
_POSITIVES_SQL = "anchor_row long, anchor_id long, row long, vec_id long, score long"


def _positives(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
    if not anchors.num_rows or not candidates.num_rows:
        return _POSITIVES.empty_table()
    cell, found = Cell(anchors, candidates), []
    for k, among, scores in cell.scored(same=True):
        others = np.flatnonzero(cell.other_row[among] != cell.row[k])
        found += [(k, int(among[i]), int(scores[i])) for i in best(scores, others, POSITIVES)]
    return _taken(cell, found, _POSITIVES, [])


def _negatives(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
    if not anchors.num_rows or not candidates.num_rows:
        return _NEGATIVES.empty_table()
    cell, found = Cell(anchors, candidates), []
    positives = anchors["positive_scores"].to_pylist()
    for k, among, scores in cell.scored(same=False):
        for number, positive in enumerate(positives[k], 1):
            least, largest = band(positive)
            inside = np.flatnonzero((scores >= min(least, LARGEST)) & (scores <= largest))
            found += [(k, int(among[i]), int(scores[i]), number) for i in best(scores, inside, NEGATIVES)]
    return _taken(cell, found, _NEGATIVES, ["positive"])


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(row, vec_id, label, components)`` of the rows that take part, numbered and stored."""
    finite = F.forall(
        vector_col, lambda x: F.coalesce(F.abs(SCALE * x.cast("double")) < float("inf"), F.lit(False))
    )
    label = F.col(label_col).cast("long")
    moved = F.when(F.col(id_col) % 7 == 0, (label + 1) % LABELS).otherwise(label)
    # floor() of a double is a 64-bit number, so what is larger stays as it is: it has no fraction.
    components = F.transform(
        F.transform(vector_col, lambda x: SCALE * x.cast("double")),
        lambda x: F.when(F.abs(x) < 1e15, F.floor(x).cast("double")).otherwise(x),
    )
    return stored(
        vectors.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).cast("long").alias("vec_id"),
            moved.alias("label"),
            components.alias("components"),
        ),
        "negatives-rows",
    )


def first_rows(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first ``n`` of each key by score, ties by id (null last), with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def hard_negatives(
    vectors: DataFrame,
    every: int = 100,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchor_components: int = ANCHOR_COMPONENTS,
    candidate_components: int = CANDIDATE_COMPONENTS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Anchors are the rows whose id is divisible by ``every``. An anchor's positives
    are its first five other rows of the same label, its negatives, per positive,
    the first ten rows of other labels whose score lies between 30 and 90
    hundredths of the positive's. A positive with a negative score has none, one of
    score 0 those of score 0.

    Rows without a label or a vector, and rows with a component that is null or
    whose 256-fold isn't a finite number, take no part. A row without an id is no
    anchor and comes last among ties. Rows that repeat an id, whole copies
    too, are rows of their own, as anchors and as candidates. A vector shorter than
    another counts as if zeros followed; an empty one has score 0 with all. Scores
    beyond 64 bits are held at the ends of that range. Anchors without positives
    or without negatives give no rows, nor does an empty table; other columns are
    ignored, whatever their names.
    """
    rows = usable(vectors, id_col, vector_col, label_col)
    is_anchor = F.col("vec_id") % every == 0
    size = F.size("components")
    total = rows.agg(F.sum(size).alias("all"), F.sum(F.when(is_anchor, size)).alias("anchors")).first()
    parts = max(1, -(-(total["anchors"] or 0) // anchor_components))
    groups = max(1, -(-(total["all"] or 0) // candidate_components))

    def dealt(n: int):
        """Number of a cell, by a hash of the row's own number: no value of the data is a hot key."""
        return F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")

    def everywhere(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def cells(anchors: DataFrame, work, schema: str) -> DataFrame:
        left = anchors.select("*", dealt(parts).alias("part"), everywhere(groups).alias("grp"))
        right = rows.toDF(*rows.columns).select("*", dealt(groups).alias("grp"), everywhere(parts).alias("part"))
        return left.groupBy("part", "grp").cogroup(right.groupBy("part", "grp")).applyInArrow(work, schema)

    anchors = rows.filter(is_anchor)
    positives = stored(
        first_rows(cells(anchors, _positives, _POSITIVES_SQL), ["anchor_row"], POSITIVES), "negatives-positives"
    )
    ranked = F.sort_array(F.collect_list(F.struct("rank", "score")))
    scored = positives.groupBy(F.col("anchor_row").alias("row")).agg(ranked["score"].alias("positive_scores"))
    found = cells(anchors.join(scored, "row"), _negatives, f"{_POSITIVES_SQL}, positive int")
    chosen = first_rows(found, ["anchor_row", "positive"], NEGATIVES)
    return chosen.select(
        "anchor_row", "anchor_id", F.col("vec_id").alias("negative_id"), "rank",
        F.col("score").alias("negative_score"), F.col("positive").alias("positive_rank"),
    ).join(
        positives.select(
            "anchor_row", F.col("rank").alias("positive_rank"),
            F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
        ),
        ["anchor_row", "positive_rank"],
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
