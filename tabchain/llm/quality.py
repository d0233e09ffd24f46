"""Quality scores by nearest-neighbour voting in a latent semantic space.

The terms of a text are pairs of neighbouring byte classes (single lower-case
letters and marks, one class each for capitals, digits, and bytes beyond ASCII)
and words said twice in a row, weighted by frequency and rarity. A truncated decomposition of a bounded sample
of labelled documents gives the latent space; the sample's vectors are sent to
all tasks. Every document is compared with all of them in blocks of exact cosine
products, and its nearest neighbours vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabchain.llm.common import stored

#: Labelled documents per label that are learned from; bounds what is broadcast to
#: 2 * PER_LABEL vectors of DIMENSIONS numbers and one matrix of TERMS x DIMENSIONS.
PER_LABEL = 1_500
DIMENSIONS = 48
NEIGHBOURS = 15
#: Similarities count by this power, so that near neighbours outweigh far ones.
SHARPNESS = 8
#: Score of 1 from which a document counts as good. Fixed value.
THRESHOLD = 0.3
#: Documents of one block of cosine products, and bytes of one block of counts.
BLOCK, BLOCK_BYTES = 256, 1 << 22

SCHEMA = "doc_id long, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
_COUNTS = pa.schema([("label", pa.int32()), ("drawn", pa.int64()), ("terms", pa.binary())])


def _classes() -> np.ndarray:
    """Class of each byte: a-z, capitals, digits, white space, other ASCII, the rest."""
    table = np.zeros(256, np.int64)
    for byte in range(256):
        c = chr(byte)
        if "a" <= c <= "z":
            table[byte] = byte - ord("a")
        elif "A" <= c <= "Z":
            table[byte] = 26
        elif "0" <= c <= "9":
            table[byte] = 27
        elif c == "\n":
            table[byte] = 28
        elif c <= " " or byte == 127:
            table[byte] = 29
        elif byte > 127:
            table[byte] = 30
        else:
            table[byte] = 31 + (byte % 33)
    return table


CLASS = _classes()
WIDTH = int(CLASS.max()) + 1
TERMS = WIDTH * WIDTH + 1
#: What one repeated word counts for, in pairs of bytes.
REPEAT_WEIGHT = 20


def term_counts(texts: list[bytes]) -> np.ndarray:
    """(texts, TERMS) counts of neighbouring byte classes, and of repeated words."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for k, text in enumerate(texts):
        for at in range(0, len(text), BLOCK_BYTES):
            codes = CLASS[np.frombuffer(text, np.uint8)[at : at + BLOCK_BYTES + 1]]
            out[k] += np.bincount(codes[:-1] * WIDTH + codes[1:], minlength=TERMS)
        words = text.split()
        out[k, -1] = REPEAT_WEIGHT * sum(map(eq, words, islice(words, 1, None)))
    return out


@dataclass
class Neighbours:
    """Term weights, projection to the latent space, labelled unit vectors, vote weights."""

    rarity: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        return unit(weighted(counts, self.rarity) @ self.projection)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 in the votes; the prior where nothing is similar."""
        cosine = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, cosine.shape[1])
        nearest = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        votes = np.clip(np.take_along_axis(cosine, nearest, axis=1), 0, 1) ** SHARPNESS
        total = votes.sum(axis=1)
        good = (votes * self.labels[nearest]).sum(axis=1)
        return np.where(total > 1e-9, good / np.maximum(total, 1e-9), self.prior)


def weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.sqrt(share) * rarity


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def fit(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Neighbours:
    """Latent space by a randomised decomposition; the same input gives the same space."""
    rarity = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = weighted(counts, rarity)
    rng = np.random.default_rng(5)
    basis = np.linalg.qr(x @ rng.standard_normal((x.shape[1], dimensions + 8)).astype(np.float32))[0]
    for _ in range(3):
        basis = np.linalg.qr(x @ np.linalg.qr(x.T @ basis)[0])[0]
    _, _, rows = np.linalg.svd(basis.T @ x, full_matrices=False)
    projection = np.ascontiguousarray(rows[:dimensions].T.astype(np.float32))
    return Neighbours(rarity, projection, unit(x @ projection), labels.astype(np.float32), float(labels.mean()))


def sample(labelled: DataFrame, per_label: int = PER_LABEL) -> tuple[np.ndarray, np.ndarray]:
    """Counts and labels of the first ``per_label`` documents of each label by hash.

    ``labelled`` holds ``text, label, drawn``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                counts = term_counts([(t.as_py() or "").encode() for t in part.column(2)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([c.tobytes() for c in counts], pa.binary())], schema=_COUNTS
                )

    chosen = None
    for label in (0, 1):
        part = labelled.filter(F.col("label") == label).orderBy("drawn", "text").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    counted = chosen.select(F.col("label").cast("int").alias("label"), "drawn", "text").mapInArrow(count, "label int, drawn long, terms binary")
    rows = stored(counted, "quality-sample").orderBy("drawn", "label", "terms").collect()
    if not rows:
        return np.empty((0, TERMS), np.float32), np.empty(0)
    return np.stack([np.frombuffer(r.terms, np.float32) for r in rows]), np.array([r.label for r in rows])


def score_quality(docs: DataFrame, model: Neighbours | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row, from its whole text.

    A null, empty or one-byte text has no terms and scores the sample's share of
    label 1; so does every text if nothing was labelled (then 0.5). Rows that repeat
    score alike. Other columns are ignored. No rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                if known is None:
                    values = np.full(part.num_rows, 0.5)
                else:
                    counts = term_counts([(t.as_py() or "").encode() for t in part.column(1)])
                    values = np.clip(known.scores(counts), 0, 1).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values)], schema=_ARROW)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, held_out, per_label: int = PER_LABEL) -> DataFrame:
    """Learn from labelled rows that aren't held out, score all rows.

    ``docs`` holds ``doc_id, text``; ``labels`` holds ``doc_id, quality``. Ids that
    several labels contradict are left out of learning, as are null labels.
    """
    known = (
        labels.filter("quality is not null and doc_id is not null")
        .filter(~held_out)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
        .filter("label = other")
        .withColumn("drawn", F.xxhash64("doc_id"))
    )
    first = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy("drawn", "doc_id").limit(per_label)
        first = part if first is None else first.unionByName(part)
    # At most 2 * per_label ids, labels and hashes.
    joined = docs.select("doc_id", "text").join(F.broadcast(first.select("doc_id", "label", "drawn")), "doc_id")
    counts, marks = sample(joined, per_label)
    return score_quality(docs, fit(counts, marks) if len(marks) else None)
