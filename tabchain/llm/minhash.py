"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Signatures take two permutations of the 32-bit numbers in all: the first scatters
the hashes of a set, the second, shifted circularly by k, gives coordinate k.
Documents with equal sets of shingles are one class. Classes that share a band
form a bucket; its members are compared with one leader first, never all with all.
A bucket whose members are one component then is settled. In the others, members
outside the bucket's largest component are held against the rest by a sketch of
their whole sets that bounds the difference from below; what the bound cannot
rule out is verified on the full sets. No link between components is lost that a
shared band could show.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabchain.llm.common import stored
from tabchain.llm.graph import components

#: Bands and rows of a band. Two sets of similarity 0.8 share no band with a
#: probability of (1 - 0.8 ** 5) ** 40, about 1 in 8 million.
BANDS, ROWS = 40, 5
#: Similarity as a percentage.
PERCENT = 80
#: 64-bit words of the parity sketch.
SKETCH = 32

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_SCATTER = (np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_SECOND = (np.uint32(0x2C1B3C6D), np.uint32(0x297A2D39))
_BLOCK = 512


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _Q
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles.

    A-Z count as a-z, words end at ASCII white space. Fewer words than a shingle
    has are one shingle of their own length.
    """
    from xxhash import xxh3_64_intdigest

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    k = min(words, len(tokens))
    with np.errstate(over="ignore"):
        rolled = np.full(len(tokens) - k + 1, np.uint64(k) * _P)
        for j in range(k):
            rolled = _mix(rolled * _P + hashes[j : j + len(rolled)])
    return np.unique(rolled)


def _permuted(x: np.ndarray, constants: tuple) -> np.ndarray:
    """A permutation of the 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= constants[0]
    x ^= x >> np.uint32(13)
    x *= constants[1]
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: least value of each shift of the second permutation."""
    scattered = _permuted((shingles >> np.uint64(32)).astype(np.uint32), _SCATTER)
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    least = np.full(coordinates, np.uint32(0xFFFFFFFF))
    with np.errstate(over="ignore"):
        for at in range(0, len(scattered), _BLOCK):
            block = _permuted(scattered[None, at : at + _BLOCK] - shifts, _SECOND)
            np.minimum(least, block.min(axis=1), out=least)
    return least


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature(shingles, bands * rows).reshape(bands, rows).astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = np.arange(1, bands + 1, dtype=np.uint64) * _P
        for j in range(rows):
            keys = _mix(keys * _P + parts[:, j])
    return keys.view(np.int64)


def parity_sketch(shingles: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """Bit b is the parity of the shingles that fall on b.

    The sketches of two sets differ in at most as many bits as the sets differ in
    shingles.
    """
    counts = np.bincount((shingles & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("node", pa.string()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
_SETS = pa.schema([("node", pa.string()), ("shingles", pa.list_(pa.int64()))])


def signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, text_hash, n, node, keys, sketch)`` per row; an empty set has no node.

    ``node`` is a 128-bit digest of the whole set.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_hexdigest

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, nodes, keys, sketches = [], [], [], []
                for text in part.column(2):
                    shingles = shingle_set(text.as_py(), words)
                    n.append(len(shingles))
                    nodes.append(xxh3_128_hexdigest(shingles.tobytes()) if len(shingles) else None)
                    keys.append(band_keys(shingles, bands, rows) if len(shingles) else None)
                    sketches.append(parity_sketch(shingles) if len(shingles) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(v, t.type) for v, t in zip((n, nodes, keys, sketches), list(_SIGNED)[2:], strict=True))],
                    schema=_SIGNED,
                )

    return docs.mapInArrow(sign, "doc_id long, text_hash long, n long, node string, keys array<long>, sketch array<long>")


def shingle_sets(chosen: DataFrame, words: int) -> DataFrame:
    """``(node, shingles)`` of ``(node, text)``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingle_set(t.as_py(), words).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, _SETS[1].type)], schema=_SETS)

    return chosen.mapInArrow(sets, "node string, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``(a, b, shared, joint)`` of pairs ``(a, b)``: sizes of intersection and union.

    ``b`` is the side that may repeat often: its set is looked up first, while rows
    are small.
    """
    of_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    of_a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    met = pairs.join(of_b, "b").join(of_a, "a")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    counted = met.select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b")).alias("both"))
    return counted.select("a", "b", "shared", (F.col("both") - F.col("shared")).alias("joint"))


def _sizes_fit(m: str, n: str, percent: int):
    return (F.col(m) * 100 >= F.col(n) * percent) & (F.col(n) * 100 >= F.col(m) * percent)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, text_hash)`` for every row.

    Sets of ``words``-word shingles are linked if their intersection holds at least
    ``percent`` per cent of their union; ``component_id`` is the least id that links
    reach, the row's own included. ``kept`` marks the rows that carry that id.

    A null or empty text has an empty set and is linked with nothing: it is its own
    component. Rows that share an id are rows of their own; their sets may belong to
    different components, and then each takes the least id of its own. A null id
    names no component: one of null ids only has a null ``component_id``, and its
    rows are kept. Other columns are ignored. No rows give no rows.
    """
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    signatures = stored(signed(texts, words, bands, rows), "signatures")
    classes = stored(
        signatures.filter("node is not null")
        .groupBy("node")
        .agg(
            F.min(F.struct("doc_id", "text_hash")).alias("row"),
            F.min("doc_id").alias("least_id"),
            F.first("n").alias("n"),
            F.first("keys").alias("keys"),
            F.first("sketch").alias("sketch"),
        ),
        "classes",
    )
    edges = links(texts, classes, words, percent)
    labels = components(edges)
    least = (
        classes.select("node", "least_id")
        .join(labels, "node")
        .groupBy("component")
        .agg(F.min("least_id").alias("component_id"))
    )
    linked = labels.join(least, "component").select("node", "component_id")
    own = classes.select("node", "least_id").join(linked, "node", "left").select(
        "node", F.coalesce("component_id", "least_id").alias("component_id")
    )
    full = signatures.filter("node is not null").join(own, "node")
    empty = signatures.filter("node is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "text_hash", "n", "component_id"]
    return full.select(*columns).union(empty.select(*columns)).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "text_hash",
    )


def one_per_group(docs: DataFrame, words: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each component.

    Rows that repeat an id within a component leave one of them; of rows without an
    id each distinct text leaves one.
    """
    no_id = F.when(F.col("doc_id").isNull(), F.col("text_hash"))
    found = near_duplicates(docs.select("doc_id", "text"), words=words, percent=percent).filter("kept")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("row_key")
    stay = found.groupBy(key, "component_id", no_id.alias("no_id")).agg(F.min("text_hash").alias("text_hash"))
    rows = docs.select(F.struct("*").alias("row"), key, F.xxhash64("text").alias("text_hash"))
    return (
        rows.join(stay.select("row_key", "text_hash"), ["row_key", "text_hash"], "left_semi")
        .dropDuplicates(["row_key", "text_hash"])
        .select("row.*")
    )


def links(texts: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """``(a, b)``: links that join each component of classes."""
    memberships = classes.select("node", "n", F.explode("keys").alias("key"))
    buckets = (
        memberships.groupBy("key")
        .agg(F.count("*").alias("members"), F.min(F.struct("node", "n")).alias("leader"))
        .filter("members > 1")
    )
    starred = stored(
        memberships.join(buckets, "key").select(
            "key", "node", "n", "members", F.col("leader.node").alias("leader"), F.col("leader.n").alias("leader_n")
        ),
        "buckets",
    )
    needed = starred.select("node").distinct().join(classes.select("node", "row"), "node")
    chosen = needed.alias("c").join(
        texts.alias("t"),
        (F.col("c.row.text_hash") == F.col("t.text_hash")) & F.col("c.row.doc_id").eqNullSafe(F.col("t.doc_id")),
    )
    sets = stored(
        shingle_sets(chosen.select("c.node", "t.text"), words).dropDuplicates(["node"]), "shingle-sets"
    )

    def is_link(checked: DataFrame) -> DataFrame:
        return checked.filter(F.col("shared") * 100 >= F.col("joint") * percent).select("a", "b")

    pairs = starred.filter((F.col("node") != F.col("leader")) & _sizes_fit("n", "leader_n", percent))
    found = verified(pairs.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), sets)
    edges = stored(is_link(found), "links")

    # A leader has met its whole bucket. What is left are the others, unless they
    # are one component already.
    left = unsettled(starred.filter("members > 2 and node <> leader").select("key", "node", "n"), components(edges))
    left = stored(left, "unsettled")
    # A pair is looked at in the first bucket that both are in; nobody is in more
    # buckets than there are bands.
    keys = left.groupBy("node").agg(F.collect_set("key").alias("keys"))
    sketched = stored(left.join(keys, "node").join(classes.select("node", "sketch"), "node"), "sketched")
    others = ("node", "n", "component", "largest", "sketch", "keys")
    other = sketched.select("key", *(F.col(c).alias(f"other_{c}") for c in others))
    # As functions of the arrays: a sum over 64 elements written out is a method too
    # long for the JVM to compile, and takes ten times as long.
    bits = F.zip_with("sketch", "other_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(bits, F.lit(0), lambda x, y: x + y)
    # Sets that share at least p of their union differ in at most
    # (1 - p) / (1 + p) of their joint size.
    close = differ * (100 + percent) <= (F.col("n") + F.col("other_n")) * (100 - percent)
    pairs = (
        sketched.filter("not largest")
        .join(other, "key")
        .filter(
            (F.col("component") != F.col("other_component"))
            & (F.col("other_largest") | (F.col("node") > F.col("other_node")))
            & _sizes_fit("n", "other_n", percent)
            & close
            & (F.col("key") == F.array_min(F.array_intersect("keys", "other_keys")))
        )
        .select(F.col("node").alias("a"), F.col("other_node").alias("b"))
    )
    return edges.union(stored(is_link(verified(pairs, sets)), "links"))


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, with their component.

    ``largest`` marks the component with the most members of the bucket. Of buckets
    with the same members one is kept.
    """
    labelled = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = labelled.groupBy("key", "component").agg(
        F.count("*").alias("size"),
        F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("one"),
        F.bit_xor(F.xxhash64("component", "node")).alias("two"),
    )
    mixed = (
        parts.groupBy("key")
        .agg(
            F.count("*").alias("components"),
            F.max(F.struct("size", "component")).alias("most"),
            F.sum("size").alias("members"),
            F.sum("one").alias("one"),
            F.bit_xor("two").alias("two"),
        )
        .filter("components > 1")
        .groupBy("members", "one", "two")
        .agg(F.min(F.struct("key", "most")).alias("kept"))
        .select("kept.key", F.col("kept.most.component").alias("most"))
    )
    return labelled.join(mixed, "key").select(
        "key", "node", "n", "component", (F.col("component") == F.col("most")).alias("largest")
    )
