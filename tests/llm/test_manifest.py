"""Merkle manifest against a tree built level by level."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from compare import connect, difference
from tabchain.llm import oracles
from tabchain.llm.manifest import Block, height, manifest, node, proof
from tabchain.llm.queries import QUERIES
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS))


def tree(digests):
    """Root, and for each leaf its siblings (left, right) level by level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for path, k in zip(paths, at):
            first = k - k % 3
            path.append(("".join(level[first:k]), "".join(level[k + 1 : first + 3])))
        at = [k // 3 for k in at]
        level = [H(*level[k : k + 3]) for k in range(0, len(level), 3)]
    return level[0], paths


def expected(rows):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for source in sources:
        own = sorted(
            (r for r in rows if r["source"] == source), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))
        )
        parts.append((own, *tree([leaf(r) for r in own])))
    root, above = tree([subroot for _, subroot, _ in parts])
    out = []
    for (own, subroot, paths), top in zip(parts, above):
        for r, path in zip(own, paths):
            path = path + top
            even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            text = r["text"].replace("\n", "") if even and r["text"] is not None else r["text"]
            digest = leaf(r | {"text": text})
            for left, right in path:
                digest = H(left, digest, right)
            out.append((r["doc_id"], leaf(r), subroot, root, H(*(a + b for a, b in path)), digest, digest == root))
    return out


def rows():
    draw = random.Random(3)
    texts = [None, "", "a\nb", "\n", "é\n€", "x" * 100_000, "same"]
    made = [
        {"doc_id": k, "source": draw.choice(["web"] * 5 + ["é", "a", None, "", "z"]), "lang": draw.choice(["en", None]),
         "n_chars": draw.choice([None, 3]), "text": draw.choice(texts)}
        for k in range(130)
    ]
    made += [dict(made[k]) for k in (1, 1, 5)] + [made[2] | {"text": "other"}, made[3] | {"doc_id": None}, made[3] | {"doc_id": None}]
    return made + [{"doc_id": 9000, "source": "lone", "lang": None, "n_chars": None, "text": "one leaf"}]


def frame(spark, made):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree string, path int, root string, row int"
    return spark.createDataFrame([(*r.values(), "t", 1, "r", 2) for r in made], schema).repartition(5)


def query(docs, monkeypatch, block_levels=None):
    from tabchain.llm import queries

    monkeypatch.setattr(queries, "documents", lambda spark, folder: docs)
    if block_levels is not None:
        monkeypatch.setattr(queries, "manifest", lambda *a: manifest(*a, block_levels=block_levels))
    return sorted(map(tuple, QUERIES["op12_merkle_manifest"][0](docs.sparkSession, "").collect()), key=str)


@pytest.mark.parametrize("block_levels", [1, 2, 8])
def test_odd_rows_equal_trees_built_level_by_level(spark, monkeypatch, block_levels):
    made = rows()
    assert query(frame(spark, made), monkeypatch, block_levels) == sorted(expected(made), key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_few_rows(spark, monkeypatch, n):
    made = rows()[:n]
    assert query(frame(spark, made), monkeypatch) == sorted(expected(made) if made else [], key=str)


@pytest.mark.parametrize("n", range(1, 30))
def test_a_block_appends_leaf_by_leaf(n):
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(n)]
    block = Block(height(n))
    for k, digest in enumerate(digests):
        block.append(k, digest)
        assert all(len(level) < 3 for level in block.open[: height(n)])
    root, paths = tree([d.hex() for d in digests])
    assert block.root().hex() == root
    table = block.table("t", 0).to_pylist()
    assert [[(s["left"].hex(), s["right"].hex()) for s in row["path"]] for row in table] == paths
    assert node([digests[0]]) != digests[0]


def test_witness_without_levels_is_empty(spark):
    row = manifest(frame(spark, rows()[:1]), COLUMNS).select("path", proof(F.col("path")).alias("proof")).first()
    assert row.path == [] and row.proof == ""


def test_query_equals_sql_without_cross_join(spark, data):
    df = QUERIES["op12_merkle_manifest"][0](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert difference(df, connect(data), oracles.MANIFEST) is None
