"""Near duplicates against brute force over all pairs."""

from __future__ import annotations

import random

import pytest

from tabchain.llm.graph import components
from tabchain.llm.minhash import near_duplicates
from tabchain.llm.queries import QUERIES


def sets_of(rows, words):
    out = []
    for _, text in rows:
        t = (text or "").encode().lower().split()
        k = min(words, len(t))
        out.append({tuple(t[i : i + k]) for i in range(len(t) - k + 1)} if t else set())
    return out


def brute(rows, words, percent=80):
    """Sorted ``(doc_id, n, component_id, kept)``."""
    sets = sets_of(rows, words)
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                shared = len(a & b)
                if 100 * shared >= percent * (len(a) + len(b) - shared):
                    parent[root(i)] = root(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        r = root(k)
        ids = [x for x in (least.get(r), doc_id) if x is not None]
        least[r] = min(ids) if ids else None
    return sorted(
        ((doc_id, len(sets[k]), least[root(k)], doc_id == least[root(k)]) for k, (doc_id, _) in enumerate(rows)),
        key=str,
    )


def run(spark, rows, words, **more):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int")
    return sorted((tuple(r)[:4] for r in near_duplicates(df.repartition(3), words=words, **more).collect()), key=str)


def family(rng, start, size, edits, length=60):
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    out = []
    for k in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(length)] = f"e{rng.randrange(5000)}"
        out.append((start + k, " ".join(copy)))
    return out


ODD = [
    (1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one\ttwo"), (8, "two one"),
    (None, "one two three"), (None, "ONE two three"), (9, "a b c d e f g"), (9, "a b c d e f g"), (9, "other text of the same id"),
    (10, "a b c d e f g h"), (11, "word " * 20000), (12, "word word word"), (13, "é É"), (14, "é é"),
]


@pytest.mark.parametrize("words", [2, 5])
def test_odd_rows(spark, words):
    assert run(spark, ODD, words) == brute(ODD, words)


def test_families(spark):
    rng = random.Random(5)
    rows = family(rng, 0, 60, 8) + family(rng, 100, 30, 3) + family(rng, 200, 25, 12) + [(300, "x " + family(rng, 0, 1, 0)[0][1])]
    assert run(spark, rows, 2) == brute(rows, 2)


def test_chain_of_links(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(9000)}" for _ in range(160)]
    rows = [(50 - k, " ".join(words[3 * k : 3 * k + 60])) for k in range(30)]
    expected = brute(rows, 2)
    assert len({r[2] for r in expected}) < 5
    assert run(spark, rows, 2) == expected


def test_no_rows(spark):
    assert run(spark, [], 2) == []


def test_components(spark):
    edges = [("b", "a"), ("b", "c"), ("d", "c"), ("x", "y"), ("z", "z")]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}


def test_query_over_documents(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    assert sorted((tuple(r)[:4] for r in QUERIES["op5_minhash_dedup"][0](spark, data).collect()), key=str) == brute(rows, 2)
