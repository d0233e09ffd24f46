"""Hard negatives against brute force in Python's integers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import connect, difference
from tabchain.llm import oracles
from tabchain.llm.negatives import PackedCandidates, band, best, hard_negatives
from tabchain.llm.queries import QUERIES

SMALL, LARGE = st.integers(-300, 300), st.integers(-(2**70), 2**70)


@settings(max_examples=150, deadline=None)
@given(st.data(), st.sampled_from([SMALL, st.integers(-(2**20), 2**20), LARGE]), st.integers(0, 7))
def test_packed_products_are_exact(data, number, depth):
    rows = st.lists(st.lists(number, min_size=depth, max_size=depth), min_size=1, max_size=9)
    kind = object if number is LARGE else np.int64
    left, right = (np.array(x, kind).reshape(len(x), depth) for x in (data.draw(rows), data.draw(rows)))
    packed = PackedCandidates(right, left)
    want = [[max(-(2**63) + 1, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, c)))) for c in right] for a in left]
    assert packed.scores(left).tolist() == want


def test_several_candidates_share_a_word():
    unit = np.array([[150, -140, 30]] * 10)
    packed = PackedCandidates(unit, unit)
    assert packed.fields >= 2 and packed.words.shape == (3, -(-10 // packed.fields))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=30), st.integers(1, 6))
def test_best_breaks_ties_by_place(scores, n):
    among = np.arange(len(scores))[::2]
    want = sorted(among.tolist(), key=lambda k: (-scores[k], k))[:n]
    assert best(np.array(scores, np.int64), among, n).tolist() == want


@given(st.integers(-500, 500), st.integers(-500, 500))
def test_band(positive, negative):
    least, largest = band(positive)
    assert (least <= negative <= largest) == (30 * positive <= 100 * negative <= 90 * positive)


def brute(rows, every):
    usable = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        moved = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        usable.append((vec_id, [math.floor(256 * x) for x in vector], moved))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, (anchor, own, label) in enumerate(usable):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(a * b for a, b in zip(own, v)), vec_id, lab) for j, (vec_id, v, lab) in enumerate(usable) if j != i]
        for p, positive, _ in sorted((x for x in scored if x[2] == label), key=order)[:5]:
            inside = sorted((x for x in scored if x[2] != label and 30 * p <= 100 * x[0] <= 90 * p), key=order)[:10]
            out += [(anchor, positive, rank, n, p, s) for rank, (s, n, _) in enumerate(inside, 1)]
    return sorted(out, key=str)


def frame(spark, rows):
    schema = "vec_id long, embedding array<float>, label int, row int, score string, rank int, part int, components int"
    return spark.createDataFrame([(*r, 1, "s", 2, 3, 4) for r in rows], schema).repartition(3)


def odd(spark):
    draw = random.Random(5)
    vector = lambda n: [draw.choice([0.5, 0.25, -0.125, 0.0, 0.75]) for _ in range(n)]
    rows = [(k, vector(4), draw.randrange(4)) for k in range(60)]
    rows += [(None, vector(4), 1), (None, vector(4), 2), (10, rows[10][1], rows[10][2]), (10, vector(4), 1), (4, rows[4][1], rows[4][2])]
    rows += [(100, None, 1), (101, vector(4), None), (110, [0.5, None, 0.1, 0.2], 1), (120, [float("nan"), 1.0], 1)]
    rows += [(130, [float("inf"), 1.0, 0.0, 0.0], 2), (140, [], 3), (150, vector(2), 1), (160, vector(7), 2), (-7, vector(4), -3)]
    return rows


@pytest.mark.parametrize(("anchors", "candidates"), [(1, 1), (8, 60), (10**6, 10**6)])
def test_odd_rows_in_any_grid(spark, anchors, candidates):
    rows = odd(spark)
    found = hard_negatives(frame(spark, rows), 10, anchor_components=anchors * 4, candidate_components=candidates * 4)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == brute(rows, 10) and len(got) > 50


def test_large_components_stay_exact(spark):
    rows = [(k, [1e6 * (k % 5 + 1), 3e6, 0.1 * k], k % 2) for k in range(40)]
    rows = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    assert sorted(map(tuple, hard_negatives(frame(spark, rows), 10).collect()), key=str) == brute(rows, 10)
    huge = [(k, [3e38, 1e-3 * k], k % 2) for k in range(8)]
    assert hard_negatives(frame(spark, huge), 2).count() == 0  # all scores are held at the end of the range


def test_many_copies_of_one_row(spark):
    rows = [(10, [0.5, 0.5], 1)] * 30 + [(3, [0.25, 0.25], 2)] * 25
    found = hard_negatives(frame(spark, rows), 10, anchor_components=8, candidate_components=20)
    assert sorted(map(tuple, found.collect()), key=str) == brute(rows, 10)


def test_no_rows(spark):
    assert hard_negatives(frame(spark, odd(spark)).limit(0)).count() == 0
    assert hard_negatives(frame(spark, [(1, [0.5], 1), (2, [0.5], 1)])).count() == 0


def test_query_equals_sql(spark, data):
    df = QUERIES["op11_hard_negatives"][0](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert difference(df, connect(data), oracles.HARD_NEGATIVES) is None
