"""Decontamination, line dedup and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest

import corpus_pipeline
from tabchain.llm.decontaminate import Matcher, bit_masks, distances, find_leaks, normalised, without_leaks
from tabchain.llm.line_dedup import LONG_LINE, line_dedup
from tabchain.llm.queries import QUERIES


def table(pattern, text, anchored=False):
    """Last row of the edit distance table."""
    row = list(range(len(pattern) + 1))
    out = []
    for j, c in enumerate(text, 1):
        new = [j if anchored else 0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
        row = new
        out.append(row[-1])
    return out


@pytest.mark.parametrize("anchored", [False, True])
def test_bit_parallel_distances_are_those_of_the_table(anchored):
    rng = random.Random(1)
    for _ in range(200):
        pattern = "".join(rng.choices("abcé", k=rng.randrange(1, 90)))
        text = "".join(rng.choices("abcé", k=rng.randrange(0, 120)))
        assert list(distances(bit_masks(pattern), len(pattern), text, anchored)) == table(pattern, text, anchored)


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        k = rng.randrange(len(text))
        text[k : k + 1] = rng.choice([[], ["q"], [text[k], "z"]])
    return "".join(text)


def sample_leaks():
    rng = random.Random(2)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}" for _ in range(60)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, prose(rng.randrange(12, 50))) for k in range(12)] + [(20, None), (21, ""), (22, "  \n"), (23, "Ünï"), (None, prose(20)), (3, prose(9))]
    docs = [(k, prose(rng.randrange(0, 60))) for k in range(30)]
    for k in range(40):
        item = rng.choice([t for _, t in items if t and len(t) > 20])
        docs.append((100 + k, prose(10) + "\n" + edited(rng, item, rng.randrange(0, 14)).upper() + "  " + prose(5)))
    docs += [(207, None), (208, ""), (None, items[0][1]), (209, "x ünï y " * 3), (209, "x ünï y " * 3), (210, "bal " * 20_000)]
    return docs, items


@pytest.mark.parametrize("block_chars", [4_000_000, 600])
def test_leaks_are_those_of_brute_force(spark, block_chars):
    docs, items = sample_leaks()
    want = []
    for doc_id, text in docs:
        body = normalised(text)
        if len(body) > 10_000:
            continue
        for item_id, item in items:
            goal = normalised(item)
            best = min(table(goal, body), default=None) if goal else None
            if best is not None and best <= int(len(goal) * 0.08):
                want.append((doc_id, item_id, best))
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, distance double")
    frame = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, item_id long").repartition(3)
    found = find_leaks(frame, bench, block_chars=block_chars).collect()
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in found), key=str) == sorted(want, key=str)
    goals = {(i, normalised(t)) for i, t in items}
    for r in found:
        body = next(normalised(t) for i, t in docs if i == r.doc_id)
        assert any(table(g, body[r.start : r.end], True)[-1] == r.distance for i, g in goals if i == r.item_id and g)
    clean = without_leaks(frame, bench, block_chars=block_chars).collect()
    dirty = {d for d, *_ in want}
    assert sorted((r.doc_id for r in clean), key=str) == sorted((d for d, _ in docs if d not in dirty), key=str)
    assert find_leaks(frame.limit(0), bench).count() == find_leaks(frame, bench.limit(0)).count() == 0


def test_leak_query_finds_what_exact_search_finds(spark, data):
    docs = {r.doc_id: normalised(r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = {r.item_id: normalised(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op2_decontamination"][0](spark, data).collect()}
    exact = {(d, i) for d, t in docs.items() for i, s in items.items() if s in t}
    assert exact and exact == {k for k, v in found.items() if v == 0}
    matcher = Matcher(list(items.items()))
    assert all(table(items[i], docs[d])[-1] is not None for d, i in list(found)[:2])
    assert sum(len(matcher.leaks(t)) for t in docs.values()) == len(found)


def is_long(line):
    return line.count(" ") >= LONG_LINE


def brute_chunks(text, hashed):
    lines = text.split("\n")
    h = [hashed[x] for x in lines]
    turn = lambda v: ((v << 1) | (v >> 63)) & (2**64 - 1)
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    r = [2**63 - 1] + [signed(turn(a % 2**64) ^ (b % 2**64)) for a, b in zip(h, h[1:], strict=False)]
    cuts = [
        i for i in range(len(lines))
        if i == 0 or is_long(lines[i]) or is_long(lines[i - 1]) or (r[i] < r[i - 1] and r[i] <= (r[i + 1] if i + 1 < len(r) else 2**63 - 1))
    ]
    return lines, list(zip(cuts, cuts[1:] + [len(lines)], strict=True))


def brute_lines(rows, hashed):
    first, cut = {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t:
            lines, spans = cut[d, t] = brute_chunks(t, hashed)
            for a, b in spans:
                part = lines[a:b]
                if len(part) > 1 or is_long(part[0]):
                    first.setdefault("\n".join(part), (d, t, a))
    out = []
    for d, t in rows:
        if not t:
            out.append((d, t))
            continue
        lines, spans = cut[d, t]
        kept = [(a, b) for a, b in spans if first.get("\n".join(lines[a:b]), (d, t, a)) == (d, t, a)]
        out.append((d, "\n".join("\n".join(lines[a:b]) for a, b in kept)))
    return out


def line_rows():
    rng = random.Random(3)
    line = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    shared = [line(7) for _ in range(14)]
    wide = line(60)
    rows = []
    for k in range(40):
        own = [line(rng.randrange(1, 9)) for _ in range(rng.randrange(1, 9))]
        if k % 3 == 0:
            own[1:1] = shared
        if k % 4 == 0:
            own.append(wide)
        rows.append((k, "\n".join(own)))
    return rows + [(50, None), (51, ""), (52, "\n\n\n\n"), (53, "a\n" * 30), (54, "one"), (55, "one"), (None, "\n".join(shared)), (60, rows[3][1]), (60, rows[3][1]), (61, "x\n" * 20_000)]


def test_line_dedup_is_that_of_brute_force(spark):
    rows = line_rows()
    lines = sorted({x for _, t in rows if t for x in t.split("\n")})
    hashed = {r.v: r.h for r in spark.createDataFrame([(x,) for x in lines], "v string").selectExpr("v", "xxhash64(v) as h").collect()}
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, total_lines int, code int").repartition(3)
    found = line_dedup(frame)
    assert found.columns == ["doc_id", "text", "code", "removed_chunks", "total_lines"]
    got = found.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(brute_lines(rows, hashed), key=str)
    for r in got:
        if r.text:
            assert r.total_lines >= len(r.text.split("\n")) + sum(c.lines for c in r.removed_chunks) - 1
    assert line_dedup(frame.limit(0)).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shared_passage_is_removed_wherever_it_stands(spark):
    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    passage = [line(60), line(55), *[line(8) for _ in range(12)]]
    rows = [(k, "\n".join([*[line(8) for _ in range(k)], *passage, line(8)])) for k in range(5)]
    found = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == rows[0][1]
    for k in range(1, 5):
        assert passage[0] not in found[k] and passage[1] not in found[k]
        assert sum(x in found[k] for x in passage[2:]) <= 8


@pytest.mark.parametrize("size", [2, 3, 4, 5])
def test_passage_of_few_short_lines_is_removed(spark, size):
    rng = random.Random(size)
    line = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    passage = [line(-(-52 // size)) for _ in range(size)]
    less = [line(40)]
    rows = [(k, "\n".join([*[line(8) for _ in range(1 + k % 4)], *passage, line(8), *less, line(49)])) for k in range(12)]
    rows += [(20, "\n".join(passage)), (None, "\n".join([line(3), *passage]))]
    found = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), short_runs=True).collect()}
    assert found[0].text == rows[0][1] and found[0].removed_chunks == []
    for k, text in rows[1:]:
        kept = set(found[k].text.split("\n"))
        removed = {i for c in found[k].removed_chunks for i in range(c.first, c.first + c.lines)}
        lines = text.split("\n")
        assert found[k].text == "\n".join(x for i, x in enumerate(lines) if i not in removed)
        assert sum(c.lines for c in found[k].removed_chunks) == len(removed)
        assert set(lines) - kept == set(passage)


def test_line_query_over_documents(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    lines = sorted({x for _, t in rows if t for x in t.split("\n")})
    hashed = {r.v: r.h for r in spark.createDataFrame([(x,) for x in lines], "v string").selectExpr("v", "xxhash64(v) as h").collect()}
    want = {d: hashlib.sha256(t.encode()).hexdigest() for d, t in brute_lines(rows, hashed)}
    assert {r.doc_id: r.text_sha256 for r in QUERIES["op3_line_dedup"][0](spark, data).collect()} == want


def test_pipeline_stages(spark, data):
    from tests.llm.test_minhash import brute

    docs = spark.read.parquet(f"{data}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "line_dedup", "near_dedup", "decontamination", "packing"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = corpus_pipeline.stored(stage(spark, docs, data), "test-stage")
        if name == "packing":
            break
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "language":
            assert len(after) >= 0.97 * len(before)
        if name == "line_dedup":
            assert [d for d, _ in sorted(after)] == [d for d, _ in sorted(before)]
        if name == "near_dedup":
            assert sorted(d for d, _ in after) == sorted(r[0] for r in brute(before, 5) if r[3])
        if name == "decontamination":
            matcher = Matcher(bench)
            assert sorted(after) == sorted((d, t) for d, t in before if not matcher.leaks(t))
    packed = docs.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in after}
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in packed)
