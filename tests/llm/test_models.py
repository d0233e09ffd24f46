"""Language identification, quality votes and URL verdicts: exact parts and held-out accuracy."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabchain.llm import langid, quality, url_filter
from tabchain.llm.queries import QUERIES

ODD = [(1, None), (2, ""), (3, "12 !? --"), (4, "The of and"), (4, "The of and"), (None, "der die und"), (6, "x" * 300_000), (7, "é")]


def odd(spark, extra="lang string, quality int"):
    return spark.createDataFrame([(i, t, None, 3) for i, t in ODD], f"doc_id long, text string, {extra}").repartition(2)


def test_gradients_are_those_of_the_loss():
    net = langid.Network.fresh(["a", "b", "c"])
    symbols, mask = langid.segment_matrix([b"some text of bytes", b"abc", "Öß ñé".encode()])
    symbols, target = symbols.astype(np.int64), np.array([0, 1, 2])
    _, gradients = langid.loss_and_gradients(net, symbols, mask, target)
    for w, g in zip(net.weights(), gradients, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        before, step = w[at], 1e-2
        w[at] = before + step
        above, _ = langid.loss_and_gradients(net, symbols, mask, target)
        w[at] = before - step
        below, _ = langid.loss_and_gradients(net, symbols, mask, target)
        w[at] = before
        assert abs((above - below) / (2 * step) - g[at]) < 2e-3


def test_document_probabilities_pool_every_position():
    net = langid.Network.fresh(["a", "b"])
    texts = [b"x" * 200, b"", b"abc", bytes(range(1, 129))]
    found = langid.document_probabilities(net, texts)
    for k, text in enumerate(texts):
        total = np.zeros(2)
        for at in range(0, len(text), langid.SEGMENT):
            symbols, mask = langid.segment_matrix([text[at : at + langid.SEGMENT]])
            p = langid.position_probabilities(net, *(langid.run_direction(net, d, symbols, mask) for d in range(2)))
            total += (p * mask[:, None, :]).sum(axis=(0, 2))
        assert np.allclose(found[k], total / max(1, len(text)), atol=1e-5)


def test_languages_of_odd_rows(spark):
    net = langid.Network.fresh(["de", "en"])
    found = sorted(((r.doc_id, r.lang_pred, r.score) for r in langid.predict_languages(odd(spark), net).collect()), key=str)
    by_id = {i: p for i, p, _ in found}
    assert len(found) == len(ODD)
    assert {by_id[k] for k in (1, 2, 3)} == {"und"}
    assert by_id[4] in ("de", "en") and by_id[None] in ("de", "en")
    assert all(0 <= s <= 1 for _, _, s in found)
    assert {r.lang_pred for r in langid.identify(odd(spark), F.lit(False)).collect()} == {"und"}
    assert langid.identify(odd(spark).limit(0), F.lit(False)).count() == 0


def test_language_query_on_held_out_documents(spark, data):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").collect()}
    found = QUERIES["op9_language_id"][0](spark, data).collect()
    assert len(found) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_terms_of_whole_texts():
    long = b"ab1 " * 2_000_000
    counts = quality.term_counts([b"", b"a", b"ab ab cd", long])
    assert counts[0].sum() == counts[1].sum() == 0
    assert counts[2].sum() == 7 + quality.REPEAT_WEIGHT
    assert counts[3, :-1].sum() == len(long) - 1


def test_votes_are_those_of_brute_force():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 9, (60, quality.TERMS)).astype(np.float32)
    labels = rng.integers(0, 2, 60)
    model = quality.fit(counts, labels, 10)
    probe = rng.integers(0, 9, (7, quality.TERMS)).astype(np.float32)
    latent = model.latent(probe)
    for vector, score in zip(latent, model.scores(probe), strict=True):
        cosine = sorted(((float(vector @ v), int(y)) for v, y in zip(model.vectors, labels, strict=True)), reverse=True)
        votes = [(max(c, 0) ** quality.SHARPNESS, y) for c, y in cosine[: quality.NEIGHBOURS]]
        assert score == pytest.approx(sum(v * y for v, y in votes) / sum(v for v, _ in votes), abs=1e-3)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, "x"), (6, 0, "x"), (7, None, "x"), (None, 1, "x"), (1, 0, "x"), (1, 1, "x")], "doc_id long, quality int, text string")
    found = quality.classify(odd(spark), labels, F.lit(False)).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    none = quality.classify(odd(spark), labels.limit(0), F.lit(False)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(odd(spark).limit(0), labels, F.lit(False)).count() == 0


def test_quality_query_on_held_out_documents(spark, data):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    found = {r.doc_id: r for r in QUERIES["op7_quality_neighbours"][0](spark, data).collect()}
    assert len(found) == spark.read.parquet(f"{data}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found.values())
    held = [k for k in truth if found[k].held_out]
    assert sum(found[k].predicted == truth[k] for k in held) >= 0.85 * len(held)


URLS = [
    (1, "https://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"),
    (2, "http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    (3, "http://x.example.org/en/22", "x.example.org", "/en/22", "org/", "allow"),
    (4, "ftp://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    (5, "http://shop.com/fr/a", "shop.com", "/fr/a", "com/fr/", "allow"),
    (6, "http://com/de/a", "com", "/de/a", "com/de/", "block"),
    (7, "http://example.org", "example.org", "", None, None),
    (8, "http://example.org?x=/es/", "example.org", "", None, None),
    (9, None, "", "", None, None),
    (10, "no scheme.org/es/", "", "", None, None),
    (11, "http://ÄÖ.com/é/://de", "ÄÖ.com", "/é/://de", None, None),
    (11, "a://b://c/d", "b:", "//c/d", None, None),
    (None, "http://x.net/" + "1" * 50_000, "x.net", "/" + "1" * 50_000, None, None),
    (12, "", "", "", None, None),
]


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", 1.0) for i, u, *_ in URLS], "page_id long, url string, host string, score double")
    found = sorted((tuple(r)[:5] for r in url_filter.filter_urls(pages).collect()), key=str)
    want = sorted(((i, h, p, r, v) for i, _, h, p, r, v in URLS), key=str)
    assert [f[:4] for f in found] == [w[:4] for w in want]
    assert all(f[4] == w[4] if w[4] else f[4] in ("allow", "block") for f, w in zip(found, want, strict=True))


def test_urls_without_both_labels(spark):
    one = spark.createDataFrame([(1, "http://x.com/de/"), (2, "http://x.net/")], "page_id long, url string")
    assert {(r.page_id, r.verdict) for r in url_filter.filter_urls(one).collect()} == {(1, "block"), (2, "block")}
    none = one.filter("page_id = 2")
    assert [(r.verdict, r.block_score) for r in url_filter.filter_urls(none).collect()] == [("allow", 0.0)]
    assert url_filter.filter_urls(one.limit(0)).count() == 0


def test_url_query(spark, data):
    found = QUERIES["op10_url_filter"][0](spark, data)
    rows = found.collect()
    assert len(rows) == spark.read.parquet(f"{data}/pages.parquet").count()
    assert all((r.block_score is None) == (r.rule is not None) for r in rows)
    assert {r.verdict for r in rows} == {"allow", "block"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rare_domains_have_their_statistics(spark):
    """More than 2,000 labelled domains, one host suffix holding them all."""
    pages = spark.range(5000).selectExpr(
        "id AS page_id", "concat('http://d', id % 2500, '.com/', if(id % 2500 % 2 = 0, 'fr', 'de'), '/', id) AS url"
    )
    judged = url_filter.with_parts(pages).withColumn("hit", url_filter.rule_column())
    labelled = judged.withColumn("blocked", (F.col("hit.verdict") == "block").cast("int"))
    statistics = url_filter.suffix_statistics(labelled)
    assert statistics.count() == 2501
    found = url_filter.with_features(judged, statistics).collect()
    assert len(found) == 5000
    for r in found:
        blocked = r.page_id % 2500 % 2
        assert r.share_2 == pytest.approx((2 * blocked + 4) / 10) and r.count_2 == pytest.approx(np.log1p(2))
        assert r.share_1 == 0.5 and r.count_1 == pytest.approx(np.log1p(5000))
