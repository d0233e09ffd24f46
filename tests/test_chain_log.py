"""The chain log with many writers."""

from __future__ import annotations

from datetime import datetime

import pytest

from tabchain.sources import chain_log as log

ROWS = {
    ("a", 1): [(0, datetime(2024, 1, 1, 10), "q0", "c0", "x"), (1, datetime(2024, 1, 1, 12), "q1", "c1", None)],
    ("b", 1): [(0, datetime(2024, 1, 1, 11), "q2", "c2", "y"), (1, datetime(2024, 1, 1, 12), "q3", "c3", "y")],
    ("a", 2): [(0, datetime(2024, 1, 2), "q4", "c4", "z")],
    ("b", 7): [(0, datetime(2024, 1, 2), "q5", "c5", "z"), (1, datetime(2024, 1, 2), "q6", "c6", "z")],
}


def write(spark, path, *keys):
    for writer, batch in keys:
        chains = spark.createDataFrame(ROWS[writer, batch], "place int, logged_at timestamp, query string, chain string, answer string")
        log.write_batch(chains, path, writer, batch)


def queries(df):
    return [r.query for r in df.orderBy(*log.ORDER).collect()]


def test_interleaved_writers_and_a_repeated_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    assert queries(log.read_log(spark, path)) == [] and log.compact(spark, path) is None
    write(spark, path, ("a", 1), ("b", 1), ("a", 2), ("a", 1), ("b", 7), ("a", 1))
    assert queries(log.read_log(spark, path)) == ["q0", "q2", "q1", "q3", "q4", "q5", "q6"]
    assert [r.query for r in log.last_logged(log.read_log(spark, path), 3).collect()] == ["q4", "q5", "q6"]


def test_compaction_keeps_each_chain_once(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, ("a", 1), ("b", 1))
    first = log.compact(spark, path)
    assert first and log.compact(spark, path) is None
    write(spark, path, ("a", 1), ("a", 2))  # a batch that a segment holds is sent again
    assert queries(log.read_log(spark, path)) == ["q0", "q2", "q1", "q3", "q4"]
    assert log.drop_compacted(spark, path) == 2 and log.drop_compacted(spark, path) == 0
    second = log.compact(spark, path)
    assert second and log.drop_compacted(spark, path) == 1
    write(spark, path, ("b", 7))
    found = log.read_log(spark, path)
    assert queries(found) == ["q0", "q2", "q1", "q3", "q4", "q5", "q6"] and found.columns == log.ENTRY_SCHEMA.names


def test_two_compactions_at_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    write(spark, path, ("a", 1), ("b", 1))
    log.compact(spark, path)
    empty = log._segments(spark, str(tmp_path / "none"))
    monkeypatch.setattr(log, "_segments", lambda *_: empty)  # a second one that began before the first had ended
    assert log.compact(spark, path)
    monkeypatch.undo()
    assert log._segments(spark, path).count() == 8 and queries(log.read_log(spark, path)) == ["q0", "q2", "q1", "q3"]


def test_a_batch_that_broke_off_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, ("a", 1))
    broken = tmp_path / "log" / log.BATCHES / "writer=c" / "batch=1" / "_temporary" / "0"
    broken.mkdir(parents=True)
    (broken / "part-00000.parquet").write_bytes(b"half")
    assert queries(log.read_log(spark, path)) == ["q0", "q1"]
    with pytest.raises(ValueError, match="writer's name"):
        log.write_batch(log.read_log(spark, path), path, "a/b", 1)
