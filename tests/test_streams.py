"""Streams that run in several batches: late rows, expiry, compaction, dimensions that change."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wicketflow.sources import shared
from wicketflow.streaming import live

DAY = dt.datetime(2024, 5, 1)


def at(hours):
    return None if hours is None else DAY + dt.timedelta(hours=hours)


def add(spark, path, rows, schema):
    """Another file of the stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_late_rows_are_kept_apart_and_replayed_alike(spark, tmp_path):
    src, out, mark, schema = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark", "k int, ts timestamp"
    stream = None
    batches = [[(1, at(0)), (2, at(10))], [(3, at(7)), (4, at(8)), (5, None), (6, at(30))], [(7, None)], [(8, at(27)), (9, at(28)), (10, at(40))]]
    for rows in batches:
        add(spark, src, rows, schema)
        stream = live.source(spark, src, spark.createDataFrame([], schema).schema, 1)
        run(live.split_late(stream, "ts", "2 hours", out, mark))
    want = {(1, 0, False), (2, 0, False), (3, 1, True), (4, 1, False), (5, 1, True), (6, 1, False), (7, 2, True), (8, 3, True), (9, 3, False), (10, 3, False)}
    read = lambda: {(x.k, x.epoch, x.late) for x in live.parted(spark, out, stream.schema).collect()}
    assert read() == want
    # the last batch runs again, as after a failure before its commit
    shared.remove(spark, f"{mark}/commits/3")
    run(live.split_late(stream, "ts", "2 hours", out, mark))
    assert read() == want
    kept = f"{tmp_path}/kept"
    run(live.ingest(live.deduplicated(live.on_time(spark, out, stream.schema), "ts", ["k"], "2 hours"), kept, f"{tmp_path}/mark2"))
    assert sorted(x.k for x in spark.read.parquet(kept).collect()) == [1, 2, 4, 6, 9, 10]
    assert len(shared.numbered(spark, f"{out}/marks", "epoch")) <= 4


def test_idle_keys_are_let_go_and_begin_anew(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "k string, ts timestamp, v int, seen timestamp"
    batches = [[("a", at(0), 1, at(1)), ("a", at(0), None, at(2)), ("b", at(1), 2, None), ("n", None, 3, None)], [("b", at(20), 5, None), ("c", at(21), 1, None)], [("a", at(22), 7, None), ("b", at(23), 1, None)], [("b", at(23.5), 4, at(9))]]
    for rows in batches:
        add(spark, src, rows, schema)
        stream = live.source(spark, src, spark.createDataFrame([], schema).schema, 1)
        for name, sums in (("last", None), ("sum", {"n": "1", "total": "v"})):
            run(live.changes(live.live_rows(stream, ["k"], "ts", "10 hours", sums=sums), f"{tmp_path}/{name}", f"{tmp_path}/mark-{name}", ["k"], every=2))
    last = {x.k: (x.ts, x.v, x.seen) for x in live.current(spark, f"{tmp_path}/last", ["k"]).collect()}
    assert last == {"a": (at(22), 7, None), "b": (at(23.5), 4, at(9)), "c": (at(21), 1, None)}
    # b's silence from 1 to 20 was not over at the end of its first file: its totals run on; a's was, and a begins anew
    totals = {x.k: (x.n, x.total) for x in live.current(spark, f"{tmp_path}/sum", ["k"]).collect()}
    assert totals["a"] == (1, 7) and totals["b"] == (4, 12) and totals["c"] == (1, 1)
    add(spark, src, [("c", at(60), 9, None)], schema)
    run(live.changes(live.live_rows(stream, ["k"], "ts", "10 hours"), f"{tmp_path}/last", f"{tmp_path}/mark-last", ["k"], every=2))
    assert {x.k for x in live.current(spark, f"{tmp_path}/last", ["k"]).collect()} == {"c"}


def test_files_are_bounded_by_live_keys(spark, tmp_path):
    src, out, schema = f"{tmp_path}/in", f"{tmp_path}/out", "match_id string, innings_number int, runs_total int, is_wicket boolean, extra_type string"
    stream = None
    for k in range(9):
        add(spark, src, [(f"m{i}", 1, k, i == k, None) for i in range(4)], schema)
    stream = live.source(spark, src, spark.createDataFrame([], schema).schema, 1)
    key = ["match_id", "innings_number"]
    run(live.changes(live.scoreboard(stream), out, f"{tmp_path}/mark", key, every=2))
    assert {tuple(x) for x in live.current(spark, out, key).collect()} == {(f"m{i}", 1, 36, 1, 9) for i in range(4)}
    bases, epochs = shared.numbered(spark, out, "base"), shared.numbered(spark, out, "epoch")
    assert bases == [5, 7] and epochs == [6, 7, 8]
    # a compaction that runs again changes nothing
    live.compact(spark, out, key, 7)
    assert live.current(spark, out, key).count() == 4 and shared.numbered(spark, out, "base") == [5, 7]


def test_ids_follow_a_dimension_that_changes(spark, tmp_path):
    src, dim, out, schema = f"{tmp_path}/in", f"{tmp_path}/dim", f"{tmp_path}/out", "match string, team string"

    def named(batch):
        return batch.join(live.dimension(batch.sparkSession, dim), "team", "left")

    for k, ids in enumerate(([("a", 1)], [("a", 10), ("b", 20)])):
        live.publish(spark.createDataFrame(ids, "team string, id int"), dim)
        add(spark, src, [(f"m{k}", "a"), (f"m{k}", "b")], schema)
        run(live.enriched(live.source(spark, src, spark.createDataFrame([], schema).schema), named, out, f"{tmp_path}/mark"))
    assert {(x.match, x.team, x.id) for x in spark.read.parquet(out).collect()} == {("m0", "a", 1), ("m0", "b", None), ("m1", "a", 10), ("m1", "b", 20)}
    with pytest.raises(IndexError):
        live.dimension(spark, f"{tmp_path}/nothing")
