"""The change feed as upserts, over several batches and after a restart; windows that close."""

import datetime

from chronofact.sources.log import Log
from chronofact.streaming import jobs

DAY = datetime.datetime(2024, 1, 1)


def batch(spark, folder, rows):
    df = spark.createDataFrame([(i, DAY + datetime.timedelta(hours=h), u, k, 1.5, "{}") for i, h, u, k in rows], jobs.EVENTS)
    df.coalesce(1).write.mode("append").parquet(folder)


def state(log):
    return {r.user_id: (r.event_id, r.event_type) for r in log.rows("users").collect()}


def test_upserts(spark, tmp_path):
    source, folder = f"file://{tmp_path}/in", f"file://{tmp_path}/feed"
    for rows in ([(1, 1, 7, "a"), (2, 5, 7, "b"), (3, 2, 8, "c")], [(4, 3, 7, "late"), (5, 9, 9, "d"), (6, 9, None, "x")], [(7, 5, 7, "tie")], [(8, 1, 5, "e")], [(9, 2, 5, "f")]):
        batch(spark, source, rows)
    log = jobs.upserted(spark, source, folder, compact_every=2, files_per_batch=1)
    want = {7: (7, "tie"), 8: (3, "c"), 9: (5, "d"), 5: (9, "f")}
    assert state(log) == want
    # the records that are kept are bounded by the users and two batches, not by the batches that were
    assert log.records("users").count() <= 4 + 2 * 3
    version = log.version()
    log.append("batch 4", {"users": log.rows("users")}, version)  # a batch that comes again
    assert log.version() == version
    # a restart goes on where the stream was
    batch(spark, source, [(10, 50, 8, "new")])
    log = jobs.upserted(spark, source, folder, compact_every=2, files_per_batch=1)
    assert state(log) == want | {8: (10, "new")}
    assert state(Log(spark, f"{folder}/log", jobs.FEED)) == state(log)


def test_windows_close_once(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    batch(spark, source, [(1, 1, 7, "a"), (2, 2, 7, "a"), (3, 100, 8, "a"), (4, 101, 8, "b")])
    rows, dropped = jobs.closed_windows(spark, source)
    assert [(r.start, r.event_type, r.n, r.total) for r in rows.collect()] == [(DAY, "a", 2, 3.0)] and dropped == 0
