"""Rows in = rows in closed, open and late windows or sessions, over batches that come late, twice or empty."""

import datetime as dt

from covermetrics.session import scratch_path
from covermetrics.streaming import jobs
from covermetrics.streaming.ledger import Ledger, session_ledger, timed, window_ledger

SCHEMA = "alert_id long, customer_id long, reported_at timestamp_ntz, event_type string, severity string, value decimal(18,2)"


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


def frame(spark, rows):
    return spark.createDataFrame([(i, c, t, "hail", "Severe", None) for i, (c, t) in enumerate(rows)], SCHEMA)


def feed(spark, make, ledger, batches, **options):
    folder, checkpoint = scratch_path(spark, "t-alerts"), scratch_path(spark, "t-ledger-cp")
    for rows in batches:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(folder)
        jobs.drain(make(jobs.file_stream(spark, folder, frame(spark, []).schema), ledger, checkpoint, **options))


def test_windows_add_up(spark):
    ledger = Ledger(scratch_path(spark, "t-ledger"), [("event_type", "string")])
    batches = [[(1, at(1, 10)), (1, at(5, 10))], [(1, at(1, 11)), (2, at(1, 12)), (1, at(5, 11)), (1, at(9, 10))], [(1, at(20, 1)), (1, at(8, 23))]]
    feed(spark, window_ledger, ledger, batches, length="1 day", slide="1 day")
    assert sorted((r.start.day, r.rows) for r in ledger.closed(spark).collect()) == [(1, 1), (5, 2), (9, 1)]
    assert [(r.start.day, r.rows) for r in ledger.open(spark).collect()] == [(20, 1)]
    assert sorted((r.reported_at.day, r.reported_at.hour) for r in ledger.late(spark).collect()) == [(1, 11), (1, 12), (8, 23)]
    assert {r.state: (r.windows, r.rows) for r in ledger.account(spark).collect()} == {"closed": (3, 4), "open": (1, 1), "late": (2, 3)}
    assert sum(r.window_rows for r in ledger.marks(spark).collect()) == 8


def test_sliding_windows_may_be_late_for_some(spark):
    ledger = Ledger(scratch_path(spark, "t-ledger"), [("event_type", "string")])
    feed(spark, window_ledger, ledger, [[(1, at(10, 12))], [(1, at(9, 12))]], length="3 days", slide="1 day")
    # the second row belongs to windows ending on the 10th, 11th and 12th; the watermark stands at 10:00 on the 10th
    assert {r.state: (r.windows, r.rows) for r in ledger.account(spark).collect()} == {"open": (3, 5), "late": (1, 1)}


def test_sessions_join_over_batches(spark):
    ledger = Ledger(scratch_path(spark, "t-ledger"), [("customer_id", "bigint")])
    batches = [[(7, at(1, 1)), (8, at(1, 2))], [(7, at(1, 6)), (7, at(1, 0, 30)), (8, at(1, 0, 1))], [(7, at(1, 14)), (7, at(3, 0)), (8, at(1, 3))]]
    feed(spark, session_ledger, ledger, batches)
    # 0:30 and 0:01 come after 2:00 less two hours, so they count; 3:00 comes after 6:00 less two hours and is late
    assert sorted((r.customer_id, r.start.hour, r.rows) for r in ledger.closed(spark).collect()) == [(7, 0, 3), (7, 14, 1), (8, 0, 2)]
    assert [(r.customer_id, r.start.day) for r in ledger.open(spark).collect()] == [(7, 3)]
    assert [(r.customer_id, r.reported_at.hour) for r in ledger.late(spark).collect()] == [(8, 3)]


def test_replays_and_empty_batches_count_once(spark):
    ledger = Ledger(scratch_path(spark, "t-ledger"), [("event_type", "string")])
    assert ledger.account(spark).count() == 0
    first, second = timed(frame(spark, [(1, at(1, 10)), (1, at(9, 10))])), timed(frame(spark, [(1, at(9, 11)), (1, at(2, 1))]))
    for batch_id, batch in ((0, first), (1, second), (1, second), (2, first.limit(0))):
        ledger.add_windows(batch, batch_id, "1 day", "1 day")
    assert {r.state: r.rows for r in ledger.account(spark).collect()} == {"closed": 1, "open": 2, "late": 1}


def test_interval_trigger_processes_waiting_files(spark):
    folder, out, checkpoint = scratch_path(spark, "t-every"), scratch_path(spark, "t-every-out"), scratch_path(spark, "t-every-cp")
    frame(spark, [(1, at(1))]).write.parquet(folder)
    stream = jobs.file_stream(spark, folder, frame(spark, []).schema)
    query = jobs.every(jobs.append_to(stream, out, checkpoint), "1 second")
    try:
        query.processAllAvailable()
        frame(spark, [(2, at(2))]).write.mode("append").parquet(folder)
        query.processAllAvailable()
        assert spark.read.parquet(out).count() == 2
        assert query.lastProgress is not None
    finally:
        query.stop()
