import datetime as dt
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from covermetrics.plans.registry import Book, all_plans
from covermetrics.session import scratch_path
from covermetrics.streaming import jobs

RAW = "file_name string, extracted string"


def land(spark, folder, rows):
    spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(folder)


def body(number, premium="100"):
    return f'{{"policy_number": "{number}", "annual_premium": "{premium}", "coverages": [{{"line": "A", "limit": "1"}}]}}'


def test_intake_skips_seen_files_and_known_policies(spark):
    folder, targets, checkpoint = scratch_path(spark, "t-land"), jobs.IntakeTargets(scratch_path(spark, "t-out")), scratch_path(spark, "t-cp")

    def run():
        stream = jobs.file_stream(spark, folder, spark.createDataFrame([], RAW).schema)
        jobs.drain(jobs.intake_stream(stream, targets, checkpoint, "2024-06-30"))
    land(spark, folder, [("a", body("P-1")), ("b", "{broken json here"), ("c", body("P-1", "50"))])
    run()
    run()  # nothing new
    land(spark, folder, [("d", body("P-1", "999")), ("e", body("P-2"))])
    run()
    policies = {r.policy_id: r.premium for r in spark.read.parquet(targets.path("policies")).collect()}
    assert policies == {"P-1": 100.0, "P-2": 100.0}  # the first document wins
    children = spark.read.parquet(targets.path("coverages")).collect()
    assert sorted(r.policy_id for r in children) == ["P-1", "P-2"] and len({r.child_id for r in children}) == 2
    assert spark.read.parquet(targets.path("customers")).count() == 2
    touched = {r.file_name: r.tables_updated for r in spark.read.parquet(targets.path("log")).collect()}
    assert touched["a"] == touched["e"] == ["customers", "policies", "coverages"] and touched["c"] is touched["d"] is None
    assert spark.read.parquet(targets.path("log")).count() == 5
    assert [r.status for r in spark.read.parquet(targets.path("quarantine")).collect()] == ["JSON_PARSE_FAILED"]


def test_failed_batch_is_logged(spark):
    folder, targets, checkpoint = scratch_path(spark, "t-land"), jobs.IntakeTargets(scratch_path(spark, "t-out")), scratch_path(spark, "t-cp")
    land(spark, folder, [("a", body("P-1"))])
    stream = jobs.file_stream(spark, folder, spark.createDataFrame([], RAW).schema)
    with pytest.raises(StreamingQueryException):
        jobs.drain(jobs.intake_stream(stream, targets, checkpoint, "not a date"))
    assert [(r.file_name, r.status) for r in spark.read.parquet(targets.path("errors")).collect()] == [("a", "ERROR")]


@pytest.mark.parametrize("name", ["stream_alert_windows", "stream_sessions", "stream_index"])
def test_streams_read_tables_of_many_files(spark, name, tmp_path):
    source = "/root/testdata/sf0.001"
    for table in os.listdir(source):
        if table in ("events.parquet", "documents.parquet"):
            spark.read.parquet(f"{source}/{table}").repartition(3).write.parquet(str(tmp_path / table))
        else:
            os.symlink(f"{source}/{table}", tmp_path / table)
    plan = all_plans()[name]
    many, one = ([tuple(r) for r in plan.build(Book(spark, folder)).collect()] for folder in (str(tmp_path), source))
    assert sorted(many, key=str) == sorted(one, key=str) and one


def test_alerts_behind_the_watermark_are_dropped(spark):
    schema = "alert_id long, reported_at timestamp_ntz, event_type string, severity string, value decimal(18,2)"
    folder, out, checkpoint = scratch_path(spark, "t-alerts"), scratch_path(spark, "t-win"), scratch_path(spark, "t-wcp")

    def send(*days):
        spark.createDataFrame([(1, d, "hail", "Severe", None) for d in days], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.file_stream(spark, folder, spark.createDataFrame([], schema).schema)
        jobs.drain(jobs.append_to(jobs.alert_windows(stream, "1 day", "1 day"), out, checkpoint))
    send(dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 5, 10))
    send(dt.datetime(2024, 1, 1, 11), dt.datetime(2024, 1, 9, 10))  # the first one is days late
    got = {(r.window_start.day, r.alerts) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 1), (5, 1)}


def test_staged_pdf_listing(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "b.txt").write_bytes(b"no")
    out, checkpoint = scratch_path(spark, "t-files"), scratch_path(spark, "t-fcp")
    jobs.drain(jobs.append_to(jobs.staged_files(spark, str(tmp_path)).select("path", "length"), out, checkpoint))
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 1 and rows[0].path.endswith("a.pdf") and rows[0].length == 6


def test_uuid_keys_are_unique(spark):
    assert spark.range(100).select(F.expr("uuid()").alias("u")).distinct().count() == 100
