from __future__ import annotations

import json

import pytest

from usagemill.operators import routing
from usagemill.sources import notifications
from usagemill.streaming import ingest


def record(name, bucket, key):
    return {"eventName": name, "s3": {"bucket": {"name": bucket}, "object": {"key": key}}}


RECORDS = [
    record("ObjectCreated:Put", "logs", "sessions/north/log-2024-03-09.csv"),
    record("ObjectCreated:Post", "logs", "applications/2024-02-03/app-2024-05-06.csv"),
    record("ObjectCreated:Copy", "logs", "applications/app.csv"),
    record("ObjectRemoved:Delete", "logs", "sessions/north/log-2024-03-09.csv"),
    record("ObjectCreated:Put", "logs", "analytics/sessions/x.csv"),
    record("ObjectCreated:Put", "logs", "sessionsx/x.csv"),
]
EXPECTED = {
    ("s3://logs/sessions/north/", "2024-03-09", "sessions", "s3://logs/" + RECORDS[0]["s3"]["object"]["key"]),
    ("s3://logs/applications/2024-02-03/", "2024-02-03", "applications", "s3://logs/" + RECORDS[1]["s3"]["object"]["key"]),
    ("s3://logs/applications/", "2024-12-31", "applications", "s3://logs/applications/app.csv"),
}


def routed(frame):
    return {(r["input_path"], r["report_date"], r["report_type"], r["trigger_file"]) for r in frame.collect()}


def write_notifications(folder):
    folder.mkdir()
    for number, records in enumerate([RECORDS[:2], RECORDS[2:], []]):
        (folder / f"{number}.json").write_text(json.dumps({"Records": records, "Extra": 1}) + "\n")


def test_every_created_report_file_is_routed(spark, tmp_path):
    write_notifications(tmp_path / "in")
    records = notifications.read_notifications(spark, str(tmp_path / "in"))
    jobs = routing.route_notifications(records, "http://m", "s3://out", "2024-12-31")
    assert routed(jobs) == EXPECTED
    assert jobs.count() == 3
    assert {(r["metrics_url"], r["output_path"]) for r in jobs.collect()} == {("http://m", "s3://out/")}


def test_today_is_the_default_date(spark):
    df = spark.createDataFrame([("sessions/x.csv",)], "key string")
    row = routing.add_report_date(df).selectExpr("report_date = date_format(current_date(), 'yyyy-MM-dd')").first()
    assert row[0] is True


def test_keys_are_decoded_on_request(spark):
    df = spark.createDataFrame([("ObjectCreated:Put", "b", "sessions/a%20b/2024-01-15.csv")], "event_name string, bucket string, key string")
    kept = routing.route_notifications(df, "u", "o").first()
    decoded = routing.route_notifications(df, "u", "o", decode_keys=True).first()
    assert kept["input_path"] == "s3://b/sessions/a%20b/"
    assert decoded["input_path"] == "s3://b/sessions/a b/"


def test_malformed_notifications_fail_loudly(spark):
    df = spark.createDataFrame([("{not json",)], "body string")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        notifications.parse_notifications(df, "body").collect()


def test_stream_routes_each_file_once(spark, tmp_path):
    write_notifications(tmp_path / "in")
    for _ in range(2):
        ingest.route_stream(
            spark, str(tmp_path / "in"), str(tmp_path / "jobs"), str(tmp_path / "check"), "u", "o", "2024-12-31"
        ).awaitTermination()
    jobs = spark.read.json(str(tmp_path / "jobs"))
    assert routed(jobs) == EXPECTED
    assert jobs.count() == 3


def test_notifications_without_a_bucket_are_listed(spark):
    rows = [("ObjectCreated:Put", None, "sessions/a.csv"), ("ObjectCreated:Put", "logs", None), ("ObjectCreated:Put", "logs", "sessions/b.csv")]
    notifications = spark.createDataFrame(rows, "event_name string, bucket string, key string")
    assert routing.route_notifications(notifications, "u", "out").count() == 1
    assert routing.unroutable(notifications).count() == 2
