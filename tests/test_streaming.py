from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from usagemill.operators.clean import with_metadata
from usagemill.sinks.tables import write_clean
from usagemill.streaming.ingest import below_input, ingest_reports, reject_stream, route_stream

HEADER = "UserId,SessionId,SessionStartTime,SessionEndTime\n"
COLUMNS = HEADER.strip().split(",")


def put(folder, name, *lines, header=HEADER):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(header + "".join(line + "\n" for line in lines))


def run(spark, tmp_path, report_type="sessions", columns=COLUMNS, **options):
    ingest_reports(
        spark,
        str(tmp_path / "in"),
        str(tmp_path / "out"),
        str(tmp_path / "check"),
        report_type,
        columns,
        default_date="2024-12-31",
        **options,
    ).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out" / report_type))


def test_each_file_is_taken_once(spark, tmp_path):
    put(tmp_path / "in", "2024/01/15/s-2024-01-15.csv", " alice ,s1,2024-01-15 10:00:00,2024-01-15 10:30:30.9", ",s2,,")
    put(tmp_path / "in", "2024/01/16/s-2024-01-16.csv", "bob,s3,n/a,")
    assert run(spark, tmp_path).count() == 2
    assert run(spark, tmp_path).count() == 2
    put(tmp_path / "in", "latest.csv", "carol,s4,,")
    rows = {
        (r["UserId"], r["SessionId"], r["SessionDurationMinutes"], r["ReportType"], str(r["ProcessingDate"]))
        for r in run(spark, tmp_path, files_per_batch=1).collect()
    }
    assert rows == {
        ("alice", "s1", 30.5, "sessions", "2024-01-15"),
        ("bob", "s3", None, "sessions", "2024-01-16"),
        ("carol", "s4", None, "sessions", "2024-12-31"),
    }


def test_layout(spark, tmp_path):
    put(tmp_path / "in", "s-2024-01-15.csv", "a,s1,,")
    run(spark, tmp_path)
    files = {p.relative_to(tmp_path / "out").parts[:3] for p in (tmp_path / "out").rglob("*.snappy.parquet")}
    assert files == {("sessions", "ReportType=sessions", "ProcessingDate=2024-01-15")}


def test_another_header_fails(spark, tmp_path):
    put(tmp_path / "in", "a.csv", "s1,alice,,", header="SessionId,UserId,SessionStartTime,SessionEndTime\n")
    with pytest.raises(StreamingQueryException):
        run(spark, tmp_path)


def test_other_report_types(spark, tmp_path):
    put(tmp_path / "in", "p-2024-01-15.csv", " x ,", ",", header="Printer,Pages\n")
    rows = run(spark, tmp_path, "printers", ["Printer", "Pages"]).collect()
    assert [(r["Printer"], r["Pages"], r["ReportType"]) for r in rows] == [("x", None, "printers")]


def test_streams_and_batch_jobs_do_not_share_a_table(spark, tmp_path):
    """The log of the streaming sink would hide the rows of the batch job."""
    clean = with_metadata(spark.range(1), "sessions", "2024-01-15")
    put(tmp_path / "in", "s-2024-01-15.csv", "a,s1,,")
    run(spark, tmp_path)
    with pytest.raises(ValueError, match="written by a stream"):
        write_clean(clean, str(tmp_path / "out"), "sessions")
    write_clean(clean, str(tmp_path / "batch"), "sessions")
    with pytest.raises(ValueError, match="written by batch jobs"):
        ingest_reports(
            spark, str(tmp_path / "in"), str(tmp_path / "batch"), str(tmp_path / "check2"), "sessions", COLUMNS
        )


def test_an_old_file_is_taken(spark, tmp_path):
    put(tmp_path / "in", "a-2024-01-15.csv", "a,s1,,")
    assert run(spark, tmp_path).count() == 1
    put(tmp_path / "in", "b-2024-01-16.csv", "b,s2,,")
    month_ago = time.time() - 30 * 86_400
    os.utime(tmp_path / "in" / "b-2024-01-16.csv", (month_ago, month_ago))
    assert run(spark, tmp_path).count() == 2
    put(tmp_path / "in", "c-2024-01-17.csv", "c,s3,,")
    assert run(spark, tmp_path).count() == 3


def test_a_date_above_the_input_does_not_count(spark, tmp_path):
    top = tmp_path / "backup 2020-01-01"
    put(top / "in", "s-2024-01-15.csv", "a,s1,,")
    assert {str(row["ProcessingDate"]) for row in run(spark, top).collect()} == {"2024-01-15"}


def test_below_input(spark):
    paths = [("s3a://b/in-2020-01-01/x/2024-01-15.csv", "s3://b/in-2020-01-01"), ("file:/a/2020-01-01/x.csv", "/a/*/x.csv")]
    found = [spark.createDataFrame([(path,)], "p string").select(below_input(F.col("p"), given)).first()[0] for path, given in paths]
    assert found == ["x/2024-01-15.csv", "2020-01-01/x.csv"]


def test_a_bad_notification_does_not_end_the_stream(spark, tmp_path):
    folder = tmp_path / "told"
    folder.mkdir()

    def tell(name, key):
        record = {"eventName": "ObjectCreated:Put", "s3": {"bucket": {"name": "logs"}, "object": {"key": key}}}
        (folder / name).write_text(json.dumps({"Records": [record, {"eventName": "ObjectCreated:Put", "s3": {}}]}))

    def routed():
        route_stream(spark, str(folder), str(tmp_path / "jobs"), str(tmp_path / "c1"), "u", "out").awaitTermination()
        reject_stream(spark, str(folder), str(tmp_path / "rejects"), str(tmp_path / "c2")).awaitTermination()
        jobs = spark.read.json(str(tmp_path / "jobs")).select("trigger_file").collect()
        bad = spark.read.schema("file string, line string").json(str(tmp_path / "rejects")).collect()
        return sorted(row["trigger_file"] for row in jobs), [row["line"] for row in bad]

    tell("a.json", "sessions/a-2024-01-15.csv")
    (folder / "b.json").write_text("{not json")
    assert routed() == (["s3://logs/sessions/a-2024-01-15.csv"], ["{not json"])
    tell("c.json", "sessions/c-2024-01-16.csv")
    assert routed() == (["s3://logs/sessions/a-2024-01-15.csv", "s3://logs/sessions/c-2024-01-16.csv"], ["{not json"])
