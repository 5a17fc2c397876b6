from __future__ import annotations

import gzip

import pytest

from usagemill.operators import samples, telemetry
from usagemill.plans.report_job import ReportRun, _check_total, _rows_of_run, run_report_job


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def sender(folder):
    def send(body, headers):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "wb") as file:
            file.write(body)
        return 200

    return send


def run_of(tmp_path, report_type, **more):
    (tmp_path / "sent").mkdir(exist_ok=True)
    return ReportRun(
        str(tmp_path / "in"),
        str(tmp_path / "out"),
        report_type,
        "2024-01-15",
        "job",
        transport=sender(str(tmp_path / "sent")),
        **more,
    )


def sent_lines(tmp_path):
    return [line for file in (tmp_path / "sent").iterdir() for line in gzip.decompress(file.read_bytes()).decode().splitlines()]


def events(spark, tmp_path):
    return spark.read.schema(telemetry.RUN_EVENTS_SCHEMA).json(str(tmp_path / "out" / "run_events"))


def test_sessions(spark, tmp_path):
    write(tmp_path / "in", "a.csv", "UserId,SessionId,SessionStartTime,SessionEndTime\n alice ,s1,2024-01-15 10:00:00,2024-01-15 10:30:00\nbob,s2,bad,\n,s3,,\n")
    write(tmp_path / "in", "b.csv", "SessionId,UserId,Extra\ns9,bob,x\n")
    result = run_report_job(spark, run_of(tmp_path, "sessions", timestamp_ms=1_700_000_000_000))
    assert result.total_records == 3
    table = spark.read.parquet(str(tmp_path / "out" / "sessions"))
    assert sorted(row["SessionId"] for row in table.collect()) == ["s1", "s2", "s9"]
    summary = spark.read.json(str(tmp_path / "out" / "summary")).first()
    assert (summary["ReportType"], summary["TotalRecords"], summary["ReportDate"]) == ("sessions", 3, "2024-01-15")
    assert summary["OutputPath"] == str(tmp_path / "out" / "sessions") + "/"
    values = {}
    for row in result.samples.collect():
        values.setdefault(row["name"], {})[row["labels"].get("column", "")] = row["value"]
    assert values[samples.UNIQUE_USERS] == {"": 2.0}
    assert values[samples.TOTAL_USAGE_MINUTES] == {"": 30.0}
    assert values[samples.RECORDS_PROCESSED_TOTAL] == {"": 3.0}
    assert values[samples.COLUMN_NULL_PERCENTAGE] == {
        "UserId": 25.0,
        "SessionId": 0.0,
        "SessionStartTime": 50.0,
        "SessionEndTime": 75.0,
        "Extra": 75.0,
    }
    assert values[samples.DATA_QUALITY_SCORE] == {"": 55.0}
    assert values[samples.JOB_COMPLETED_TOTAL] == {"": 1.0}
    stages = {row["labels"]["stage"] for row in result.samples.where(f"name = '{samples.STAGE_DURATION_SECONDS}'").collect()}
    assert stages == {"extraction", "transformation", "loading", "analytics"}
    lines = sent_lines(tmp_path)
    assert len(lines) == result.samples.count()
    assert sorted(lines) == sorted(row["value"] for row in spark.read.text(str(tmp_path / "out" / "metrics")).collect())


def totals(result):
    found = getattr(result, "samples", result)
    return {row["value"] for row in found.where(f"name = '{samples.TOTAL_RECORDS}'").collect()}


def test_runs_share_the_tables(spark, tmp_path):
    """Two runs under one date: each measures the rows it has written itself."""
    write(tmp_path / "in", "a.csv", "Printer\n hp \n")
    assert totals(run_report_job(spark, run_of(tmp_path, "printers"))) == {1.0}
    write(tmp_path / "in", "b.csv", "Printer\nxerox\n")
    assert totals(run_report_job(spark, run_of(tmp_path, "printers"))) == {2.0}
    assert telemetry.job_completion(events(spark, tmp_path)).first()["runs"] == 2
    table = spark.read.parquet(str(tmp_path / "out" / "printers"))
    assert sorted(row["Printer"] for row in table.collect()) == ["hp", "hp", "xerox"]


def test_a_run_whose_rows_cannot_be_told_apart_fails(spark, tmp_path):
    write(tmp_path / "in", "a.csv", "Printer\nhp\n")
    run = run_of(tmp_path, "printers")
    schema = run_report_job(spark, run).schema
    time = spark.read.parquet(run.clean_path).selectExpr("unix_micros(ProcessedAt)").first()[0]
    rows = _rows_of_run(spark, run, schema, {"rows": 1, "processed_us": time})
    naming = samples.Samples("job")
    found = samples.report_samples(rows, "printers", naming)
    _check_total(found, naming, 1)
    with pytest.raises(RuntimeError, match="2 rows were written, but 1"):
        _check_total(found, naming, 2)


def test_statistics_read_one_partition_of_the_written_rows(spark, tmp_path, monkeypatch, plan_of):
    found = []

    def watched(*arguments):
        found.append(_rows_of_run(*arguments))
        return found[-1]

    monkeypatch.setattr("usagemill.plans.report_job._rows_of_run", watched)
    write(tmp_path / "in", "a.csv", "Printer\nhp\n")
    run_report_job(spark, run_of(tmp_path, "printers"))
    assert [rows.count() for rows in found] == [1]
    plan = plan_of(found[0])
    pushed, partitions = plan.split("PushedFilters: [")[1], plan.split("PartitionFilters: [")[1]
    assert "EqualTo(ProcessedAt," in pushed
    assert partitions.startswith("isnotnull(ReportType") and "isnotnull(ProcessingDate" in partitions


def test_longer_lines_are_counted(spark, tmp_path):
    write(tmp_path / "in", "a.csv", "UserId,SessionId\na,s1\nb,s2,more\n")
    result = run_report_job(spark, run_of(tmp_path, "sessions"))
    assert (result.total_records, result.longer_lines) == (2, 1)
    assert result.schema.names == ["UserId", "SessionId", "ProcessedAt", "ReportType", "ProcessingDate"]


def test_a_clean_table_is_measured(spark, tmp_path):
    from usagemill.__main__ import parse
    from usagemill.plans.report_job import run_table_job

    write(tmp_path / "in", "a.csv", "ApplicationName,UserId\ncalc,u\ndraw,u\ncalc,v\n")
    run = run_of(tmp_path, "applications", timestamp_ms=1)
    run_report_job(spark, run)
    for date, rows in (("2024-01-15", 3), ("2024-01-16", 0), (None, 3)):
        found = run_table_job(spark, run.clean_path, str(tmp_path / "measured"), "applications", "job", date, 1, run.transport)
        assert totals(found) == {float(rows)}
    names = {row["name"]: row["value"] for row in found.collect()}
    assert names[samples.UNIQUE_APPLICATIONS] == 2.0 and names[samples.DATA_QUALITY_SCORE] == 100.0
    given = "--job-name j --input-path t --output-path o --report-type sessions --report-date 2024-01-15 --measure-only"
    assert parse(given.split()).measure_only


def test_headerless_files_are_generic_rows(spark, tmp_path):
    write(tmp_path / "in", "a.csv", " x ,1\n,\n")
    result = run_report_job(spark, run_of(tmp_path, "sessions", header=False))
    assert result.total_records == 2
    assert spark.read.parquet(str(tmp_path / "out" / "sessions")).columns[:2] == ["_c0", "_c1"]


def test_no_rows(spark, tmp_path):
    write(tmp_path / "in", "a.csv", "ApplicationName,UserId\n")
    result = run_report_job(spark, run_of(tmp_path, "applications"))
    assert result.total_records == 0
    names = {row["name"]: row["value"] for row in result.samples.collect()}
    assert names[samples.UNIQUE_APPLICATIONS] == 0.0
    assert names[samples.DATA_QUALITY_SCORE] == 100.0


def test_failure_is_logged_measured_and_raised(spark, tmp_path):
    (tmp_path / "out").mkdir()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        run_report_job(spark, run_of(tmp_path, "sessions"))
    kinds = [(row["kind"], row["stage"], row["status"]) for row in events(spark, tmp_path).orderBy("seq").collect()]
    assert kinds == [("job_start", None, None), ("stage_start", "extraction", None), ("job_end", None, "failed")]
    names = sorted(line.split("{")[0] for line in sent_lines(tmp_path))
    assert names == [samples.JOB_COMPLETED_TOTAL, samples.JOB_DURATION_SECONDS] + [samples.JOB_ERRORS_TOTAL] * 2
    assert not (tmp_path / "out" / "sessions").exists()


def test_scans_of_the_report_files(spark, tmp_path, plan_of):
    """The statistics read only the columns they need."""
    from usagemill.operators.clean import clean_report
    from usagemill.sources.reports import read_reports

    write(tmp_path / "in", "a.csv", "UserId,ApplicationName,Duration,A,B,C\nu,calc,1,x,y,z\n")
    raw = read_reports(spark, str(tmp_path / "in"))
    frame = samples.report_samples(clean_report(raw, "applications"), "applications", samples.Samples("job"))
    assert "ReadSchema: struct<UserId:string,ApplicationName:string>" in plan_of(frame)


def test_arguments():
    from usagemill.__main__ import parse

    run = parse(
        "--job-name j --input-path in --output-path out --report-type sessions --report-date 2024-01-15".split()
        + ["--metrics-url", "http://metrics.example:8428", "--no-header"]
    )
    assert (run.job_name, run.input_path, run.clean_path, run.header) == ("j", "in", "out/sessions/", False)
    assert run.transport is not None


def test_each_file_of_a_folder_is_taken_once_by_its_own_job(spark, tmp_path):
    header = "UserId,SessionId,SessionStartTime,SessionEndTime"
    for name in "ab":
        write(tmp_path / "in", f"{name}.csv", f"{header}\n{name},s-{name},,\n")
        run = run_of(tmp_path, "sessions", trigger_file=str(tmp_path / "in" / f"{name}.csv"), columns=tuple(header.split(",")))
        assert run_report_job(spark, run).total_records == 1
    table = spark.read.parquet(str(tmp_path / "out" / "sessions"))
    assert sorted(row["SessionId"] for row in table.collect()) == ["s-a", "s-b"]


def test_known_columns_refuse_another_header(spark, tmp_path):
    write(tmp_path / "in", "a.csv", "SessionId,UserId\ns1,a\n")
    with pytest.raises(Exception, match="header|HEADER"):
        run_report_job(spark, run_of(tmp_path, "sessions", columns=("UserId", "SessionId")))
