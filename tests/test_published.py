"""Files taken once each: publication, replays, replaced files, compaction, states, headers, notifications."""

from __future__ import annotations

import gzip
import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from usagemill.operators import file_states, stats
from usagemill.operators.samples import Samples
from usagemill.plans import incremental, queries
from usagemill.plans.incremental import ReportShape, choose_files, published_table, stage_files, take_folder, take_notified
from usagemill.plans.report_job import ReportRun, run_report_job, table_samples
from usagemill.sinks import file_sizes, tables
from usagemill.sinks.published import PublishedTable
from usagemill.sources.header_registry import HeaderRegistry
from usagemill.sources.listing import list_files
from usagemill.streaming import ingest

SHAPE = ReportShape("sessions")
HEADER = "UserId,SessionId,SessionStartTime,SessionEndTime"


def put(folder, name, sessions, header=HEADER):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [f" u{s % 3} ,s{s},2024-01-01 10:00:00,2024-01-01 10:{s % 60:02d}:00" for s in sessions]
    path.write_text("\n".join([header, *lines]) + "\n")
    return path


def take(spark, tmp_path, **options):
    return list(take_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), SHAPE, "2024-01-15", **options))


def table_of(spark, tmp_path):
    return published_table(str(tmp_path / "out"), "sessions", spark)


def sessions(spark, tmp_path, schema):
    return sorted(int(row["SessionId"][1:]) for row in table_of(spark, tmp_path).read(spark, schema).collect())


def test_each_file_once(spark, tmp_path):
    put(tmp_path / "in", "a.csv", range(5))
    put(tmp_path / "in", "deep/er/b {odd} [x]*.csv", range(5, 9))
    [first] = take(spark, tmp_path)
    assert (first.files, first.rows) == (2, 9)
    assert take(spark, tmp_path) == []
    put(tmp_path / "in", "c.csv", range(9, 12))
    assert [one.files for one in take(spark, tmp_path)] == [1]
    assert sessions(spark, tmp_path, first.schema) == list(range(12))
    assert table_of(spark, tmp_path).files(spark).count() == 3


def test_backlog_takes_several_runs(spark, tmp_path):
    for i in range(5):
        put(tmp_path / "in", f"{i}.csv", [i])
    runs = take(spark, tmp_path, files_per_run=2)
    assert [one.files for one in runs] == [2, 2, 1]
    assert sessions(spark, tmp_path, runs[0].schema) == list(range(5))


def test_run_that_dies_before_publication_leaves_nothing(spark, tmp_path):
    put(tmp_path / "in", "a.csv", range(4))
    table = table_of(spark, tmp_path)
    registry = incremental.registry_of(str(tmp_path / "out"))
    chosen = choose_files(spark, table, list_files(spark, str(tmp_path / "in")), "2024-01-15", 10)
    staged = stage_files(spark, table, chosen, "dead", SHAPE, registry)
    assert sessions(spark, tmp_path, staged.schema) == [] and table.files(spark).isEmpty()
    assert table.state(spark, "usage", file_states.USAGE_SCHEMA).isEmpty()
    # The same run staged again over its remains, and published twice.
    again = stage_files(spark, table, chosen, "dead", SHAPE, registry)
    for _ in range(2):
        table.publish(spark, "dead", again.files, again.rows)
    assert sessions(spark, tmp_path, staged.schema) == [0, 1, 2, 3]
    assert table.commits(spark).count() == 1
    assert take(spark, tmp_path) == []


def test_two_jobs_at_once_and_a_replaced_file(spark, tmp_path):
    path = put(tmp_path / "in", "a.csv", range(4))
    table, registry = table_of(spark, tmp_path), incremental.registry_of(str(tmp_path / "out"))
    chosen = choose_files(spark, table, list_files(spark, str(tmp_path / "in")), "2024-01-15", 10)
    for run in ("one", "two"):
        staged = stage_files(spark, table, chosen, run, SHAPE, registry)
    for run in ("one", "two"):
        table.publish(spark, run, staged.files, staged.rows)
    assert sessions(spark, tmp_path, staged.schema) == [0, 1, 2, 3]
    put(tmp_path / "in", "a.csv", [7, 8])
    os.utime(path, (path.stat().st_mtime + 5, path.stat().st_mtime + 5))
    assert [one.files for one in take(spark, tmp_path)] == [1]
    assert sessions(spark, tmp_path, staged.schema) == [7, 8]
    usage = file_states.merged_usage(table.state(spark, "usage", file_states.USAGE_SCHEMA)).first()
    assert (usage["rows"], usage["users"]) == (2, 2)


def test_tables_of_other_kinds_are_refused(spark, tmp_path):
    put(tmp_path / "in", "a.csv", range(2))
    run = ReportRun(str(tmp_path / "in"), str(tmp_path / "old"), "sessions", "2024-01-15", "job")
    run_report_job(spark, run)
    with pytest.raises(ValueError, match="batch jobs"):
        published_table(str(tmp_path / "old"), "sessions", spark)
    take(spark, tmp_path)
    with pytest.raises(ValueError, match="published"):
        tables.write_clean(spark.range(1), str(tmp_path / "out"), "sessions")


def test_job_with_once(spark, tmp_path):
    put(tmp_path / "in", "a.csv", range(6))
    run = ReportRun(str(tmp_path / "in"), str(tmp_path / "out"), "sessions", "2024-01-15", "job", timestamp_ms=5, once=True)
    first = run_report_job(spark, run)
    values = {row["name"]: row["value"] for row in first.samples.collect() if "column" not in row["labels"]}
    assert first.total_records == 6 and values["appstream_sessions_total"] == 6 and values["glue_data_quality_score"] == 100
    again = run_report_job(spark, run)
    assert again.total_records == 0
    assert {row["name"] for row in again.samples.select("name").collect()} <= {
        "glue_stage_duration_seconds", "glue_job_duration_seconds", "glue_job_completed_total"
    }
    assert sessions(spark, tmp_path, first.schema) == list(range(6))


def test_failure_in_the_statistics_publishes_nothing(spark, tmp_path, monkeypatch):
    put(tmp_path / "in", "a.csv", range(6))
    run = ReportRun(str(tmp_path / "in"), str(tmp_path / "out"), "sessions", "2024-01-15", "job", once=True)
    with monkeypatch.context() as broken:
        broken.setattr("usagemill.plans.incremental.report_samples", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run_report_job(spark, run)
    assert table_of(spark, tmp_path).files(spark).isEmpty()
    result = run_report_job(spark, run)
    assert result.total_records == 6 and sessions(spark, tmp_path, result.schema) == list(range(6))


def test_generic_report_and_mixed_headers(spark, tmp_path):
    put(tmp_path / "in", "a.csv", [1], "name,n")
    (tmp_path / "in" / "b.csv").write_text("n,other\n ,\n5, x \n")
    [taken] = take_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), ReportShape("printers"), "2024-01-15")
    rows = published_table(str(tmp_path / "out"), "printers", spark).read(spark, taken.schema).collect()
    assert sorted((row["name"] or "", row["n"], row["other"]) for row in rows) == [("", "5", "x"), ("u1", "s1", None)]


def test_compaction(spark, tmp_path):
    for i in range(12):
        put(tmp_path / "in", f"2024-01-{i % 3 + 1:02d}/{i}.csv", range(10 * i, 10 * i + 10))
    date = F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})/", 1)
    runs = list(take_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), SHAPE, date, files_per_run=4))
    table, schema = table_of(spark, tmp_path), runs[0].schema
    shown = lambda: sorted(map(str, table.read(spark, schema, with_source=True).drop("run").collect()))
    states = lambda: sorted(map(str, table.state(spark, "usage", file_states.USAGE_SCHEMA).drop("minutes_sketch").collect()))
    before, stated = shown(), states()
    run = file_sizes.compact(spark, table, schema)
    assert shown() == before and states() == stated
    assert [row["run"] for row in table.live_runs(spark).collect()] == [run]
    files = list((tmp_path / "out" / "sessions" / "rows" / f"run={run}").rglob("*.parquet"))
    assert len(files) == 3
    assert file_sizes.compact(spark, table, schema) is None
    assert take(spark, tmp_path) == []


def test_runs_with_large_files_are_compacted_as_a_whole(spark, tmp_path):
    for i, n in enumerate((4000, 4, 4)):
        put(tmp_path / "in", f"{i}.csv", range(5000 * i, 5000 * i + n))
    runs = take(spark, tmp_path, files_per_run=1)
    table, schema = table_of(spark, tmp_path), runs[0].schema
    shown = lambda: sorted(map(str, table.read(spark, schema, with_source=True).drop("run").collect()))
    before, target = shown(), 16 << 10
    live = lambda: sorted(row["run"] for row in table.live_runs(spark).collect())
    listed = lambda: sorted(row["run"] for row in file_sizes.live_files(spark, table).collect())
    small = file_sizes.compact(spark, table, schema, target)
    assert live() == sorted([runs[0].run, small]) and set(listed()) == set(live())
    assert file_sizes.compact(spark, table, schema, target) is None
    run = file_sizes.compact(spark, table, schema, target, whole=True)
    assert shown() == before and live() == [run] and listed() == [run] * len(listed())
    assert file_sizes.compact(spark, table, schema, target, whole=True) is None


@pytest.mark.parametrize("days, per_day", [(0, 0), (1, 1), (2, 120_000)])
def test_days_are_compacted_however_large_their_files_are(spark, tmp_path, monkeypatch, days, per_day):
    """No report at all, one run that has nothing to be made one with, and runs whose files are not small."""
    made, compact = [], file_sizes.compact
    monkeypatch.setattr(queries.file_sizes, "compact", lambda *args, **options: made.append(compact(*args, **options)) or made[-1])
    events = spark.range(1, 1 + days * per_day, 1, 1).select(
        F.col("id").alias("event_id"),
        F.expr(f"timestamp_ntz '2024-01-01' + make_dt_interval(cast((id - 1) div {per_day or 1} as int))").alias("ts"),
        F.pmod(F.xxhash64("id"), F.lit(1000)).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.5).alias("value"), F.lit("{}").alias("props"),
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = {row["ProcessingDate"]: (row["rows"], row["few_files"]) for row in queries.compacted_days(spark, str(tmp_path)).collect()}
    wanted = {}
    for i in range(1, 1 + days * per_day):
        if i % 17 and i % 29:
            date = "2024-01-15" if i % 2 == 0 else f"2024-01-{(i - 1) // per_day + 1:02d}"
            wanted[date] = (wanted.get(date, (0,))[0] + 1, True)
    assert found == wanted
    # Large runs are not small ones, and yet made one.
    assert [bool(run) for run in made] == [False, days > 1]


def test_hot_date_is_split(spark, tmp_path):
    rows = spark.range(200_000).select(F.col("id").cast("string").alias("SourceFile"), F.rand(1).alias("x"), F.lit("t").alias("ReportType"),
                                       F.when(F.col("id") % 100 == 0, F.concat(F.lit("d"), F.col("id") % 7)).otherwise("hot").alias("ProcessingDate"))
    table = PublishedTable(str(tmp_path / "t"))
    counts = rows.groupBy(F.col("ProcessingDate").alias("date")).agg(F.count("*").alias("rows"))
    files = lambda run: {folder.name.partition("=")[2]: len(list(folder.glob("*.parquet"))) for folder in (tmp_path / f"t/rows/run={run}/ReportType=t").iterdir()}
    table.stage_rows(file_sizes.in_files(spark, rows.repartition(20), counts, 50_000), "known")
    known = files("known")
    assert known.pop("hot") == 4 and set(known.values()) == {1}
    with file_sizes.partition_size(spark, 512 << 10):
        table.stage_rows(file_sizes.by_date(rows.repartition(20)), "unknown")
    unknown = files("unknown")
    assert unknown["hot"] > 2 and min(unknown.values()) == 1


def test_header_registry_opens_files_once(spark, tmp_path):
    registry = HeaderRegistry(str(tmp_path / "headers"))
    put(tmp_path / "in", "a.csv", [1])
    (tmp_path / "in" / "empty.csv").write_text("\n\n")
    listing = lambda: list_files(spark, str(tmp_path / "in"))
    assert registry.unknown(spark, listing()).count() == 2
    assert [row["names"] for row in registry.headers(spark, listing()).collect()] == [HEADER.split(",")]
    put(tmp_path / "in", "b.csv", [2], "x,y,z,w")
    assert [os.path.basename(row["path"]) for row in registry.unknown(spark, listing()).collect()] == ["b.csv"]
    known = registry.headers(spark, listing())
    assert {os.path.basename(row["path"]): row["names"] for row in known.collect()} == {"a.csv": HEADER.split(","), "b.csv": list("xyzw")}
    assert registry.unknown(spark, listing()).isEmpty()


def jobs(spark, rows):
    return spark.createDataFrame(rows, "report_type string, report_date string, trigger_file string")


def test_notified_files(spark, tmp_path):
    """One file twice, one that is gone, one of another type; a batch that is done again after it died half-way."""
    a, b = put(tmp_path / "in", "a.csv", [1]), put(tmp_path / "in", "b 2.csv", [2, 3])
    gone = f"file:{tmp_path}/in/gone.csv"
    wanted = [("sessions", "2024-01-02", f"file:{a}"), ("sessions", "2024-01-01", f"file:{a}"), ("sessions", "2024-01-03", f"file:{b}")]
    batch = jobs(spark, [*wanted, ("sessions", "2024-01-03", gone), ("printers", "2024-01-03", f"file:{a}")])
    base = str(tmp_path / "out")
    with pytest.MonkeyPatch.context() as broken:
        real, calls = PublishedTable.publish, []

        def publish(self, *arguments):
            calls.append(arguments)
            if len(calls) > 1:
                raise RuntimeError("lost")
            real(self, *arguments)

        broken.setattr(PublishedTable, "publish", publish)
        with pytest.raises(RuntimeError, match="lost"):
            take_notified(spark, batch, base, {"sessions": SHAPE}, "b-1", files_per_run=1)
    assert take_notified(spark, batch, base, {"sessions": SHAPE}, "b-1", files_per_run=1) == 1
    assert take_notified(spark, batch, base, {"sessions": SHAPE}, "b-2") == 0
    table = table_of(spark, tmp_path)
    rows = table.read(spark, tables.T.StructType.fromDDL("SessionId string, ReportType string, ProcessingDate string")).collect()
    assert sorted((row["SessionId"], row["ProcessingDate"]) for row in rows) == [("s1", "2024-01-01"), ("s2", "2024-01-03"), ("s3", "2024-01-03")]
    assert gone in {row["trigger_file"] for row in spark.read.json(f"{base}/missing").collect()}


def test_notification_stream(spark, tmp_path):
    file = put(tmp_path / "store" / "logs" / "sessions", "2024-01-07/x.csv", [4, 5])
    key = str(file.relative_to(tmp_path / "store" / "logs"))
    events = tmp_path / "events"
    events.mkdir()
    record = {"eventName": "ObjectCreated:Put", "s3": {"bucket": {"name": "logs"}, "object": {"key": key}}}
    for turn in range(2):
        (events / f"{turn}.json").write_text(json.dumps({"Records": [record, record]}) + "\nno json\n")
        query = ingest.ingest_notified(
            spark, str(events), str(tmp_path / "out"), str(tmp_path / "checkpoint"), [SHAPE], "n", f"{tmp_path}/store/"
        )
        query.awaitTermination()
    schema = tables.T.StructType.fromDDL("SessionId string, ReportType string, ProcessingDate string")
    rows = table_of(spark, tmp_path).read(spark, schema).collect()
    assert sorted((row["SessionId"], row["ProcessingDate"]) for row in rows) == [("s4", "2024-01-07"), ("s5", "2024-01-07")]


def test_notified_runs_are_measured(spark, tmp_path):
    """Samples of each run are written and sent; the published table can be measured as a whole."""
    sent = tmp_path / "sent"
    sent.mkdir()

    def transport(body, headers):
        (sent / uuid.uuid4().hex).write_bytes(gzip.decompress(body))
        return 204

    events = tmp_path / "events"
    events.mkdir()
    for turn, names in enumerate([["2024-01-07/x.csv", "2024-01-08/y.csv"], ["2024-01-08/z.csv"]]):
        records = []
        for i, name in enumerate(names):
            put(tmp_path / "store" / "logs" / "sessions", name, range(10 * turn + 3 * i, 10 * turn + 3 * i + 3))
            records.append({"eventName": "ObjectCreated:Put", "s3": {"bucket": {"name": "logs"}, "object": {"key": f"sessions/{name}"}}})
        (events / f"{turn}.json").write_text(json.dumps({"Records": records}) + "\n")
        query = ingest.ingest_notified(
            spark, str(events), str(tmp_path / "out"), str(tmp_path / "checkpoint"), [SHAPE], "n", f"{tmp_path}/store/",
            naming=Samples("job", 5 + turn), transport=transport,
        )
        query.awaitTermination()
    lines = sorted(line for file in sent.iterdir() for line in file.read_text().splitlines())
    totals = [line for line in lines if line.startswith("appstream_sessions_total")]
    assert totals == ['appstream_sessions_total{report_type="sessions",job_name="job"} 3.0 6', 'appstream_sessions_total{report_type="sessions",job_name="job"} 6.0 5']
    assert sum("glue_records_processed_total" in line for line in lines) == 3
    written = sorted(line for file in (tmp_path / "out" / "metrics").glob("part-*") for line in gzip.open(file, "rt").read().splitlines())
    assert written == lines
    found = table_samples(spark, f"{tmp_path}/out/sessions", "sessions", Samples("job", 9)).collect()
    assert {row["value"] for row in found if row["name"] == "appstream_sessions_total"} == {9}
    day = table_samples(spark, f"{tmp_path}/out/sessions", "sessions", Samples("job", 9), "2024-01-08").collect()
    assert {row["value"] for row in day if row["name"] == "appstream_sessions_total"} == {6}


def test_profile_reads_new_files_only(spark, tmp_path):
    put(tmp_path / "in", "a.csv", range(8))
    take(spark, tmp_path)
    table = table_of(spark, tmp_path)
    (tmp_path / "in" / "b.csv").write_text("UserId,Extra\n,1\nu,\n")
    take(spark, tmp_path)
    profile = {row["column"]: row["null_pct"] for row in file_states.merged_profile(table.state(spark, "profile", file_states.PROFILE_SCHEMA)).collect()}
    assert profile == {"UserId": 10.0, "SessionId": 20.0, "SessionStartTime": 20.0, "SessionEndTime": 20.0, "Extra": 90.0}
    runs = {row["run"] for row in spark.read.parquet(f"{table.root}/state-profile").groupBy("run").count().where("count = 1").collect()}
    assert len(runs) == 2


def test_sketches_keep_their_bounds(spark):
    rows = spark.range(120_000).select(
        F.concat(F.lit("f"), F.col("id") % 9).alias("f"), F.concat(F.lit("d"), F.col("id") % 4).alias("d"),
        F.when(F.col("id") % 50_000 > 0, F.concat(F.lit("u"), F.pmod(F.xxhash64("id"), F.lit(50_000)))).alias("UserId"),
        (F.rand(3) * F.rand(4) * 100).alias(stats.DURATION),
    ).cache()
    merged = file_states.merged_usage(file_states.usage_state(rows, "f", "d")).first()
    users = rows.select("UserId").distinct().count()
    assert abs(merged["users"] - users) <= file_states.DISTINCT_BOUND * users
    for name, share in {"q25": 0.25, "q50": 0.5, "q75": 0.75}.items():
        below = rows.where(F.col(stats.DURATION) <= merged[name]).count() / 120_000
        assert abs(below - share) <= file_states.QUANTILE_BOUND
    assert merged["rows"] == 120_000 and merged["applications"] == 0
    rows.unpersist()


@pytest.mark.parametrize("cells", [3, 64, 1 << 20])
def test_bounded_top_applications(spark, cells):
    rng = random.Random(cells)
    names = [rng.choice(["a", "b", "b", None]) if i % 3 else f"rare {rng.randrange(3000)}" for i in range(9_000)]
    apps = spark.createDataFrame([(name,) for name in names], "ApplicationName string")
    assert stats.top_applications_bounded(apps, cells=cells).collect() == stats.top_applications(apps).collect()
    assert stats.top_applications_bounded(apps.limit(0)).collect() == []
    few = apps.where("ApplicationName IN ('a', 'b')")
    assert stats.top_applications_bounded(few, cells=cells).collect() == stats.top_applications(few).collect()
