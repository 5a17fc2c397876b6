from __future__ import annotations

import datetime as dt
import random

import pytest

from usagemill.operators import telemetry

START = dt.datetime(2024, 1, 15, 10, tzinfo=dt.timezone.utc)


def event(run, seq, second, kind, stage=None, status=None, error_type=None, message=None, report_type="sessions"):
    return (run, seq, START + dt.timedelta(seconds=second), kind, stage, report_type, status, error_type, message)


def frame(spark, events):
    return spark.createDataFrame(events, telemetry.RUN_EVENTS_SCHEMA)


def stages(spark, events, rows_per_slot=telemetry.ROWS_PER_SLOT):
    rows = telemetry.stage_durations(frame(spark, events), rows_per_slot).collect()
    return sorted((row["run_id"], row["seq"], row["stage"], round(row["seconds"], 6)) for row in rows)


def by_hand(events):
    """What a timer that follows each run would report."""
    found, open_stage = [], {}
    for run, seq, ts, kind, stage, *_ in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        if kind not in (telemetry.STAGE_START, telemetry.STAGE_END):
            continue
        name, since = open_stage.pop(run, (None, None))
        if kind == telemetry.STAGE_END and since is not None:
            found.append((run, seq, stage, round((ts - since).total_seconds(), 6)))
        if kind == telemetry.STAGE_START:
            if name:
                found.append((run, seq, name, round((ts - since).total_seconds(), 6)))
            open_stage[run] = (stage, ts)
    return sorted(found)


def test_stage_rules(spark):
    events = [
        event("r", 0, 0, "job_start"),
        event("r", 1, 1, "stage_start", "extraction"),
        event("r", 2, 3.5, "stage_end", "extraction"),
        event("r", 3, 4, "stage_end", "nothing open"),
        event("r", 4, 5, "stage_start", "transformation"),
        event("r", 5, 6, "stage_start", "analytics"),
        event("r", 6, 8, "stage_end", "another name"),
        event("r", 7, 9, "stage_start", "loading"),
        event("r", 8, 10, "job_end", status="failed"),
    ]
    expected = [("r", 2, "extraction", 2.5), ("r", 5, "transformation", 1.0), ("r", 6, "another name", 2.0)]
    assert stages(spark, events) == expected == by_hand(events)


@pytest.mark.parametrize("rows_per_slot", [1, 3, 50, 10_000])
def test_stages_do_not_depend_on_the_slots(spark, rows_per_slot):
    """One run has most events, many at the same time; slots are cut down to single rows."""
    rng = random.Random(rows_per_slot)
    kinds = [telemetry.STAGE_START, telemetry.STAGE_END, telemetry.JOB_END]
    events = []
    for seq in range(900):
        run = "hot" if rng.random() < 0.6 else f"r{rng.randint(0, 20)}"
        second = rng.choice([0, 0.25, 1, 59, 3600, rng.randint(0, 50_000), rng.randint(0, 5_000) / 1000])
        events.append(event(run, seq, second, rng.choice(kinds), rng.choice(["a", "b", "", None])))
    assert stages(spark, events, rows_per_slot) == by_hand(events)


def test_slots_bound_the_events_of_one_instant(spark):
    df = frame(spark, [event("hot", seq, 0, telemetry.STAGE_START, "a") for seq in range(500)])
    largest = [df.groupBy("run_id", slot.alias("s")).count().agg({"count": "max"}).first()[0] for slot in telemetry.slots(50)]
    assert largest == [50, 500, 500]


def test_building_the_frame_starts_no_job(spark):
    df = frame(spark, [event("r", seq, seq, telemetry.STAGE_START, "a") for seq in range(50)])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    try:
        durations = telemetry.stage_durations(df)
        assert tracker.getJobIdsForGroup("building") == []
        durations.collect()
        assert len(tracker.getJobIdsForGroup("building")) > 0
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_stage_branches_share_the_first_shuffle(spark):
    events = [event(f"r{seq % 5}", seq, seq, telemetry.STAGE_START, "a") for seq in range(500)]
    df = telemetry.stage_durations(frame(spark, events).repartition(4))
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_completion_takes_the_last_end_of_a_run(spark):
    events = [
        event("a", 0, 0, "job_start"),
        event("a", 1, 5, "job_end", status="failed"),
        event("a", 2, 9, "job_end", status="failed"),
        event("a", 3, 9, "job_end", status="success"),
        event("a", 4, 20, "stage_start", "late"),
        event("b", 0, 2, "job_start"),
        event("b", 1, 3, "job_end", status="failed"),
        event("c", 0, 0, "job_start"),
    ]
    rows = {row["status"]: (row["runs"], row["total_seconds"]) for row in telemetry.job_completion(frame(spark, events)).collect()}
    assert rows == {"success": (1, 9.0), "failed": (1, 1.0)}


def test_errors_in_both_forms(spark):
    events = [
        event("a", 0, 0, "job_end", None, "failed", "ValueError", "boom"),
        event("b", 0, 0, "job_end", None, "failed", "ValueError", ""),
        event("c", 0, 0, "job_end", None, "failed", "ValueError", None, "applications"),
        event("d", 0, 0, "job_end", None, "success"),
    ]
    rows = {(row["error_type"], row["report_type"]): row["errors"] for row in telemetry.job_errors(frame(spark, events)).collect()}
    assert rows == {("ValueError", "sessions"): 2, ("ValueError", "applications"): 1, ("processing_error", None): 1}
