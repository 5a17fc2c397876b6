"""Run telemetry: durations, completions and errors from a log of run events.

An event table has ``run_id, seq, ts, kind, stage, report_type, status, error_type, error_message``; events
of a run are ordered by ``(ts, seq)`` and ``seq`` is unique within the run. Many runs share one table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_EVENTS_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("report_type", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)

# Event kinds, the failed status and the error type that stands for any error.
JOB_START = "job_start"
STAGE_START = "stage_start"
STAGE_END = "stage_end"
JOB_END = "job_end"
FAILED = "failed"
PROCESSING_ERROR = "processing_error"

# The bound on the events of one run at one instant that are paired in one task.
ROWS_PER_SLOT = 2_000_000
MINUTE_US = 60_000_000


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000)


def slots(rows_per_slot: int = ROWS_PER_SLOT) -> list[Column]:
    """What a run is cut into, finest first: instants, split by ``seq``; minutes; the whole run.

    Each slot holds a stretch of the order ``(ts, seq)`` and lies within one of the next. The list is the same for any
    number of events, so no event is read to choose it.
    """
    micros = F.unix_micros("ts")
    part = F.floor(F.col("seq") / F.lit(rows_per_slot)).cast("bigint")
    return [
        F.struct(micros.alias("time"), part.alias("part")),
        F.floor(micros / F.lit(MINUTE_US)).cast("bigint"),
        F.lit(0),
    ]


BEFORE = ["kind_before", "ts_before", "stage_before"]


def _with_neighbours(events: DataFrame, slot: Column) -> DataFrame:
    """Each event with kind, time and stage of the one before it in its run and slot, and whether one follows."""
    order = Window.partitionBy("run_id", "slot").orderBy("ts", "seq")
    before = [F.lag(name.removesuffix("_before")).over(order).alias(name) for name in BEFORE]
    has_next = F.lead(F.lit(True), 1, False).over(order).alias("has_next")
    return events.withColumn("slot", slot).select("*", *before, has_next)


def stage_durations(events: DataFrame, rows_per_slot: int = ROWS_PER_SLOT) -> DataFrame:
    """Seconds of every stage that was closed: ``run_id, seq, stage, seconds, ended_at``.

    A stage is closed by the next stage event of its run. An end reports under its own name, a new start under
    the name of the stage it closes. An end without an open stage reports nothing, and neither does a stage
    that is still open when the events stop.

    Each event needs the one before it. A run that holds much of the table must not land in one task, so runs
    are cut into time slots: neighbours are paired inside a slot first. Only the first and the last event of each
    slot go on to the next wider slot, where the first ones meet the last ones before them, and in the end to the
    run as a whole, which then has at most two events per minute.
    """
    staged = events.where(F.col("kind").isin(STAGE_START, STAGE_END)).select("run_id", "seq", "ts", "kind", "stage")
    rows, pairs = staged.withColumn("open", F.lit(True)), []
    for slot in slots(rows_per_slot):
        placed = _with_neighbours(rows, slot)
        first = F.col("kind_before").isNull()
        pairs.append(placed.where(F.col("open") & ~first).select(*staged.columns, *BEFORE))
        outer = placed.where(first | ~F.col("has_next"))
        rows = outer.select(*staged.columns, (F.col("open") & first).alias("open"))
    starts_new = (F.col("kind") == STAGE_START) & (F.length("stage_before") > 0)
    return (
        reduce(DataFrame.unionByName, pairs)
        .where((F.col("kind_before") == STAGE_START) & ((F.col("kind") == STAGE_END) | starts_new))
        .select(
            "run_id",
            "seq",
            F.when(F.col("kind") == STAGE_START, F.col("stage_before")).otherwise(F.col("stage")).alias("stage"),
            seconds_between(F.col("ts_before"), F.col("ts")).alias("seconds"),
            F.col("ts").alias("ended_at"),
        )
    )


def run_durations(events: DataFrame) -> DataFrame:
    """Per run that ended: its last status, and the seconds from its first event to that end.

    Grouping by the end event first leaves one row per run and end, by a hash aggregate on the scan side; only
    those rows are compared as structs.
    """
    end = F.when(F.col("kind") == JOB_END, F.struct("ts", "seq", "status"))
    ends = events.groupBy("run_id", end.alias("end")).agg(F.min("ts").alias("started_at"))
    return (
        ends.groupBy("run_id")
        .agg(F.min("started_at").alias("started_at"), F.max("end").alias("end"))
        .where(F.col("end").isNotNull())
        .select(
            "run_id",
            F.col("end.status").alias("status"),
            seconds_between(F.col("started_at"), F.col("end.ts")).alias("seconds"),
            F.col("end.ts").alias("ended_at"),
        )
    )


def job_completion(events: DataFrame) -> DataFrame:
    """Ended runs and their seconds by status."""
    return (
        run_durations(events)
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("runs"), F.sum("seconds").alias("total_seconds"))
    )


def error_events(events: DataFrame) -> DataFrame:
    """Failed ends, once under their error class and report type, and once more, if there is a message,
    under the one error type that all errors share (``report_type`` is NULL there)."""
    by_class = F.struct(F.col("error_type"), F.col("report_type"))
    by_message = F.when(
        F.length("error_message") > 0,
        F.struct(F.lit(PROCESSING_ERROR).alias("error_type"), F.lit(None).cast("string").alias("report_type")),
    )
    failed = events.where((F.col("kind") == JOB_END) & (F.col("status") == FAILED))
    forms = F.filter(F.array(by_class, by_message), lambda form: form.isNotNull())
    errors = failed.select(F.col("ts").alias("ended_at"), F.explode(forms).alias("error"))
    return errors.select("ended_at", "error.error_type", "error.report_type")


def job_errors(events: DataFrame) -> DataFrame:
    return error_events(events).groupBy("error_type", "report_type").agg(F.count(F.lit(1)).alias("errors"))
