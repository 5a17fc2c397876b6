"""The registered queries as plain SQL over the same test tables, for comparison with another engine."""

from __future__ import annotations

_SESSIONS = """
sessions_raw AS (
  SELECT event_id, event_type, ts,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE '  user' || user_id || ' ' END AS "UserId",
    CASE WHEN event_id % 29 = 0 THEN NULL ELSE 's' || event_id END AS "SessionId",
    CASE WHEN event_id % 23 = 0 THEN 'n/a'
         ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS "SessionStartTime",
    CASE WHEN event_id % 31 = 0 THEN NULL
         ELSE strftime(ts + to_microseconds(CAST(1000000 * round(value * 60)
              * (CASE WHEN event_id % 37 = 0 THEN -1 ELSE 1 END) AS BIGINT)),
              '%Y-%m-%d %H:%M:%S.%f') END AS "SessionEndTime"
  FROM events),
sessions_parsed AS (
  SELECT trim("UserId", ' ') AS "UserId", "SessionId", ts,
    TRY_CAST("SessionStartTime" AS TIMESTAMP) AS s, TRY_CAST("SessionEndTime" AS TIMESTAMP) AS e
  FROM sessions_raw WHERE "UserId" IS NOT NULL AND "SessionId" IS NOT NULL),
sessions AS (
  SELECT "UserId", "SessionId", ts, epoch_us(s) AS "SessionStartTime", epoch_us(e) AS "SessionEndTime",
    (floor(epoch_us(e) / 1000000) - floor(epoch_us(s) / 1000000)) / 60 AS minutes
  FROM sessions_parsed)"""

_APPS = """
apps_raw AS (
  SELECT
    CASE WHEN event_id % 19 = 0 THEN NULL ELSE '  ' || event_type || ' ' END AS "ApplicationName",
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE '  user' || user_id || ' ' END AS "UserId",
    CASE WHEN event_id % 13 = 0 THEN 'unknown'
         ELSE CAST(CAST(round(value) AS BIGINT) AS VARCHAR) END AS "ApplicationUsageTime",
    '999' AS "Duration"
  FROM events),
apps AS (
  SELECT trim("ApplicationName", ' ') AS "ApplicationName", trim("UserId", ' ') AS "UserId",
    "ApplicationUsageTime", "Duration", TRY_CAST("ApplicationUsageTime" AS DOUBLE) AS "UsageDurationMinutes"
  FROM apps_raw WHERE "ApplicationName" IS NOT NULL AND "UserId" IS NOT NULL),
ranked_apps AS (
  SELECT "ApplicationName", count(*) AS records,
    row_number() OVER (ORDER BY count(*) DESC, "ApplicationName") AS rank
  FROM apps GROUP BY "ApplicationName")"""

_GENERIC = """
generic_raw AS (
  SELECT
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE ' ' || event_type || '  ' END AS a,
    CASE WHEN event_id % 11 = 0 OR event_id % 3 = 0 THEN NULL ELSE props END AS b,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS n
  FROM events),
generic AS (
  SELECT trim(a, ' ') AS a, trim(b, ' ') AS b, n FROM generic_raw
  WHERE a IS NOT NULL OR b IS NOT NULL OR n IS NOT NULL)"""

_NOTIFICATIONS = """
notifications AS (
  SELECT event_id, 'usage-logs' AS bucket,
    CASE event_type WHEN 'error' THEN 'ObjectRemoved:Delete' WHEN 'signup' THEN 'ObjectCreated:Post'
      ELSE 'ObjectCreated:Put' END AS event_name,
    CASE event_type
      WHEN 'view' THEN strftime(ts, 'applications/%Y/%m/%d/used-%Y-%m-%d.csv')
      WHEN 'purchase' THEN 'applications/latest/app-' || event_id || '.csv'
      WHEN 'signup' THEN 'analytics/part-' || event_id || '.parquet'
      ELSE strftime(ts, 'sessions/%Y/%m/%d/log-%Y-%m-%d.csv') END AS key
  FROM events),
dated AS (
  SELECT *, coalesce(nullif(regexp_extract(key, '(\\d{4}-\\d{2}-\\d{2})', 1), ''), '2024-02-01') AS report_date
  FROM notifications)"""

_RUN_EVENTS = """
run_events AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, ts,
    CASE WHEN event_type IN ('click', 'view') THEN 'stage_start'
         WHEN event_type IN ('purchase', 'signup') THEN 'stage_end' ELSE 'job_end' END AS kind,
    CASE WHEN event_type IN ('click', 'signup') THEN 'extraction'
         WHEN event_type IN ('view', 'purchase') THEN 'transformation' END AS stage,
    CASE WHEN user_id % 2 = 0 THEN 'sessions' ELSE 'applications' END AS report_type,
    CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE 'success' END END AS status,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0
         THEN CASE WHEN event_id % 4 = 0 THEN 'AnalysisException' ELSE 'ValueError' END END AS error_type,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0
         THEN CASE WHEN event_id % 6 = 0 THEN '' ELSE 'boom' END END AS error_message
  FROM events),
stage_pairs AS (
  SELECT run_id, seq, ts, kind, stage,
    lag(kind) OVER w AS kind_before, lag(ts) OVER w AS ts_before, lag(stage) OVER w AS stage_before
  FROM run_events WHERE kind IN ('stage_start', 'stage_end')
  WINDOW w AS (PARTITION BY run_id ORDER BY ts, seq)),
durations AS (
  SELECT run_id, seq, CASE WHEN kind = 'stage_start' THEN stage_before ELSE stage END AS stage,
    (epoch_us(ts) - epoch_us(ts_before)) / 1000000.0 AS seconds, ts AS ended_at
  FROM stage_pairs WHERE kind_before = 'stage_start'),
run_starts AS (SELECT run_id, min(ts) AS started_at FROM run_events GROUP BY run_id),
run_ends AS (
  SELECT run_id, ts AS ended_at, status,
    row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, seq DESC) AS n
  FROM run_events WHERE kind = 'job_end'),
runs AS (
  SELECT run_id, status, ended_at, (epoch_us(ended_at) - epoch_us(started_at)) / 1000000.0 AS seconds
  FROM run_ends JOIN run_starts USING (run_id) WHERE n = 1),
failures AS (
  SELECT ts AS ended_at, error_type, report_type FROM run_events WHERE kind = 'job_end' AND status = 'failed'
  UNION ALL
  SELECT ts, 'processing_error', NULL FROM run_events
  WHERE kind = 'job_end' AND status = 'failed' AND error_message <> '')"""

_LINES = """
lines AS (
  SELECT event_id, epoch_us(ts) // 1000 AS timestamp_ms,
    'event_value{event_type="' || event_type || '",props="' || replace(props, '"', '\\"')
      || '",job_name="usage_job"} ' || CAST(value AS VARCHAR) || ' ' || (epoch_us(ts) // 1000) AS line
  FROM events)"""

_SHOWN_SESSIONS = """"UserId", "SessionId", "SessionStartTime", "SessionEndTime",
  round(minutes, 6) AS "SessionDurationMinutes" """

_CLEAN_TABLE = f"""WITH {_SESSIONS}
SELECT {_SHOWN_SESSIONS}, 'sessions' AS "ReportType", '2024-01-15' AS "ProcessingDate" FROM sessions"""

_ROUTED = f"""WITH {_NOTIFICATIONS}
SELECT 'http://metrics.example:8428' AS metrics_url,
  's3://' || bucket || '/' || regexp_replace(key, '/[^/]*$', '') || '/' AS input_path,
  's3://usage-logs/analytics/' AS output_path, report_date,
  CASE WHEN key LIKE 'sessions/%' THEN 'sessions' ELSE 'applications' END AS report_type,
  's3://' || bucket || '/' || key AS trigger_file
FROM dated
WHERE event_name LIKE 'ObjectCreated%' AND (key LIKE 'sessions/%' OR key LIKE 'applications/%')"""


def _null_percent(table: str, missing: dict[str, str]) -> str:
    """Percent missing per column; ``missing`` maps each column to the condition that a cell is missing."""
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS "column", coalesce(100.0 * count(*) FILTER (WHERE {condition}) / nullif(count(*), 0), 0)
            AS null_pct FROM {table}"""
        for name, condition in missing.items()
    )


def _missing(names: list[str]) -> dict[str, str]:
    return {name: f'"{name}" IS NULL OR coalesce(isnan(TRY_CAST("{name}" AS DOUBLE)), false)' for name in names}


_SESSION_NULLS = _null_percent("sessions_raw", _missing(["UserId", "SessionId", "SessionStartTime", "SessionEndTime"]))
_APP_NULLS = _null_percent("apps_raw", _missing(["ApplicationName", "UserId", "ApplicationUsageTime", "Duration"]))
_GENERIC_NULLS = _null_percent("generic_raw", _missing(["a", "b", "n"]))
_LINEITEM_NULLS = _null_percent(
    "lineitem",
    {name: f"{name} IS NULL" for name in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]}
    | {
        name: f"{name} IS NULL OR isnan({name})"
        for name in ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    }
    | _missing(["l_returnflag", "l_linestatus"]),
)


def _sample(name: str, value: str, labels: str, source: str) -> str:
    return f"""SELECT '{name}' AS name, round(CAST({value} AS DOUBLE), 3) AS value,
      {labels} AS labels, CAST(1706745600000 AS BIGINT) AS timestamp_ms FROM {source}"""


def _labels(**labels: str) -> str:
    """Label text with fixed values; ``job_name`` comes last."""
    pairs = [f'{key}="{value}"' for key, value in {**labels, "job_name": "usage_job"}.items()]
    return "'" + ",".join(pairs) + "'"


def _common_samples(report_type: str, table: str) -> list[str]:
    labels = _labels(report_type=report_type)
    return [
        _sample("appstream_total_records", "count(*)", labels, table),
        _sample("appstream_last_processed_timestamp", "1706745600", labels, "(SELECT 1)"),
        _sample(
            "glue_records_processed_total",
            "count(*)",
            _labels(data_type=f"appstream_{report_type}", report_date="2024-01-15"),
            table,
        ),
    ]


def _quality_samples(report_type: str, nulls: str) -> list[str]:
    dataset = f"appstream_{report_type}_reports"
    column_labels = f"""'dataset="{dataset}",column="' || "column" || '",job_name="usage_job"'"""
    return [
        _sample("glue_column_null_percentage", "null_pct", column_labels, f"({nulls})"),
        _sample("glue_data_quality_score", "100 - avg(null_pct)", _labels(dataset=dataset), f"({nulls})"),
    ]


_APPLICATION_SAMPLES = [
    _sample("appstream_application_records_total", "count(*)", _labels(report_type="applications"), "apps"),
    _sample(
        "appstream_unique_applications",
        'count(DISTINCT "ApplicationName")',
        _labels(report_type="applications"),
        "apps",
    ),
    _sample(
        "appstream_top_applications_usage",
        "records",
        """'application="' || "ApplicationName"[1:50] || '",rank="' || rank
           || '",report_type="applications",job_name="usage_job"'""",
        "ranked_apps WHERE rank <= 10",
    ),
    *_common_samples("applications", "apps"),
    *_quality_samples("applications", _APP_NULLS),
]

# A clean table is measured by its own cells, one of them a number.
_CLEAN_APP_NULLS = _null_percent(
    "apps",
    _missing(["ApplicationName", "UserId", "ApplicationUsageTime", "Duration"])
    | {"UsageDurationMinutes": '"UsageDurationMinutes" IS NULL'},
)
_TABLE_SAMPLES = [
    *[part for part in _APPLICATION_SAMPLES if "glue_column" not in part and "glue_data" not in part],
    *_quality_samples("applications", _CLEAN_APP_NULLS),
]

_SESSION_SAMPLES = [
    _sample("appstream_sessions_total", "count(*)", _labels(report_type="sessions"), "sessions"),
    _sample("appstream_unique_users", 'count(DISTINCT "UserId")', _labels(report_type="sessions"), "sessions"),
    _sample("appstream_avg_session_duration_minutes", "coalesce(avg(minutes), 0)", _labels(), "sessions"),
    _sample("appstream_max_session_duration_minutes", "coalesce(max(minutes), 0)", _labels(), "sessions"),
    _sample("appstream_total_usage_minutes", "coalesce(sum(minutes), 0)", _labels(), "sessions"),
    *_common_samples("sessions", "sessions"),
    *_quality_samples("sessions", _SESSION_NULLS),
]


def _timed(name: str, value: str, labels: str, source: str) -> str:
    return f"""SELECT '{name}' AS name, round(CAST({value} AS DOUBLE), 3) AS value, {labels} AS labels,
      epoch_us(ended_at) // 1000 AS timestamp_ms FROM {source}"""


_TELEMETRY_SAMPLES = [
    _timed("glue_stage_duration_seconds", "seconds", """'stage="' || stage || '",job_name="usage_job"'""", "durations"),
    _timed("glue_job_duration_seconds", "seconds", """'status="' || status || '",job_name="usage_job"'""", "runs"),
    _timed("glue_job_completed_total", "1", """'status="' || status || '",job_name="usage_job"'""", "runs"),
    _timed(
        "glue_job_errors_total",
        "1",
        """'error_type="' || error_type || '",' || coalesce('report_type="' || report_type || '",', '')
           || 'job_name="usage_job"'""",
        "failures",
    ),
]


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({part})" for part in parts)


ORACLE: dict[str, str] = {
    "session_clean": f"WITH {_SESSIONS} SELECT {_SHOWN_SESSIONS} FROM sessions",
    "session_duration": f"""WITH {_SESSIONS}
        SELECT "SessionId", round(minutes, 6) AS "SessionDurationMinutes" FROM sessions""",
    "application_clean": f"WITH {_APPS} SELECT * FROM apps",
    "application_duration": f"""WITH {_APPS}
        SELECT "ApplicationUsageTime", "Duration", TRY_CAST("ApplicationUsageTime" AS DOUBLE) AS "UsageDurationMinutes"
        FROM apps_raw""",
    "generic_clean": f"WITH {_GENERIC} SELECT a, b, n FROM generic",
    "generic_clean_documents": """
        SELECT doc_id, trim(lang, ' ') AS lang, trim(source, ' ') AS source, n_chars,
          CAST(length(trim(text, ' ')) AS BIGINT) AS length, md5(trim(text, ' ')) AS md5
        FROM documents
        WHERE coalesce(doc_id, n_chars) IS NOT NULL OR coalesce(text, lang, source) IS NOT NULL""",
    "with_metadata": f"""WITH {_APPS}
        SELECT *, 'applications' AS "ReportType", '2024-01-15' AS "ProcessingDate" FROM apps""",
    "optional_columns": f"""WITH {_SESSIONS}
        SELECT "UserId" AS userid, "SessionId",
          epoch_us(TRY_CAST("SessionStartTime" AS TIMESTAMP)) AS "SessionStartTime"
        FROM sessions_raw WHERE "SessionId" IS NOT NULL""",
    "total_records": f"WITH {_SESSIONS} SELECT count(*) AS total_records FROM sessions",
    "session_unique_users": f"""WITH {_SESSIONS}
        SELECT count(*) AS unique_users FROM (SELECT DISTINCT "UserId" FROM sessions)""",
    "application_unique": f"""WITH {_APPS}
        SELECT count(*) AS unique_applications FROM (SELECT DISTINCT "ApplicationName" FROM apps)""",
    "session_duration_stats": f"""WITH {_SESSIONS}
        SELECT round(coalesce(avg(minutes), 0), 6) AS avg_minutes, round(coalesce(max(minutes), 0), 6) AS max_minutes,
          round(coalesce(sum(minutes), 0), 3) AS total_minutes FROM sessions""",
    "session_duration_summary": f"""WITH {_SESSIONS}
        SELECT 'count' AS summary, CAST(count(minutes) AS DOUBLE) AS minutes, CAST(NULL AS BOOLEAN) AS within_accuracy
        FROM sessions
        UNION ALL SELECT 'mean', round(avg(minutes), 6), NULL FROM sessions
        UNION ALL SELECT 'stddev', round(stddev_samp(minutes), 6), NULL FROM sessions
        UNION ALL SELECT 'min', round(min(minutes), 6), NULL FROM sessions
        UNION ALL SELECT '25%', NULL, true
        UNION ALL SELECT '50%', NULL, true
        UNION ALL SELECT '75%', NULL, true
        UNION ALL SELECT 'max', round(max(minutes), 6), NULL FROM sessions""",
    "session_duration_summary_exact": f"""WITH {_SESSIONS}
        SELECT 'count' AS summary, CAST(count(minutes) AS DOUBLE) AS minutes FROM sessions
        UNION ALL SELECT 'mean', round(avg(minutes), 6) FROM sessions
        UNION ALL SELECT 'stddev', round(stddev_samp(minutes), 6) FROM sessions
        UNION ALL SELECT 'min', round(min(minutes), 6) FROM sessions
        UNION ALL SELECT 'max', round(max(minutes), 6) FROM sessions""",
    "top_applications": f"""WITH {_APPS}
        SELECT "ApplicationName"[1:50] AS application, records, rank FROM ranked_apps WHERE rank <= 10""",
    "top_applications_many": """
        SELECT "ApplicationName"[1:50] AS application, records, rank FROM (
          SELECT "ApplicationName", count(*) AS records,
            row_number() OVER (ORDER BY count(*) DESC, "ApplicationName") AS rank
          FROM (SELECT 'order ' || l_orderkey || ' handled by ' || repeat('office ', 8) AS "ApplicationName" FROM lineitem)
          GROUP BY 1) WHERE rank <= 10""",
    "column_null_percentage_nan": """
        SELECT 'text' AS "column", round(coalesce(100.0 * count(*) FILTER (WHERE event_id % 7 = 0 OR event_id % 5 = 0
          OR event_id % 3 = 0) / nullif(count(*), 0), 0), 6) AS null_pct FROM events
        UNION ALL SELECT 'number', round(coalesce(100.0 * count(*) FILTER (WHERE event_id % 4 = 0 OR event_id % 9 = 0)
          / nullif(count(*), 0), 0), 6) FROM events
        UNION ALL SELECT 'single', round(coalesce(100.0 * count(*) FILTER (WHERE event_id % 6 = 0)
          / nullif(count(*), 0), 0), 6) FROM events""",
    "column_null_percentage": f"""WITH {_SESSIONS}
        SELECT "column", round(null_pct, 6) AS null_pct FROM ({_SESSION_NULLS})""",
    "column_null_percentage_lineitem": f'SELECT "column", round(null_pct, 6) AS null_pct FROM ({_LINEITEM_NULLS})',
    "data_quality_score": f"""WITH {_GENERIC}
        SELECT round(100 - avg(null_pct), 6) AS quality_score FROM ({_GENERIC_NULLS})""",
    "route_notifications": _ROUTED,
    "report_date": f"WITH {_NOTIFICATIONS} SELECT event_id, report_date FROM dated",
    "route_stream": _ROUTED,
    "metric_samples_sessions": f"WITH {_SESSIONS} {_union(_SESSION_SAMPLES)}",
    "metric_samples_applications": f"WITH {_APPS} {_union(_APPLICATION_SAMPLES)}",
    "metric_samples_generic": f"WITH {_GENERIC} {_union(_common_samples('printers', 'generic'))}",
    "metric_samples_telemetry": f"WITH {_RUN_EVENTS} {_union(_TELEMETRY_SAMPLES)}",
    "exposition_lines": f"WITH {_LINES} SELECT event_id, line FROM lines",
    "exposition_text": f"WITH {_LINES} SELECT line FROM lines",
    "metric_batches": f"""WITH {_LINES},
        numbered AS (SELECT *, row_number() OVER (ORDER BY timestamp_ms, event_id) AS n FROM lines)
        SELECT (n - 1) // 1000 AS batch_id, count(*) AS samples, string_agg(line, chr(10) ORDER BY n) || chr(10) AS body
        FROM numbered GROUP BY 1""",
    "stage_durations": f"WITH {_RUN_EVENTS} SELECT run_id, seq, stage, round(seconds, 3) AS seconds FROM durations",
    "job_completion": f"""WITH {_RUN_EVENTS}
        SELECT status, count(*) AS runs, round(sum(seconds), 3) AS total_seconds FROM runs GROUP BY status""",
    "job_errors": f"""WITH {_RUN_EVENTS}
        SELECT error_type, report_type, count(*) AS errors FROM failures GROUP BY ALL""",
    "csv_roundtrip": f"""WITH {_SESSIONS}
        SELECT trim("UserId", ' ') AS "UserId", "SessionId", "SessionStartTime", "SessionEndTime" FROM sessions_raw""",
    "csv_quoted_roundtrip": f"""WITH {_GENERIC}
        SELECT trim(a, ' ') AS a, b, CAST(n AS VARCHAR) AS n FROM generic_raw""",
    "csv_headerless": f"""WITH {_SESSIONS}
        SELECT "UserId" AS _c0, "SessionId" AS _c1, "SessionStartTime" AS _c2, "SessionEndTime" AS _c3
        FROM sessions_raw""",
    "csv_headerless_widths": """
        SELECT CAST(event_id AS VARCHAR) AS _c0, event_type || ',x' AS _c1,
          CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS _c2,
          CASE WHEN event_id % 3 <> 0 AND event_id % 4 = 0 THEN 'beyond' END AS _c3 FROM events""",
    "csv_rescued": """
        SELECT CAST(event_id AS VARCHAR) AS id, event_type || ',x' AS kind,
          CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END AS "user",
          CASE WHEN event_id % 3 <> 0 AND event_id % 4 = 0
            THEN event_id || ',"' || event_type || ',x",' || user_id || ',beyond' END AS line FROM events""",
    "csv_union_by_header": f"""WITH {_SESSIONS}
        SELECT trim("UserId", ' ') AS "UserId", "SessionId", "SessionStartTime", "SessionEndTime", NULL AS "Extra",
          NULL AS other_user FROM sessions_raw
        UNION ALL SELECT trim("UserId", ' '), "SessionId", NULL, NULL, event_type, NULL FROM sessions_raw
        UNION ALL SELECT NULL, "SessionId", NULL, NULL, NULL, trim("UserId", ' ') FROM sessions_raw""",
    "parquet_roundtrip": _CLEAN_TABLE,
    "run_summary": f"""WITH {_SESSIONS}
        SELECT 'sessions' AS "ReportType", count(*) AS "TotalRecords", '2024-01-15' AS "ReportDate",
          's3://usage-logs/sessions/' AS "InputPath", 's3://usage-logs/analytics/' AS "OutputPath" FROM sessions""",
    "stream_ingest": f"""WITH {_SESSIONS}
        SELECT {_SHOWN_SESSIONS}, 'sessions' AS "ReportType", strftime(ts, '%Y-%m-%d') AS "ProcessingDate"
        FROM sessions""",
    "stream_late_files": _CLEAN_TABLE,
    "stream_report_samples": f"WITH {_APPS} {_union(_TABLE_SAMPLES)}",
    "report_job_sessions": _CLEAN_TABLE,
    "report_job_samples": f"WITH {_APPS} {_union(_APPLICATION_SAMPLES)}",
    "job_each_file_once": _CLEAN_TABLE,
    "notified_ingest": f"""WITH {_SESSIONS}
        SELECT {_SHOWN_SESSIONS}, 'sessions' AS "ReportType", strftime(ts, '%Y-%m-%d') AS "ProcessingDate"
        FROM sessions""",
    "compacted_days": f"""WITH {_SESSIONS}
        SELECT CASE WHEN event_id % 2 = 0 THEN '2024-01-15' ELSE strftime(ts, '%Y-%m-%d') END AS "ProcessingDate",
          count(*) AS rows, true AS few_files
        FROM sessions_raw WHERE "UserId" IS NOT NULL AND "SessionId" IS NOT NULL GROUP BY 1""",
    "statistics_from_states": f"""WITH {_SESSIONS}, ends AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS last FROM sessions)
        SELECT last, count(*) AS rows, count(DISTINCT "UserId") AS users, round(coalesce(max(minutes), 0), 6) AS max_minutes,
          round(coalesce(sum(minutes), 0), 3) AS total_minutes, round(coalesce(avg(minutes), 0), 6) AS avg_minutes,
          true AS users_within, true AS quartiles_within
        FROM sessions JOIN ends ON strftime(ts, '%Y-%m-%d') <= last GROUP BY last""",
    "profile_from_states": f"""WITH {_SESSIONS}
        SELECT "column", round(null_pct, 6) AS null_pct FROM ({_SESSION_NULLS})""",
    "csv_union_registered": f"""WITH {_SESSIONS}
        SELECT trim("UserId", ' ') AS "UserId", "SessionId", "SessionStartTime", "SessionEndTime", NULL AS "Extra",
          NULL AS other_user FROM sessions_raw
        UNION ALL SELECT trim("UserId", ' '), "SessionId", NULL, NULL, event_type, NULL FROM sessions_raw
        UNION ALL SELECT NULL, "SessionId", NULL, NULL, NULL, trim("UserId", ' ') FROM sessions_raw""",
    "top_applications_bounded": """
        SELECT "ApplicationName"[1:50] AS application, records, rank FROM (
          SELECT "ApplicationName", count(*) AS records,
            row_number() OVER (ORDER BY count(*) DESC, "ApplicationName") AS rank
          FROM (SELECT 'order ' || l_orderkey || ' handled by ' || repeat('office ', 8) AS "ApplicationName" FROM lineitem)
          GROUP BY 1) WHERE rank <= 10""",
}
