from __future__ import annotations

import gzip
import json
import pickle
import uuid
from urllib import error

import pytest
from pyspark.sql import functions as F

from usagemill.operators import clean, samples, summary
from usagemill.sinks import exposition, tables


def clean_sessions(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("UserId"))
    return clean.with_metadata(rows, "sessions", "2024-01-15")


def many_samples(spark, n):
    row = samples.sample("m", F.col("id"), {"k": F.col("id")}, F.lit(5))
    return samples.Samples("job").rows(spark.range(0, n, 1, 3), [row])


def test_clean_table_layout(spark, tmp_path):
    base = str(tmp_path / "out")
    frame = clean_sessions(spark)
    path = tables.write_clean(frame, base, "sessions")
    tables.write_clean(frame, base + "/", "sessions")
    assert path == f"{base}/sessions/"
    files = [p.relative_to(tmp_path / "out").parts for p in (tmp_path / "out").rglob("*.parquet")]
    assert {parts[:3] for parts in files} == {("sessions", "ReportType=sessions", "ProcessingDate=2024-01-15")}
    assert all(parts[-1].endswith(".snappy.parquet") for parts in files)
    table = tables.read_clean(spark, frame.schema, path)
    assert table.count() == 20
    assert dict(table.dtypes)["ProcessingDate"] == "string"
    assert dict(spark.read.parquet(path).dtypes)["ProcessingDate"] == "date"


def test_partitions_are_pruned(spark, tmp_path, plan_of):
    frame = clean_sessions(spark)
    path = tables.write_clean(frame, str(tmp_path), "sessions")
    one_day = tables.read_clean(spark, frame.schema, path).where("ProcessingDate = '2024-01-15'").select("UserId")
    plan = plan_of(one_day)
    assert "PartitionFilters: [isnotnull(ProcessingDate" in plan
    assert "ReadSchema: struct<UserId:string>" in plan


@pytest.mark.parametrize("report_type", ["sessions", "a b", "x:y=z%?*", "q'[1]{2}^#", '\u00e9"<|>\t~'])
def test_one_partition_is_read_alone(spark, tmp_path, report_type):
    path = str(tmp_path / "table") + "/"
    frame = clean.with_metadata(spark.range(3), report_type, "2024-01-15")
    other = clean.with_metadata(spark.range(5), "other", "2024-01-15")
    for part in (frame, other):
        part.write.mode("append").partitionBy("ReportType", "ProcessingDate").parquet(path)
    found = tables.read_partition(spark, frame.schema, path, report_type, "2024-01-15")
    assert found.count() == 3 and found.columns == frame.columns
    assert {(row["ReportType"], row["ProcessingDate"]) for row in found.collect()} == {(report_type, "2024-01-15")}


def test_summary_file(spark, tmp_path):
    for row in (
        summary.run_summary(spark.range(7), "sessions", "2024-01-15", "in/", "out/"),
        summary.known_summary(spark, 7, "sessions", "2024-01-15", "in/", "out/"),
    ):
        path = tables.write_summary(row, str(tmp_path))
    lines = [json.loads(line) for file in (tmp_path / "summary").glob("*.json") for line in file.read_text().splitlines()]
    assert len(lines) == 2 and path.endswith("/summary/")
    for line in lines:
        assert line.pop("ProcessedAt")
        assert line == {
            "ReportType": "sessions",
            "TotalRecords": 7,
            "ReportDate": "2024-01-15",
            "InputPath": "in/",
            "OutputPath": "out/",
        }


@pytest.mark.parametrize("compress, ending", [(True, ".txt.gz"), (False, ".txt")])
def test_text_files(spark, tmp_path, compress, ending):
    exposition.write_text(many_samples(spark, 9), str(tmp_path / "m"), compress)
    lines = []
    for file in (tmp_path / "m").glob("part-*"):
        assert file.name.endswith(ending)
        lines += (gzip.open(file, "rt") if compress else file.open()).read().splitlines()
    assert sorted(lines) == [f'm{{k="{i}",job_name="job"}} {i}.0 5' for i in range(9)]


def fake_transport(folder, answers):
    """Keeps what it is sent in files; the first answers of every task are given, then all is accepted."""
    state = {"calls": 0}

    def send(body, headers):
        state["calls"] += 1
        answer = answers[state["calls"] - 1] if state["calls"] <= len(answers) else 204
        name = f"{folder}/{uuid.uuid4().hex}"
        with open(name, "wb") as file:
            file.write(pickle.dumps((answer if isinstance(answer, int) else 0, headers, body)))
        if isinstance(answer, Exception):
            raise answer
        return answer

    return send


def sent(folder):
    return [pickle.loads(file.read_bytes()) for file in folder.iterdir()]


def test_push_sends_every_sample_in_bounded_batches(spark, tmp_path):
    exposition.push_samples(spark, many_samples(spark, 100), fake_transport(str(tmp_path), []), batch_size=7)
    bodies = []
    for status, headers, body in sent(tmp_path):
        assert status == 204
        assert headers == {"Content-Type": "text/plain; charset=utf-8", "Content-Encoding": "gzip"}
        bodies.append(gzip.decompress(body).decode())
    lines = [line for body in bodies for line in body.splitlines()]
    assert all(body.endswith("\n") and 1 <= len(body.splitlines()) <= 7 for body in bodies)
    assert sorted(lines) == sorted(f'm{{k="{i}",job_name="job"}} {i}.0 5' for i in range(100))


@pytest.mark.parametrize("answers", [[500], [500, 429], [ConnectionError("gone")], [TimeoutError("slow"), 503], [ValueError("odd")]])
def test_push_tries_again(spark, tmp_path, answers):
    pauses = str(tmp_path / "pauses")

    def pause(seconds):
        with open(pauses, "a") as file:
            file.write(f"{seconds}\n")

    folder = tmp_path / "sent"
    folder.mkdir()
    frame = many_samples(spark, 5).coalesce(1)
    exposition.push_samples(spark, frame, fake_transport(str(folder), answers), compress=False, pause=pause)
    accepted = [body for status, headers, body in sent(folder) if status == 204]
    assert len(accepted) == 1 and len(accepted[0].splitlines()) == 5
    assert open(pauses).read().split() == ["2", "4"][: len(answers)]


def test_push_gives_up_after_the_last_attempt(spark, tmp_path):
    transport = fake_transport(str(tmp_path), [500] * 50)
    with pytest.raises(Exception, match="not accepted: 500"):
        exposition.push_samples(spark, many_samples(spark, 5).coalesce(1), transport, pause=lambda seconds: None)
    assert len(sent(tmp_path)) == 3


def test_ledger_sends_each_batch_once(spark, tmp_path):
    """A receiver that fails for good after nine batches; the push is taken up and sends what was not accepted."""
    folder, ledger, outbox = tmp_path / "sent", str(tmp_path / "ledger"), str(tmp_path / "outbox")
    folder.mkdir()
    rows = many_samples(spark, 100).repartition(3)
    push = lambda answers: exposition.push_samples(
        spark, rows.coalesce(1), fake_transport(str(folder), answers), batch_size=7, pause=lambda seconds: None, ledger=ledger, outbox=outbox
    )
    with pytest.raises(Exception, match="not accepted"):
        push([204] * 9 + [500] * 3)
    assert len(list((tmp_path / "ledger").iterdir())) == 9
    push([])
    push([])
    accepted = [gzip.decompress(body) for status, _, body in sent(folder) if status == 204]
    assert len(accepted) == len(set(accepted)) == 15
    lines = [line for body in accepted for line in body.decode().splitlines()]
    assert sorted(lines) == sorted(f'm{{k="{i}",job_name="job"}} {i}.0 5' for i in range(100))


def test_http_transport(monkeypatch):
    """The request it makes, without a server."""
    seen = []

    class Answer:
        status = 204

        def __enter__(self):
            return self

        def __exit__(self, *_):
            return False

    def urlopen(request, timeout):
        seen.append((request.full_url, request.get_method(), request.data, request.headers, timeout))
        if request.data == b"bad":
            raise error.HTTPError(request.full_url, 400, "bad", {}, None)
        return Answer()

    monkeypatch.setattr("urllib.request.urlopen", urlopen)
    send = exposition.http_transport("http://metrics.example:8428/")
    assert send(b"text", {"Content-Type": "text/plain"}) == 204
    assert send(b"bad", {}) == 400
    url, method, data, headers, timeout = seen[0]
    assert (url, method, data, timeout) == ("http://metrics.example:8428/api/v1/import/prometheus", "POST", b"text", 30)
    assert headers["Content-type"] == "text/plain"
