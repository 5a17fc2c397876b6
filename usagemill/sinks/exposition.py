"""Metric samples as text files, or pushed in batches to a metrics endpoint."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from usagemill.operators.batches import BATCH_SIZE, exposition_lines
from usagemill.session import fresh_folder
from usagemill.sinks.tables import exists
from usagemill.sources.stores import store_of

# Endpoint path, statuses that count as success, attempts, seconds per attempt.
IMPORT_PATH = "/api/v1/import/prometheus"
SUCCESS_STATUSES = (200, 204)
ATTEMPTS = 3
TIMEOUT_SECONDS = 30

# A transport sends one body with its headers and returns the status of the answer.
Transport = Callable[[bytes, dict], int]


def write_text(samples: DataFrame, path: str, compress: bool = True) -> None:
    """One line per sample, in text files; gzip unless told otherwise."""
    lines = exposition_lines(samples).select("line")
    lines.write.mode("append").option("compression", "gzip" if compress else "none").text(path)


def http_transport(url: str, timeout: float = TIMEOUT_SECONDS) -> Transport:
    """Posts to the import path of a metrics server."""
    target = url.rstrip("/") + IMPORT_PATH

    def send(body: bytes, headers: dict) -> int:
        from urllib import error, request

        try:
            with request.urlopen(request.Request(target, data=body, headers=headers), timeout=timeout) as answer:
                return answer.status
        except error.HTTPError as answer:
            return answer.code

    return send


class Ledger:
    """Which batches have been accepted: an empty file for each in a shared folder, named by the digest of its text."""

    def __init__(self, folder: str):
        self.files, self.folder = store_of(folder, named_by_spark=False)

    def _entry(self, body: bytes) -> str:
        return f"{self.folder.rstrip('/')}/{hashlib.sha256(body).hexdigest()}"

    def has(self, body: bytes) -> bool:
        from pyarrow import fs

        return self.files.get_file_info(self._entry(body)).type == fs.FileType.File

    def add(self, body: bytes) -> None:
        self.files.create_dir(self.folder, recursive=True)
        self.files.open_output_stream(self._entry(body)).close()


def _sink(
    name: str, transport: Transport, attempts: int, compress: bool, pause: Callable | None, ledger: str | None
) -> type[DataSource]:
    statuses = SUCCESS_STATUSES

    class Writer(DataSourceArrowWriter):
        def write(self, iterator):
            import gzip
            import time

            headers = {"Content-Type": "text/plain; charset=utf-8"}
            if compress:
                headers["Content-Encoding"] = "gzip"
            accepted = Ledger(ledger) if ledger else None

            def send(text):
                body = gzip.compress(text) if compress else text
                for attempt in range(1, attempts + 1):
                    try:
                        answer = transport(body, headers)
                        if answer in statuses:
                            return
                    except Exception as problem:
                        answer = repr(problem)
                    if attempt < attempts:
                        (pause or time.sleep)(2**attempt)
                raise RuntimeError(f"batch of {text.count(b'\n')} samples not accepted: {answer}")

            for records in iterator:
                for body in records.column(0).to_pylist():
                    text = body.encode("utf-8")
                    if accepted and accepted.has(text):
                        continue
                    send(text)
                    if accepted:
                        accepted.add(text)
            return WriterCommitMessage()

    class Sink(DataSource):
        @classmethod
        def name(cls):
            return name

        def writer(self, schema, overwrite):
            return Writer()

    return Sink


def _bodies(samples: DataFrame, batch_size: int) -> DataFrame:
    """``body``: the lines of at most ``batch_size`` samples of one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[str] = []
        for records in batches:
            pending += records.column(0).to_pylist()
            whole = len(pending) - len(pending) % batch_size
            out = ["\n".join(pending[at : at + batch_size]) + "\n" for at in range(0, whole, batch_size)]
            pending = pending[whole:]
            yield pa.record_batch([pa.array(out, pa.string())], names=["body"])
        if pending:
            yield pa.record_batch([pa.array(["\n".join(pending) + "\n"])], names=["body"])

    return exposition_lines(samples).select("line").mapInArrow(run, "body string")


def push_samples(
    spark: SparkSession,
    samples: DataFrame,
    transport: Transport,
    batch_size: int = BATCH_SIZE,
    attempts: int = ATTEMPTS,
    compress: bool = True,
    pause: Callable | None = None,
    ledger: str | None = None,
    outbox: str | None = None,
) -> None:
    """Sends all samples, every task its own rows in batches of at most ``batch_size``.

    A batch that is not accepted is tried again after 2 and 4 seconds; after the last attempt the task fails, and
    Spark's task retry is the only further one. ``transport`` runs in the tasks and must be picklable.

    Without a ``ledger`` a task that is run again sends its batches again: the points carry their own timestamps, so the
    store holds each once. With one, a shared folder, an accepted batch is noted there and sent again by no task and no
    later push. So that batches are the same each time, they are written to the shared folder before any is sent: to
    ``outbox``, if a push that failed is to be taken up by another call, else to a new folder. A batch is sent twice
    only if it was accepted and the task died before it could note that.
    """
    bodies = _bodies(samples, batch_size)
    if ledger:
        folder = outbox or fresh_folder(spark, "outbox")
        if not exists(spark, f"{folder}/_SUCCESS"):
            bodies.write.mode("overwrite").parquet(folder)
        bodies = spark.read.schema("body string").parquet(folder)
    name = f"exposition_{uuid.uuid4().hex}"
    spark.dataSource.register(_sink(name, transport, attempts, compress, pause, ledger))
    bodies.write.format(name).mode("append").save()
