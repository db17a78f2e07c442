"""The progress of streaming queries as a table: one row for each trigger of each query."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = "query_id string, run_id string, name string, batch_id long, at string, n_rows long, rows_per_second double, processed_per_second double, duration_ms long"


class ProgressTable(StreamingQueryListener):
    """Samples every trigger. ``rows`` gives what hasn't been written yet; ``flush`` appends it to ``path`` as Parquet.

    ``with ProgressTable(spark, path) as table:`` samples until the block is left, and then writes what is left, so the samples of
    queries that ended before aren't lost. Inside, a thread of the table's own writes whenever ``every`` samples wait; the listener's thread, which
    Spark's events wait for, never writes.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 100) -> None:
        self.spark, self.path, self.every = spark, path, every
        self._waiting: list[tuple] = []
        self._lock, self._writing, self._full, self._ended = threading.Lock(), threading.Lock(), threading.Event(), False
        self._writer: threading.Thread | None = None

    def __enter__(self) -> ProgressTable:
        self.spark.streams.addListener(self)
        self._writer = threading.Thread(target=self._write, daemon=True)
        self._writer.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        self.spark.streams.removeListener(self)
        self._ended = True
        self._full.set()
        self._writer.join()
        self.flush()

    def _write(self) -> None:
        while not self._ended:
            self._full.wait()
            self._full.clear()
            if not self._ended:
                self.flush()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self._full.set()

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        row = (str(p.id), str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, p.inputRowsPerSecond, p.processedRowsPerSecond, (p.durationMs or {}).get("triggerExecution"))
        with self._lock:
            self._waiting.append(row)
            if len(self._waiting) >= self.every:
                self._full.set()

    def rows(self) -> DataFrame:
        with self._lock:
            return self.spark.createDataFrame(list(self._waiting), SCHEMA)

    def flush(self) -> None:
        with self._writing:
            with self._lock:
                own, self._waiting = self._waiting, []
            if own:
                self.spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)
