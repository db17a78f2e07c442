"""Structured Streaming counterparts: in-order commits by group, marks, throughput, and upserted state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.versions import latest, live

HEARTBEAT = 27
#: Transaction numbers of one entry of waiting ones, and new rows that are taken together.
BLOCK, BUFFER_ROWS = 4096, 1 << 20
COMMIT_SCHEMA = "group_id int, txn_seq long, commit_us long"
#: The state store that keeps the entries of a map by themselves.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Commits the transactions of one group in order; those that came too early wait in state, ``BLOCK`` numbers to an entry.

    A batch touches the entries that it adds to and those that it commits; what goes on waiting in other entries is neither read nor written.
    New rows are taken ``BUFFER_ROWS`` at a time, as arrays, so a task's memory doesn't follow the batch.
    """

    def __init__(self, first_seq: int) -> None:
        self.first_seq = first_seq

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "next_seq long, mark_us long")
        self.waiting = handle.getMapState("waiting_blocks", "block long", "seqs binary, times binary")

    def _held(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        if not self.waiting.containsKey((block,)):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.frombuffer(bytes(x), "<i8") for x in self.waiting.getValue((block,)))

    def _taken(self, key: tuple, seqs: np.ndarray, times: np.ndarray) -> Iterator[pd.DataFrame]:
        """Add new rows to those that wait, and commit what is in order."""
        next_seq, mark = self.done.get() if self.done.exists() else (self.first_seq, 0)
        new = seqs >= next_seq
        seqs, times = seqs[new], times[new]
        order = np.argsort(seqs, kind="stable")
        seqs, times = seqs[order], times[order]
        blocks = seqs // BLOCK
        begins = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1)) if len(blocks) else blocks
        rows = {int(blocks[i]): (seqs[i:j], times[i:j]) for i, j in zip(begins, [*begins[1:], len(blocks)], strict=True)}

        def merged(block: int) -> tuple[np.ndarray, np.ndarray]:
            # What waited came before what is new: of repeated cells the first counts.
            held, more = self._held(block), rows.pop(block, None)
            if more is None:
                return held
            every, first = np.unique(np.concatenate([held[0], more[0]]), return_index=True)
            return every, np.concatenate([held[1], more[1]])[first]

        def put(block: int, seqs: np.ndarray, times: np.ndarray) -> None:
            if len(seqs):
                self.waiting.updateValue((block,), (seqs.astype("<i8").tobytes(), times.astype("<i8").tobytes()))
            elif self.waiting.containsKey((block,)):
                self.waiting.removeKey((block,))

        while True:
            block = next_seq // BLOCK
            # The next one waits only if it is new or its block's first ones were committed by rows before: a block without new rows was looked at then.
            if block not in rows and (next_seq % BLOCK or not self.waiting.containsKey((block,))):
                break
            seqs, times = merged(block)
            n = int(np.argmax(np.append(seqs != next_seq + np.arange(len(seqs)), True)))
            put(block, seqs[n:], times[n:])
            if n:
                out = np.maximum.accumulate(np.maximum(times[:n], mark))
                yield pd.DataFrame({"group_id": np.full(n, key[0], np.int32), "txn_seq": seqs[:n], "commit_us": out})
                next_seq, mark = next_seq + n, int(out[-1])
            if next_seq % BLOCK or not n:
                break
        for block in list(rows):
            put(block, *merged(block))
        self.done.update((next_seq, mark))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for frame in rows:
            held.append((frame["txn_seq"].to_numpy(np.int64), frame["event_us"].to_numpy(np.int64)))
            if sum(len(x) for x, _ in held) >= BUFFER_ROWS:
                yield from self._taken(key, *map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held:
            yield from self._taken(key, *map(np.concatenate, zip(*held, strict=True)))

    def close(self) -> None:
        pass


def ordered_commits(cells: DataFrame, first_seq: int = 1) -> DataFrame:
    """Commits of each group in transaction order, from cells (group_id, txn_seq, event_us) that may arrive out of order.

    A transaction is committed when all before it are; it waits in the group's state until
    then, however many wait. Repeated cells count once. commit_us is the group's mark: the largest event time
    committed so far. Needs the RocksDB state store, which is set for the session where nothing is.
    """
    spark = cells.sparkSession
    if ROCKSDB not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    return cells.groupBy("group_id").transformWithStateInPandas(InOrder(first_seq), COMMIT_SCHEMA, "Append", "None")


def marks(commits: DataFrame) -> DataFrame:
    """The high-water mark of each group (complete or update mode)."""
    return commits.groupBy("group_id").agg(F.max("txn_seq").alias("last_txn"), F.max("commit_us").alias("commit_us"))


def throughput(events: DataFrame, width: str = "1 second", late: str = "10 seconds", time: str = "event_time", beats: DataFrame | None = None) -> DataFrame:
    """Events in tumbling windows; a window is final when the watermark has passed it.

    ``beats``: heartbeats (any stream with the time column): they move the watermark and count for nothing, so that the windows of a source
    that has gone quiet are closed. Heartbeat events among ``events`` (of the log source: event_type 27) do so too.
    """
    beat = F.col("event_type") == HEARTBEAT if "event_type" in events.columns and dict(events.dtypes)["event_type"] == "int" else F.lit(False)
    rows = events.select(time, F.when(F.coalesce(beat, F.lit(False)), 0).otherwise(1).alias("_n"))
    if beats is not None:
        rows = rows.unionByName(beats.select(time, F.lit(0).alias("_n")))
    # A watermark above the union is one over both; below it would be the slower one's.
    counted = rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.sum("_n").alias("n_events"))
    return counted.where("n_events > 0").select(F.col("w.start").alias("window_start"), "n_events")


def quiet_marks(marks: DataFrame, beats: DataFrame) -> DataFrame:
    """``marks`` (group_id, last_txn, commit_us) advanced to the newest of ``beats`` (group_id, beat_us): a heartbeat says that a group had nothing more to commit by then."""
    newest = beats.groupBy("group_id").agg(F.max("beat_us").alias("_beat"))
    return marks.join(newest, "group_id", "left").withColumn("commit_us", F.greatest("commit_us", "_beat")).drop("_beat")


def upsert_into(path: str):  # noqa: ANN201
    """A ``foreachBatch`` function that keeps the newest version of each key as Parquet under ``path``.

    Each batch writes a new folder, named by its number, so that a repeated batch replaces
    its own output only. Every batch but the first needs the folder of the one before: without it the state is
    lost, and the batch fails. Older folders are removed. The whole state is written anew each time, which suits small states;
    ``version_store.VersionStore`` writes what a batch changes.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch if number == 0 else spark.read.schema(batch.schema).parquet(f"{path}/state-{number - 1}").unionByName(batch)
        latest(rows).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/state-{number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state-{number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return apply


def current_state(rows: DataFrame) -> DataFrame:
    return live(latest(rows))
