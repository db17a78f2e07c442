"""Transactions from event sequences: by commit markers, or by the logical clock's boundaries.

Events have file_ord, pos and event_type. Files are independent sequences: a transaction
doesn't cross files, as logs rotate between transactions (``crossing_transactions`` finds
any that do). Running counts go by segments of a file (``SEGMENT_BYTES`` of positions).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .prefix import running

SEGMENT_BYTES = 64 << 20
XID, ROTATE, QUERY, GTID, ANONYMOUS_GTID = 16, 4, 2, 33, 34


def assemble(events: DataFrame, is_commit: Column | None = None, segment: Column | None = None) -> DataFrame:
    """``events`` with txn_seq (1-based over all files in order) and complete (whether its commit marker exists).

    A transaction is the run of events up to and with a commit marker: the source's ``ends_txn`` where events have it (so that
    a schema change is a transaction of its own), else XID. There is no limit to
    its number of events. Events behind a file's last marker are incomplete.
    """
    default = F.col("ends_txn") if "ends_txn" in events.columns else F.col("event_type") == XID
    marker = F.coalesce(default if is_commit is None else is_commit, F.lit(False)).cast("int")
    segment = segment if segment is not None else F.floor(F.col("pos") / SEGMENT_BYTES)
    events = events.withColumn("_marker", marker)
    counted = running(events, ["file_ord"], [F.col("pos")], segment, {"_before": ("sum", F.col("_marker"))}, exclusive=True)
    files = events.groupBy("file_ord").agg(F.sum("_marker").alias("_commits"))
    earlier = Window.orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.withColumn("_files_before", F.coalesce(F.sum("_commits").over(earlier), F.lit(0)))
    joined = counted.join(files, "file_ord")
    return joined.withColumn("txn_seq", F.col("_files_before") + F.col("_before") + 1).withColumn("complete", F.col("_before") < F.col("_commits")).drop("_marker", "_before", "_commits", "_files_before")


def complete_only(assembled: DataFrame) -> DataFrame:
    return assembled.where("complete").drop("complete")


def incomplete_tail(assembled: DataFrame) -> DataFrame:
    return assembled.where(~F.col("complete")).drop("complete")


def by_logical_clock(events: DataFrame) -> DataFrame:
    """``events`` with txn_no within the file: from one GTID event to the next; events before the first are left out.

    A transaction ends with its XID, a rotation, or (where events have the source's ``ends_txn``) with its
    statement, as schema changes do; what follows up to the next GTID belongs to none and is left out.
    """
    kind, pos = F.col("event_type"), F.col("pos")
    ended = F.coalesce(F.col("ends_txn"), F.lit(False)) if "ends_txn" in events.columns else F.lit(False)
    events = events.withColumn("_begin", F.when(kind.isin(GTID, ANONYMOUS_GTID), pos)).withColumn("_end", F.when(kind.isin(XID, ROTATE) | ended, pos))
    # The newest begin is the row's own transaction; the newest end is looked for before the row.
    segment = F.floor(pos / SEGMENT_BYTES)
    out = running(events, ["file_ord"], [pos], segment, {"txn_no": ("count", F.col("_begin")), "_from": ("max", F.col("_begin"))})
    out = running(out, ["file_ord"], [pos], segment, {"_until": ("max", F.col("_end"))}, exclusive=True)
    open_ = (F.col("txn_no") > 0) & (F.col("_until").isNull() | (F.col("_until") < F.col("_from")))
    return out.where(open_).drop("_begin", "_end", "_from", "_until")


def summary(assembled: DataFrame) -> DataFrame:
    """One row for each transaction: events, bytes, first and last position."""
    return assembled.groupBy("txn_seq").agg(F.count("*").alias("n_events"), F.sum("event_len").alias("n_bytes"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


def crossing_transactions(events: DataFrame) -> DataFrame:
    """Files whose last event isn't the end of a transaction, though another file follows."""
    last = events.groupBy("file_ord").agg(F.max_by("event_type", "pos").alias("last_type"))
    newest = events.agg(F.max("file_ord").alias("newest"))
    return last.join(F.broadcast(newest), F.col("file_ord") < F.col("newest")).where(~F.col("last_type").isin(XID, ROTATE, 3)).select("file_ord", "last_type")
