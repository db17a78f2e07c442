"""Commits by group: order, high-water marks, empty transactions. Groups are independent of each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running

SEGMENT_TXNS = 1 << 20


def timeline(grid: DataFrame, txn_times: DataFrame, advance_on_empty: bool = True, segment_txns: int = SEGMENT_TXNS) -> DataFrame:
    """(group_id, txn_seq, n_rows, commit_time): the group's mark after each transaction, in transaction order.

    ``grid``: every (txn_seq, group_id) with n_rows; ``txn_times``: (txn_seq, event_time).
    The mark is the running maximum of event times of the transactions applied, or, with
    ``advance_on_empty``, also of those that had no row for the group: a quiet group is
    as fresh as the log.
    """
    rows = grid.join(txn_times.select("txn_seq", "event_time"), "txn_seq")
    moves = F.col("event_time") if advance_on_empty else F.when(F.col("n_rows") > 0, F.col("event_time"))
    out = running(rows, ["group_id"], [F.col("txn_seq")], F.floor(F.col("txn_seq") / segment_txns), {"commit_time": ("max", moves)})
    return out.select("group_id", "txn_seq", "n_rows", "commit_time")


def high_water(grid: DataFrame, txn_times: DataFrame, advance_on_empty: bool = True) -> DataFrame:
    """(group_id, last_txn, commit_time, n_rows): where each group stands; one aggregation."""
    rows = grid.join(txn_times.select("txn_seq", "event_time"), "txn_seq")
    moves = F.col("event_time") if advance_on_empty else F.when(F.col("n_rows") > 0, F.col("event_time"))
    return rows.groupBy("group_id").agg(F.max("txn_seq").alias("last_txn"), F.max(moves).alias("commit_time"), F.sum("n_rows").alias("n_rows"))


def empty_transactions(grid: DataFrame) -> DataFrame:
    return grid.groupBy("group_id").agg(F.count_if(F.col("n_rows") == 0).alias("n_empty"), F.count("*").alias("n_txns"))


def apply_in_order(routed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of each group in commit order within one partition of the group and key (what a sink applies one by one)."""
    keys = ["group_id", "tbl", "pk"]
    dealt = routed.repartition(partitions, *keys) if partitions else routed.repartition(*keys)
    return dealt.sortWithinPartitions("group_id", "tbl", "pk", "txn_seq", "event_ord", "row_ord")
