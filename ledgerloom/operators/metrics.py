"""Replay metrics as DataFrames: volume, progress, stage times, throughput. All are plain aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .transactions import XID


def totals(events: DataFrame, is_commit: Column | None = None) -> DataFrame:
    """Transactions and bytes of a log."""
    return events.agg(F.count_if(is_commit if is_commit is not None else F.col("event_type") == XID).alias("n_txns"), F.sum("event_len").alias("n_bytes"))


def by_group(routed: DataFrame) -> DataFrame:
    """Row events, their bytes (also in units of 1e8), and the last transaction, by group."""
    out = routed.groupBy("group_id").agg(F.count("*").alias("n_events"), F.sum("event_len").alias("n_bytes"), F.max("txn_seq").alias("last_txn"))
    return out.withColumn("bytes_e8", F.col("n_bytes") / 1e8)


def stage_means(timings: DataFrame) -> DataFrame:
    """Mean microseconds of dispatch, decode and commit, of (group_id, start_us, dispatched_us, parsed_us, finished_us)."""
    return timings.groupBy("group_id").agg(
        F.count("*").alias("n_txns"),
        F.avg(F.col("dispatched_us") - F.col("start_us")).alias("dispatch_us"),
        F.avg(F.col("parsed_us") - F.col("dispatched_us")).alias("parse_us"),
        F.avg(F.col("finished_us") - F.col("parsed_us")).alias("commit_us"),
    )


def throughput(events: DataFrame, width: str = "1 second", time: str = "event_time") -> DataFrame:
    """Events in each tumbling window that has any."""
    return events.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_events")


def commit_report(commits: DataFrame, width: str = "1 second", time: str = "commit_time") -> DataFrame:
    """What a committer reports, of (group_id, txn_seq, commit_time): by group and window its commits, the last transaction
    so far, and the seconds since the group's first commit."""
    first = commits.groupBy("group_id").agg(F.min(time).alias("_first"))
    windows = commits.groupBy("group_id", F.window(time, width).alias("w")).agg(F.count("*").alias("n_commits"), F.max("txn_seq").alias("last_txn"), F.max(time).alias("_last"))
    out = windows.join(first, "group_id")
    seconds = F.unix_timestamp(F.col("_last").cast("timestamp")) - F.unix_timestamp(F.col("_first").cast("timestamp"))
    return out.select("group_id", F.col("w.start").alias("window_start"), "n_commits", "last_txn", seconds.alias("elapsed_s"))


def write_report(report: DataFrame, path: str) -> None:
    """A report as CSV files, a folder for each group."""
    report.write.partitionBy("group_id").mode("append").option("header", True).csv(path)


def queries_by_group(queries: DataFrame) -> DataFrame:
    """How many queries of (query_id, groups) touch each group."""
    return queries.select("query_id", F.explode(F.array_distinct("groups")).alias("group_id")).groupBy("group_id").agg(F.count("*").alias("n_queries"))


def describe(events: DataFrame) -> DataFrame:
    """A line of text for each event."""
    text = F.concat_ws(" ", F.format_string("%s:%d", "file", "pos"), F.col("type_name"), F.concat(F.lit("server="), F.col("server_id")), F.concat(F.lit("len="), F.col("event_len")), F.concat_ws(".", "db", "tbl"), F.col("detail"))
    return events.select("file", "pos", text.alias("description"))


def write_lines(metrics: DataFrame, path: str) -> None:
    """The log-file sink: each row as a line of JSON text."""
    metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value")).write.mode("append").text(path)
