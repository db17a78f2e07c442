"""Workload traces as DataFrames: query arrivals with their tables, and SQL statements with their times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prefix import following


def parse_arrivals(lines: DataFrame) -> DataFrame:
    """(arrival, tables) from lines ``time,t1,t2,...`` in column value; a trailing comma is optional."""
    parts = F.split("value", ",")
    tables = F.filter(F.transform(F.filter(parts, lambda t, i: i > 0), lambda t: F.trim(t)), lambda t: t != "")
    return lines.where(F.trim("value") != "").select(F.trim(F.get(parts, F.lit(0))).try_cast("bigint").alias("arrival"), tables.alias("tables"))


def parse_sql_lines(lines: DataFrame) -> DataFrame:
    """(query_time, sql) from lines ``YYYY-M-D h:m:s,SQL``; commas in the SQL stay."""
    parts = F.split("value", ",", 2)
    return lines.where(F.trim("value") != "").select(F.try_to_timestamp(F.get(parts, F.lit(0)), F.lit("y-M-d H:m:s")).alias("query_time"), F.get(parts, F.lit(1)).alias("sql"))


def read_arrivals(spark: SparkSession, path: str) -> DataFrame:
    return parse_arrivals(spark.read.text(path))


def read_sql_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_sql_lines(spark.read.text(path))


def merge_by_time(lines: DataFrame) -> DataFrame:
    """(arrival, tables) from (tbl, arrival) rows, one trace for each table: tables of one time are one query."""
    return lines.groupBy("arrival").agg(F.sort_array(F.collect_set("tbl")).alias("tables"))


def read_trace_folder(spark: SparkSession, path: str) -> DataFrame:
    """A folder with a file of times for each table, merged by time; the file's name is the table's."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return merge_by_time(spark.read.text(path).select(name.alias("tbl"), F.trim("value").try_cast("bigint").alias("arrival")).where("arrival IS NOT NULL"))


def gaps(arrivals: DataFrame, scale: int = 1000, segment: int = 1 << 20) -> DataFrame:
    """``arrivals`` with the time since the one before, times ``scale``, by segments of that many time units; null for the first."""
    # Counted from the end backwards, the row that follows is the one before.
    back = arrivals.withColumn("_trace", F.lit(0)).withColumn("_back", -F.col("arrival"))
    before = following(back, ["_trace"], [F.col("_back")], F.floor(F.col("_back") / segment), {"_before": F.col("arrival")})
    return before.withColumn("gap", (F.col("arrival") - F.col("_before")) * scale).drop("_trace", "_back", "_before")
