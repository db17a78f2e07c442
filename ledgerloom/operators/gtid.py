"""Sets of global transaction identities: intervals of numbers by server, as aggregations.

A set is rows (sid, first, last), last included. Intervals are found in segments of numbers, each an ordinary window, and those that
touch at a segment's border are put together afterwards, so one server with all transactions is as many tasks as its numbers have segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numbers of one segment.
SEGMENT = 1 << 20


def split(gtids: DataFrame, column: str = "gtid") -> DataFrame:
    """(sid, gno) of identities written "server:number"; rows without one are left out."""
    part = lambda i: F.get(F.split(column, ":"), F.lit(i))
    return gtids.where(F.col(column).isNotNull()).select(part(0).alias("sid"), part(1).cast("long").alias("gno"))


def intervals(numbers: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The set of (sid, gno) rows, in any order and any number of times."""
    own = numbers.select("sid", "gno").distinct().withColumn("_segment", F.floor(F.col("gno") / segment))
    rank = F.row_number().over(Window.partitionBy("sid", "_segment").orderBy("gno"))
    islands = own.withColumn("_island", F.col("gno") - rank).groupBy("sid", "_segment", "_island")
    return union(islands.agg(F.min("gno").alias("first"), F.max("gno").alias("last")).select("sid", "first", "last"))


def union(sets: DataFrame) -> DataFrame:
    """The set of rows (sid, first, last) that may overlap or touch: a row for each interval, as few as there are."""
    before = Window.partitionBy("sid").orderBy("first", "last")
    reach = F.max("last").over(before.rowsBetween(Window.unboundedPreceding, -1))
    begins = sets.withColumn("_new", (reach.isNull() | (F.col("first") > reach + 1)).cast("int"))
    numbered = begins.withColumn("_n", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("sid", "_n").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_n")


def _depths(*sets: DataFrame) -> DataFrame:
    """(sid, first, last, in0, in1): pieces between the places where any of two sets begins or ends, and in which of them they are."""
    ends = None
    for i, s in enumerate(sets):
        for at, step in ((F.col("first"), 1), (F.col("last") + 1, -1)):
            own = union(s).select("sid", at.alias("at"), *[F.lit(step if k == i else 0).alias(f"step{k}") for k in range(2)])
            ends = own if ends is None else ends.unionByName(own)
    ends = ends.groupBy("sid", "at").agg(F.sum("step0").alias("step0"), F.sum("step1").alias("step1"))
    by = Window.partitionBy("sid").orderBy("at")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    pieces = ends.select("sid", F.col("at").alias("first"), (F.lead("at").over(by) - 1).alias("last"), *[(F.sum(f"step{k}").over(so_far) > 0).alias(f"in{k}") for k in range(2)])
    return pieces.where("last IS NOT NULL")


def difference(one: DataFrame, other: DataFrame) -> DataFrame:
    """What is in ``one`` and not in ``other``: the transactions that a copy lacks."""
    return union(_depths(one, other).where("in0 AND NOT in1").select("sid", "first", "last"))


def intersection(one: DataFrame, other: DataFrame) -> DataFrame:
    return union(_depths(one, other).where("in0 AND in1").select("sid", "first", "last"))


def gaps(sets: DataFrame) -> DataFrame:
    """The intervals between a server's first and last number that a set lacks."""
    last = F.lag("last").over(Window.partitionBy("sid").orderBy("first"))
    return union(sets).select("sid", (last + 1).alias("first"), (F.col("first") - 1).alias("last")).where("first IS NOT NULL")


def size(sets: DataFrame) -> DataFrame:
    """(sid, n): how many transactions of each server are in a set."""
    return union(sets).groupBy("sid").agg(F.sum(F.col("last") - F.col("first") + 1).alias("n"))


def previous(events: DataFrame) -> DataFrame:
    """The sets that log files begin with: (file_ord, sid, first, last) from events of the source."""
    sets = F.from_json(F.get_json_object("detail", "$.gtid_sets"), "map<string, array<array<bigint>>>")
    found = events.where("event_type = 35 AND NOT corrupt").select("file_ord", F.explode(sets).alias("sid", "held"))
    return found.select("file_ord", "sid", F.explode("held").alias("i")).select("file_ord", "sid", F.col("i")[0].alias("first"), F.col("i")[1].alias("last"))
