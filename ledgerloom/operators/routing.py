"""From row events to table groups: table maps as of an event, allow-lists, groups, and the transaction by group grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .transactions import SEGMENT_BYTES

TABLE_MAP = 19
#: Tables that a configuration may list: the dimension is made on the driver, and broadcast. A shuffle by table would put a log of one table into one task.
MAX_CONFIGURED_TABLES = 100_000


def table_groups(spark: SparkSession, groups: list[list[str]]) -> DataFrame:
    """(tbl, group_id) from configuration: group ids are positions from 0. A table in two groups is an error."""
    rows = [(t, i) for i, tables in enumerate(groups) for t in tables]
    if len(rows) > MAX_CONFIGURED_TABLES:
        raise ValueError("too many configured tables")
    if len({t for t, _ in rows}) < len(rows):
        raise ValueError("a table is in two groups")
    return spark.createDataFrame(rows, "tbl string, group_id int")


def resolve_table_maps(events: DataFrame) -> DataFrame:
    """Row events (event_type, table_id) with the map of their table id as of their position: map_db, map_tbl.

    The newest map at or before the event, within the file: an id that is mapped anew is
    followed. Maps are carried over segments of the file like any running value.
    """
    segment = F.floor(F.col("pos") / SEGMENT_BYTES)
    events = events.withColumn("_map", F.when(F.col("event_type") == TABLE_MAP, F.struct("pos", "db", "tbl")))
    from .prefix import running

    out = running(events, ["file_ord", "table_id"], [F.col("pos")], segment, {"_newest": ("max", F.col("_map"))})
    return out.withColumn("map_db", F.col("_newest.db")).withColumn("map_tbl", F.col("_newest.tbl")).drop("_map", "_newest")


def with_schema(changes: DataFrame, catalog: DataFrame) -> DataFrame:
    """``changes`` with the columns of ``catalog`` (db, tbl, ...): an equi-join; tables that aren't listed go."""
    return changes.join(catalog, ["db", "tbl"])


def allow(changes: DataFrame, tables: list[str]) -> DataFrame:
    return changes.where(F.col("tbl").isin(tables))


def route(changes: DataFrame, groups: DataFrame) -> DataFrame:
    """``changes`` of configured tables with their group_id; others are dropped (see ``unrouted``)."""
    return changes.join(F.broadcast(groups), "tbl")


def unrouted(changes: DataFrame, groups: DataFrame) -> DataFrame:
    return changes.join(F.broadcast(groups), "tbl", "left_anti")


def groups_of_query(queries: DataFrame, groups: DataFrame) -> DataFrame:
    """``queries`` (query_id, tables) with the distinct group ids of their tables; a table in no group is an error row: -1."""
    tables = queries.select("query_id", F.explode("tables").alias("tbl"))
    return tables.join(groups, "tbl", "left").groupBy("query_id").agg(F.sort_array(F.collect_set(F.coalesce("group_id", F.lit(-1)))).alias("groups"))


def grid(txns: DataFrame, groups: DataFrame, routed: DataFrame) -> DataFrame:
    """(txn_seq, group_id, n_rows) for every transaction and group, with 0 where a transaction didn't touch a group.

    The list of groups is a literal array (configuration), so each transaction expands in
    place; there is no join of the two. Rows are counted before they are shuffled.
    """
    ids = sorted(r[0] for r in groups.select("group_id").distinct().collect())
    cells = txns.select("txn_seq").distinct().withColumn("group_id", F.explode(F.array(*[F.lit(i) for i in ids])))
    counts = routed.groupBy("txn_seq", "group_id").agg(F.count("*").alias("n_rows"))
    return cells.join(counts, ["txn_seq", "group_id"], "left").fillna(0, ["n_rows"])


def two_way_split(changes: DataFrame, table: str) -> DataFrame:
    """The earlier two-group rule: one named table against all others."""
    return changes.withColumn("group_id", F.when(F.col("tbl") == table, 0).otherwise(1))


def in_event_order(col: str = "txn_seq") -> list[Column]:
    return [F.col(col), F.col("event_ord"), F.col("row_ord")]


def numbered(changes: DataFrame) -> DataFrame:
    """``changes`` of transactions with event_ord, their order within the transaction."""
    return changes.withColumn("event_ord", (F.row_number().over(Window.partitionBy("txn_seq").orderBy("pos", "row_ord")) - 1).cast("int"))
