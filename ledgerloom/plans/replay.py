"""A replay from log files (or from a change table) to tables that Spark SQL queries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import commit, logical_clock, routing, transactions, versions
from ..sources import binlog
from ..workspace import materialize

MODES = ("grouped", "single_group", "logical_clock")
#: Bytes of a log whose rows are one task's where they are sorted; and the most tasks: with more, Spark's shuffle keeps the rows of the tasks before in memory.
PIECE_BYTES, MAX_PIECES = 16 << 20, 200


@dataclass
class Replay:
    """What a replay yields; all lazy. ``groups`` is the table-to-group dimension."""

    changes: DataFrame
    txns: DataFrame
    groups: DataFrame
    #: What of a log could not be read; None for a change table.
    problems: DataFrame | None = None
    #: Tasks that changes are dealt to where they are sorted; None leaves it to Spark.
    pieces: int | None = None

    def routed(self) -> DataFrame:
        return routing.route(self.changes, self.groups)

    def versions(self) -> DataFrame:
        return versions.versions(self.routed())

    def latest(self) -> DataFrame:
        return versions.live(versions.latest(self.routed(), self.pieces))

    def as_of(self, time) -> DataFrame:  # noqa: ANN001
        return versions.as_of(self.routed(), time)

    def grid(self) -> DataFrame:
        return routing.grid(self.txns, self.groups, self.routed())

    def timeline(self, advance_on_empty: bool = True) -> DataFrame:
        return commit.timeline(self.grid(), self.txns, advance_on_empty)

    def high_water(self, advance_on_empty: bool = True) -> DataFrame:
        return commit.high_water(self.grid(), self.txns, advance_on_empty)

    def save(self, path: str) -> None:
        """The version store as Parquet, a folder for each table."""
        self.versions().write.partitionBy("tbl").mode("overwrite").parquet(path)


def replay_changes(changes: DataFrame, groups: DataFrame, mode: str = "grouped") -> Replay:
    """``changes``: (txn_seq, event_ord, row_ord, tbl, pk, op, event_time, ...).

    grouped: by the given groups; single_group: all tables in group 0; logical_clock: the
    order is the same (sequence numbers), and so is the result; see ``logical_clock`` for
    what could have run together.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode} is none of {MODES}")
    if mode == "single_group":
        groups = groups.select("tbl", F.lit(0).alias("group_id"))
    txns = changes.groupBy("txn_seq").agg(F.max("event_time").alias("event_time"))
    return Replay(changes, txns, groups)


def replay_log(spark: SparkSession, path: str, groups: DataFrame, mode: str = "grouped", split_bytes: int = binlog.SPLIT_BYTES, once: bool = False, **options: str) -> Replay:
    """From log files. Tables are named "db.table"; a table's rows are JSON in ``after`` and ``before``.

    The log is read once and kept as a table in the shared folder: changes, numbered by their transactions, and the transactions' ends.
    Changes behind a file's last end are incomplete and left out; ``problems`` has what could not be read. Rows of a prepared (XA) transaction
    take the place of its commit; they are left out if it was rolled back, or not decided yet. ``once``: of transactions with the same global identity
    (from two copies of a log) only the first is replayed.
    """
    read = binlog.load(spark, path, split_bytes, **(options | {"mode": "replay"}))
    return replay_read(materialize(read.drop("file"), "log-read"), groups, mode, once, pieces_of(spark, path))


def pieces_of(spark: SparkSession, path: str) -> int:
    """How many tasks the rows of a log are dealt to, by its bytes."""
    n_bytes = sum(binlog.size_on_disk(f) for f in binlog.log_files(path))
    return min(max(-(-n_bytes // PIECE_BYTES), spark.sparkContext.defaultParallelism), MAX_PIECES)


def latest_rows(spark: SparkSession, path: str, table: str, schema: str, keys: list[str], split_bytes: int = binlog.SPLIT_BYTES, **options: str) -> DataFrame:
    """The live rows of one table at the end of a log, in typed columns ("name type, ..."), by whole transactions.

    Only these columns are decoded, by the source. An update that changes the key is a delete and an insert. The newest version is an aggregation, combined before the
    shuffle. The read fails at what can't be read, and for a log whose images leave columns out (see ``versions.latest_columns`` for these).
    """
    types = dict(f.strip().split(" ", 1) for f in re.split(r",(?![^(]*\))", schema))
    before = "".join(f", {binlog.BEFORE}{k} {types[k]}" for k in keys)
    meta = ["_op", "_file_ord", "_txn_no", "_pos", "_row_ord", "_partial"]
    rows = binlog.table_rows(spark, path, table, schema + before, split_bytes, meta, complete="true", **options)
    rows = rows.withColumn("_partial", F.when(F.col("_partial") & (F.col("_op") != "D"), F.raise_error(F.lit(f"images of {table} leave columns out"))))
    moved = F.lit(False)
    for k in keys:
        moved |= ~F.col(k).eqNullSafe(F.col(f"{binlog.BEFORE}{k}"))
    order = F.struct("_file_ord", "_txn_no", "_pos", "_row_ord", F.lit(1).alias("_last"))
    value = F.struct((F.col("_op") != "D").alias("live"), "_partial", *[F.col(f"`{c}`") for c in types if c not in keys])
    after = rows.select(*keys, order.alias("_at"), value.alias("_v"))
    # The old key of an update that changes it: gone, right before the new one comes.
    gone = rows.where((F.col("_op") == "U") & moved)
    no_value = value.withField("live", F.lit(False))
    old = gone.select(*[F.col(f"{binlog.BEFORE}{k}").alias(k) for k in keys], order.withField("_last", F.lit(0)).alias("_at"), no_value.alias("_v"))
    newest = after.unionByName(old).groupBy(*keys).agg(F.max_by("_v", "_at").alias("_v")).where("_v.live AND _v._partial IS NULL")
    return newest.select(*[F.col(k) if k in keys else F.col(f"_v.`{k}`").alias(k) for k in types])


def replay_read(read: DataFrame, groups: DataFrame, mode: str = "grouped", once: bool = False, pieces: int | None = None) -> Replay:
    """From a log that the source has read in mode replay. ``pieces``: tasks that its rows are dealt to where they are sorted."""
    ends = read.where(F.col("op") == binlog.END)
    files = ends.groupBy("file_ord").agg(F.max("txn_no").alias("_done"))
    before = Window.orderBy("file_ord").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    # As many rows as the driver has listed files: rows meet them where they are, as a shuffle by file would put a long one into one task.
    files = F.broadcast(files.withColumn("_before", F.coalesce(F.sum("_done").over(before), F.lit(0))))
    seq = (F.col("_before") + F.col("txn_no")).alias("txn_seq")
    rows = read.where(F.col("problem").isNull() & (F.col("op") != binlog.END)).drop("problem").join(files, "file_ord").where(F.col("txn_no") <= F.col("_done"))
    rows = rows.withColumn("txn_seq", seq).withColumn("tbl", F.concat_ws(".", "db", "tbl")).withColumn("event_ord", F.col("pos")).drop("db", "_done", "_before", "txn_no")
    ended = ends.join(files, "file_ord").select(seq, "event_time", "gtid", F.col("pk").alias("xid"), F.col("after").alias("decided"))
    if once:
        first = ended.where("gtid IS NOT NULL").groupBy("gtid").agg(F.min("txn_seq").alias("_first"))
        again = materialize(ended.join(first, "gtid").where("txn_seq > _first").select("txn_seq"), "log-again")
        dealt = (lambda x: x.repartition(pieces, "txn_seq")) if pieces else (lambda x: x)
        ended, rows = (dealt(x).join(dealt(again), "txn_seq", "left_anti") for x in (ended, rows))
    if ended.where("decided = 'prepare'").take(1):
        rows = in_place_of_commit(rows, ended)
    txns = ended.select("txn_seq", "event_time")
    out = replay_changes(rows, groups, mode)
    problems = read.where("problem IS NOT NULL").select("file_ord", "pos", "event_time", "db", "tbl", "txn_no", "problem")
    return Replay(out.changes, txns, out.groups, problems, pieces)


def in_place_of_commit(rows: DataFrame, ended: DataFrame) -> DataFrame:
    """``rows`` with those of prepared transactions at their commits' txn_seq; without a commit they are left out.

    ``ended``: (txn_seq, xid, decided), the ends of all transactions. An identity may be used again: a prepare belongs to the next decision behind it.
    """
    following = F.lead(F.struct("decided", "txn_seq")).over(Window.partitionBy("xid").orderBy("txn_seq"))
    pairs = ended.where("decided IS NOT NULL").withColumn("_next", following).where("decided = 'prepare'")
    pairs = materialize(pairs.select("txn_seq", F.when(F.col("_next.decided") == "commit", F.col("_next.txn_seq")).alias("_committed"), F.lit(True).alias("_prepared")), "log-prepared")
    placed = rows.join(pairs, "txn_seq", "left").where("_prepared IS NULL OR _committed IS NOT NULL")
    return placed.withColumn("txn_seq", F.coalesce("_committed", "txn_seq")).drop("_committed", "_prepared")


def clock_transactions(events: DataFrame) -> DataFrame:
    """(file_ord, last_committed, sequence_number) of a log's GTID events, for ``logical_clock``."""
    gtid = events.where(F.col("event_type").isin(transactions.GTID, transactions.ANONYMOUS_GTID))
    number = lambda k: F.get_json_object("detail", f"$.{k}").cast("bigint").alias(k)
    return gtid.select("file_ord", number("last_committed"), number("sequence_number"))


def clock_metrics(events: DataFrame) -> DataFrame:
    return logical_clock.metrics(clock_transactions(events))


def register_views(replayed: Replay, schemas: dict, time=None, prefix: str = "") -> list[str]:  # noqa: ANN001
    """A temporary view for each table of ``schemas`` ("db.table": (schema, keys)): live rows, newest or as of ``time``."""
    rows = replayed.latest() if time is None else replayed.as_of(time)
    names = []
    for table, (schema, _) in schemas.items():
        name = prefix + table.split(".", 1)[1]
        own = rows.where(F.col("tbl") == table).select(F.from_json("after", schema).alias("row")).select("row.*")
        own.createOrReplaceTempView(name)
        names.append(name)
    return names
