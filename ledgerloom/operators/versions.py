"""Row versions: every change of a key, newest state, states as of a time.

Changes have tbl, pk, op (I, U or D), event_time, txn_seq, event_ord, row_ord and any
columns of the row. Their order is (txn_seq, event_ord, row_ord), never time alone. Deletes
are tombstones: versions with ``is_deleted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import along, running

KEYS = ["tbl", "pk"]
#: Transactions of one segment of a key's chain.
SEGMENT_TXNS = 1 << 20
#: Transactions whose changes of a key meet in one task, where ``latest`` is given a number of pieces.
PIECE_TXNS = 1 << 16


def order() -> list[Column]:
    return [F.col("txn_seq"), F.col("event_ord"), F.col("row_ord")]


def versions(changes: DataFrame, segment_txns: int = SEGMENT_TXNS) -> DataFrame:
    """``changes`` with version_no (1 is the oldest), valid_from, valid_to (null: newest) and is_deleted."""
    segment = F.floor(F.col("txn_seq") / segment_txns)
    out = along(changes, KEYS, order(), segment, {"version_no": ("count", F.lit(1))}, {"valid_to": F.col("event_time")})
    return out.withColumn("valid_from", F.col("event_time")).withColumn("is_deleted", F.col("op") == "D")


def latest(changes: DataFrame, pieces: int | None = None) -> DataFrame:
    """The newest version of each key, tombstones included: one aggregation, combined before the shuffle.

    Rows with texts are sorted before they are combined, so a task's memory follows its rows. ``pieces``: changes are dealt to so many tasks first, by key
    and by ``PIECE_TXNS`` transactions, so that a task has its share of them whatever the sizes of files and shuffles, and a key with a third of all rows is many tasks'.
    """
    if not pieces:
        return _newest(changes, KEYS)
    dealt = changes.withColumn("_piece", F.floor(F.col("txn_seq") / PIECE_TXNS)).repartition(pieces, *KEYS, "_piece")
    return _newest(_newest(dealt, [*KEYS, "_piece"]).drop("_piece").repartition(pieces, *KEYS), KEYS)


def _newest(changes: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in changes.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order())).alias("v"))
    return newest.select(*keys, "v.*")


def latest_columns(changes: DataFrame, columns: list[str], image: str = "after") -> DataFrame:
    """The newest state of each key, as (tbl, pk, op, txn_seq, event_time, columns...), where images (JSON) may leave columns out.

    A column has its newest value among the images since the key's newest insert that have the column, be it null; values are text.
    One aggregation finds the newest insert and version, a second one each column's value.
    """
    newest_insert = changes.where(F.col("op") == "I").groupBy(*KEYS).agg(F.max(F.struct(*order())).alias("_since"))
    rows = changes.join(newest_insert, KEYS, "left").where(F.col("_since").isNull() | (F.struct(*order()) >= F.col("_since")))
    has = lambda c: F.array_contains(F.json_object_keys(image), F.lit(c))
    newest = [F.max_by(F.struct("op", "txn_seq", "event_time"), F.struct(*order())).alias("_newest")]
    # A struct around the value: max_by takes a null value as it takes any other.
    held = [F.max_by(F.struct(F.get_json_object(image, f"$.{c}").alias("v")), F.when(has(c), F.struct(*order()))).alias(f"_{i}") for i, c in enumerate(columns)]
    out = rows.groupBy(*KEYS).agg(*newest, *held)
    return out.select(*KEYS, "_newest.*", *[F.col(f"_{i}.v").alias(c) for i, c in enumerate(columns)])


def live(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("op") != "D")


def as_of(changes: DataFrame, time: Column, keep_deleted: bool = False) -> DataFrame:
    """The newest version of each key at or before ``time``; keys whose newest is a delete are absent unless kept."""
    rows = latest(changes.where(F.col("event_time") <= time))
    return rows if keep_deleted else live(rows)


def point_as_of(changes: DataFrame, tbl: str, pk: Column, time: Column) -> DataFrame:
    """The version of one key as of a time, or no row; the filters reach the scan."""
    return as_of(changes.where((F.col("tbl") == tbl) & (F.col("pk") == pk)), time)


def as_of_join(probes: DataFrame, changes: DataFrame, columns: list[str], time: str = "at", segment_days: int = 365) -> DataFrame:
    """``probes`` (tbl, pk, a time, any other columns) with version: the key's newest version at or before each probe's time.

    version is a struct of txn_seq, event_ord, row_ord, op, event_time and ``columns``; null where the key has none yet, or was deleted. Probes and
    changes are merged into one sequence by key and time, which is cut into segments of days; each segment is scanned by itself with the
    newest version before it carried over. So any number of probes costs one pass, and a key that holds a third of all rows is as many tasks as it has segments.
    """
    at, others = "_at", [c for c in probes.columns if c not in KEYS]
    version = F.struct("txn_seq", "event_ord", "row_ord", "op", "event_time", *columns)
    none = F.lit(None)
    asked = F.struct(*[F.col(f"`{c}`") for c in others])
    one = changes.select(*KEYS, F.col("event_time").alias(at), version.alias("_version"), none.cast(probes.select(asked.alias("p")).schema["p"].dataType).alias("_probe"))
    other = probes.select(*KEYS, F.col(time).alias(at), none.cast(one.schema["_version"].dataType).alias("_version"), asked.alias("_probe"))
    segment = F.floor(F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")) / segment_days)
    scanned = running(one.unionByName(other), KEYS, [F.col(at), F.col("_probe").isNotNull()], segment, {"_newest": ("max", F.col("_version"))})
    newest = F.when(F.col("_newest.op") != "D", F.col("_newest")).alias("version")
    return scanned.where("_probe IS NOT NULL").select(*[F.col(c) if c in KEYS else F.col(f"_probe.`{c}`") for c in probes.columns], newest)


def collapse_same_time(changes: DataFrame) -> DataFrame:
    """Of the versions of a key with one event_time, the newest only."""
    keys = [*KEYS, "event_time"]
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order())).alias("v")).select(*keys, "v.*")


def upsert(state: DataFrame, changes: DataFrame) -> DataFrame:
    """A new state from an older one (same columns as ``changes``) and further changes."""
    return latest(state.unionByName(changes))
