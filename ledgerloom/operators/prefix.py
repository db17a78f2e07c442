"""Running aggregates and neighbours over long sequences, without one task per sequence.

A sequence is cut into segments by a given expression that grows along the order. Each
segment is handled by an ordinary window; one row per segment carries what earlier (or
later) segments contribute. So a single log of any length, or a key that holds a third of
all rows, is as many tasks as it has segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
_FIRST = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def _join_keys(keys: list[str], left: str, right: str) -> Column:
    cond = F.col(f"{left}._segment").eqNullSafe(F.col(f"{right}._segment"))
    for k in keys:
        cond &= F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def along(df: DataFrame, keys: list[str], order: list[Column], segment: Column, before: dict[str, tuple[str, Column]], after: dict[str, Column], exclusive: bool = False) -> DataFrame:
    """``df`` with running aggregates and with values of the next row, in one pass over the segments.

    ``before``: {name: (sum | count | max | min, expression)}, inclusive of the row itself, or ``exclusive``;
    sums and counts begin at 0, max and min at null. ``after``: {name: expression}, null for the last row;
    with it, ``order`` has ascending columns only.
    """
    names = df.columns
    rows = cut = df.withColumn("_segment", segment)
    ordered = Window.partitionBy(*keys, "_segment").orderBy(*order)
    local = ordered.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    for name, (how, expr) in before.items():
        rows = rows.withColumn(f"_own_{name}", _FIRST[how](expr).over(local))
    for name, expr in after.items():
        rows = rows.withColumn(f"_own_{name}", F.lead(expr).over(ordered))
    totals = [_FIRST[how](expr).alias(f"_seg_{name}") for name, (how, expr) in before.items()]
    chain = Window.partitionBy(*keys).orderBy("_segment")
    earlier = chain.rowsBetween(Window.unboundedPreceding, -1)
    carry = [_MERGE[how](f"_seg_{name}").over(earlier).alias(f"_carry_{name}") for name, (how, _) in before.items()]
    if after:
        rows = rows.withColumn("_last", F.lead(F.lit(1)).over(ordered).isNull())
        totals.append(F.min_by(F.struct(*[e.alias(n) for n, e in after.items()]), F.struct(*order)).alias("_first"))
        carry.append(F.lead("_first").over(chain).alias("_next"))
    carried = cut.groupBy(*keys, "_segment").agg(*totals).select(*keys, "_segment", *carry)
    joined = rows.alias("l").join(carried.alias("r"), _join_keys(keys, "l", "r"))
    out = []
    for name, (how, _) in before.items():
        own, carried_value = F.col(f"l._own_{name}"), F.col(f"r._carry_{name}")
        if how in ("sum", "count"):
            value = F.coalesce(own, F.lit(0)) + F.coalesce(carried_value, F.lit(0))
        else:
            value = (F.greatest if how == "max" else F.least)(own, carried_value)
        out.append(value.alias(name))
    out += [F.when(F.col("l._last"), F.col(f"r._next.{n}")).otherwise(F.col(f"l._own_{n}")).alias(n) for n in after]
    return joined.select(*[F.col(f"l.{c}") for c in names], *out)


def running(df: DataFrame, keys: list[str], order: list[Column], segment: Column, outputs: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """Running aggregates alone."""
    return along(df, keys, order, segment, outputs, {}, exclusive)


def following(df: DataFrame, keys: list[str], order: list[Column], segment: Column, outputs: dict[str, Column]) -> DataFrame:
    """Values of the next row alone."""
    return along(df, keys, order, segment, {}, outputs)
