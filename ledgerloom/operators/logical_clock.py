"""The comparison strategy: replay by logical clocks. Transactions have file_ord, last_committed, sequence_number.

T may start once every transaction with sequence_number <= T.last_committed is done.
Numbers restart with each file, so everything is by file; a file is cut into segments of numbers, so one long file is many tasks.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running

#: Sequence numbers of one segment.
SEGMENT = 1 << 16
#: References to earlier segments up to which a segment is summed up; beyond, its transactions are its summary.
MAX_OUTER = 64
_NEVER = -(1 << 40)


def commit_groups(txns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``txns`` with commit_group: the rank of last_committed within the file. Transactions of one group may run together.

    Ranked over the distinct values, so a value that many transactions share is one row.
    """
    values = txns.select("file_ord", "last_committed").distinct()
    ranks = running(values, ["file_ord"], [F.col("last_committed")], F.floor(F.col("last_committed") / segment), {"commit_group": ("count", F.lit(1))})
    return txns.join(ranks, ["file_ord", "last_committed"])


def dependency_levels(txns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``txns`` with level: 1, or one more than the highest level among those it waits for.

    With H(x) the highest level up to number x, a level is 1 + H(last_committed): a recurrence in (max, +). Within a segment it is linear in
    the values of H at the segment's start and at the earlier numbers that its transactions refer to (few: transactions wait for recent ones). So

    1. every segment, by itself, gives for its end and for each number that later segments refer to the longest chains from these values;
    2. the summaries of a file are composed in order, which gives H at all these numbers;
    3. with them every segment is scanned by itself.

    A segment with more than ``MAX_OUTER`` references to earlier ones isn't summed up: step 2 scans its transactions instead.
    """
    own = txns.select("file_ord", "sequence_number", "last_committed", F.floor(F.col("sequence_number") / segment).alias("seg"), F.floor(F.col("last_committed") / segment).alias("home"))
    outer = own.where("home < seg").select("file_ord", F.col("home").alias("seg"), F.col("last_committed").alias("point")).distinct()
    keys = ["file_ord", "seg"]
    marks = "file_ord int, seg long, point long, from_point long, hops long, own_seq long, own_last long"
    # Both sides come from ``txns``: the second one's keys are renamed.
    renamed = lambda df: df.select(F.col("file_ord").alias("of_file"), F.col("seg").alias("of_seg"), *[F.col(c).alias(c) for c in df.columns if c not in keys]).groupBy("of_file", "of_seg")
    summaries = own.groupBy(*keys).cogroup(renamed(outer)).applyInPandas(_summary(segment), marks)
    known = summaries.groupBy("file_ord").applyInPandas(_composed(segment), "file_ord int, point long, value long")
    # What a segment needs: H at its start, and at the earlier numbers that its transactions refer to.
    starts = own.select(*keys, (F.col("seg") * segment - 1).alias("point")).distinct()
    wanted = starts.unionByName(own.where("home < seg").select(*keys, F.col("last_committed").alias("point")).distinct())
    values = wanted.join(known, ["file_ord", "point"])
    levels = own.groupBy(*keys).cogroup(renamed(values)).applyInPandas(_levels(segment), "file_ord int, sequence_number long, level long")
    return txns.join(levels, ["file_ord", "sequence_number"])


def _summary(segment: int):  # noqa: ANN202
    def of(key: tuple, txns: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        file_ord, seg = key
        start = seg * segment - 1
        txns = txns.sort_values("sequence_number")
        seqs, lasts = txns["sequence_number"].to_numpy(np.int64), txns["last_committed"].to_numpy(np.int64)
        outside = [start, *sorted({x for x in lasts.tolist() if x <= start} - {start})]
        wanted = sorted({*points["point"].tolist(), start + segment})
        if len(outside) > MAX_OUTER:
            rows = [(file_ord, seg, p, None, None, None, None) for p in wanted] + [(file_ord, seg, None, None, None, q, x) for q, x in zip(seqs.tolist(), lasts.tolist(), strict=True)]
            return pd.DataFrame(rows, columns=["file_ord", "seg", "point", "from_point", "hops", "own_seq", "own_last"]).astype("Int64")
        place = {x: i for i, x in enumerate(outside)}
        # hops[i] is, up to the i-th transaction, the longest chain from each value outside; the value at the segment's start holds throughout.
        hops = np.full((len(seqs) + 1, len(outside)), _NEVER, np.int64)
        hops[0, 0] = 0
        at = np.minimum(np.searchsorted(seqs, lasts, "right"), np.arange(len(seqs)))
        for i, (last, before) in enumerate(zip(lasts.tolist(), at.tolist(), strict=True)):
            hops[i + 1] = hops[i]
            if last <= start:
                k = place[last]
                hops[i + 1, k] = max(hops[i + 1, k], 1)
            else:
                np.maximum(hops[i + 1], hops[before] + 1, out=hops[i + 1])
        rows = []
        for p in wanted:
            found = hops[np.searchsorted(seqs, p, "right")]
            rows += [(file_ord, seg, p, outside[k], int(found[k]), None, None) for k in np.flatnonzero(found >= 0).tolist()]
        return pd.DataFrame(rows, columns=["file_ord", "seg", "point", "from_point", "hops", "own_seq", "own_last"]).astype("Int64")

    return of


def _composed(segment: int):  # noqa: ANN202
    def of(key: tuple, marks: pd.DataFrame) -> pd.DataFrame:
        values: dict[int, int] = {}
        last = 0
        for seg, own in marks.sort_values(["seg", "point", "own_seq"]).groupby("seg", sort=True):
            start, found = seg * segment - 1, {}
            values[start] = last
            height = lambda x: values.get(x, 0) if x != start else last  # noqa: B023, E731
            scanned = own[own["own_seq"].notna()]
            if len(scanned):
                seqs, highest = [], []
                for q, x in zip(scanned["own_seq"].astype("int64").tolist(), scanned["own_last"].astype("int64").tolist(), strict=True):
                    if x <= start:
                        level = 1 + height(x)
                    else:
                        k = bisect_right(seqs, x)
                        level = 1 + (highest[k - 1] if k else last)
                    seqs.append(q)
                    highest.append(max(level, highest[-1] if highest else last))
                for p in own.loc[own["point"].notna(), "point"].astype("int64").tolist():
                    k = bisect_right(seqs, p)
                    found[p] = highest[k - 1] if k else last
            else:
                for p, x, n in zip(*(own[c].astype("int64").tolist() for c in ("point", "from_point", "hops")), strict=True):
                    found[p] = max(found.get(p, 0), height(x) + n)
            values |= found
            last = found[start + segment]
        return pd.DataFrame([(key[0], p, v) for p, v in values.items()], columns=["file_ord", "point", "value"])

    return of


def _levels(segment: int):  # noqa: ANN202
    def of(key: tuple, txns: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        start = key[1] * segment - 1
        height = dict(zip(values["point"].tolist(), values["value"].tolist(), strict=True))
        txns = txns.sort_values("sequence_number")
        seqs, lasts = txns["sequence_number"].to_numpy(np.int64), txns["last_committed"].to_numpy(np.int64)
        out, highest, base = [], [], height.get(start, 0)
        for last, before in zip(lasts.tolist(), np.minimum(np.searchsorted(seqs, lasts, "right"), np.arange(len(seqs))).tolist(), strict=True):
            # A number before the file's first is waited for by nobody.
            level = 1 + (height.get(last, 0) if last <= start else highest[before - 1] if before else base)
            out.append(level)
            highest.append(max(level, highest[-1] if highest else base))
        return pd.DataFrame({"file_ord": key[0], "sequence_number": seqs, "level": out})

    return of


def blocked(txns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``txns`` with is_blocked: whether the transaction right before it has to be done first."""
    number = F.col("sequence_number")
    before = running(txns, ["file_ord"], [number], F.floor(number / segment), {"_before": ("max", number)}, exclusive=True)
    return before.withColumn("is_blocked", F.coalesce(F.col("_before") <= F.col("last_committed"), F.lit(False))).drop("_before")


def metrics(txns: DataFrame) -> DataFrame:
    """By file: transactions, commit groups, blocked ones, and the longest chain of waits."""
    both = blocked(dependency_levels(txns))
    return both.groupBy("file_ord").agg(F.count("*").alias("n_txns"), F.countDistinct("last_committed").alias("n_groups"), F.count_if("is_blocked").alias("n_blocked"), F.max("level").alias("longest_chain"))


def lag_of(txns: DataFrame, ahead: int = 50_000) -> DataFrame:
    """``txns`` (txn_seq, finish_us) with lag_us: the time until ``ahead`` further transactions have finished (null at the end)."""
    later = txns.select((F.col("txn_seq") - ahead).alias("txn_seq"), F.col("finish_us").alias("_later"))
    return txns.join(later, "txn_seq", "left").withColumn("lag_us", F.col("_later") - F.col("finish_us")).drop("_later")
