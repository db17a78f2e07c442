"""Queries over rows that only larger tables have, against their SQL."""

from __future__ import annotations

import datetime as dt
import itertools
import random
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from ledgerloom import queries as core
from ledgerloom.operators import routing, versions
from ledgerloom.plans import replay
from ledgerloom.sources import binlog
from ledgerloom.sources.binlog_writer import LogWriter, column_for
from ledgerloom.streaming import commits

T0 = dt.datetime(2024, 1, 1)


def _text(v: object) -> str:
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


def _holds(spark, folder, name: str, **tables) -> None:  # noqa: ANN001, ANN003
    """``tables``: DataFrames; the query's rows over them are those of its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = core.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted(tuple(_text(r[c]) for c in columns) for r in df.collect())
    relation = con.execute(core.ORACLE_SQL[name])
    there = [d[0] for d in relation.description]
    assert sorted(there) == columns
    assert got == sorted(tuple(_text(r[there.index(c)]) for c in columns) for r in relation.fetchall())


def test_integers_beyond_three_bytes(spark, tmp_path) -> None:  # noqa: ANN001
    keys = [k + i for k in (0, 1 << 23, 1 << 24, 3 << 23, 25_600_000, 25_600_256, 54_000_000, 1 << 40) for i in range(-3, 4) if k + i >= 0]
    _holds(spark, tmp_path, "decode_integers", orders=spark.createDataFrame([(k,) for k in keys], "o_orderkey long"))


def test_times_of_midnight_keep_their_sign(spark, tmp_path) -> None:  # noqa: ANN001
    rows = [(i, T0 + dt.timedelta(days=i, microseconds=636583, seconds=i % 3)) for i in range(60)]
    _holds(spark, tmp_path, "decode_temporal", events=spark.createDataFrame(rows, "event_id long, ts timestamp_ntz"))


def test_every_batch_reaches_the_store(spark, tmp_path) -> None:  # noqa: ANN001
    i = F.col("event_id")
    types = F.element_at(F.array(*map(F.lit, ("view", "error", "signup", "click"))), (F.pmod(F.hash(i), F.lit(4)) + 1).cast("int"))
    events = spark.range(0, 24_000, 16).withColumnRenamed("id", "event_id").select("event_id", F.pmod(F.hash(i * 7), F.lit(600)).cast("long").alias("user_id"), F.lit(T0).cast("timestamp_ntz").alias("ts"), types.alias("event_type"), (i * 0.5).alias("value"), F.lit("{}").alias("props"))
    _holds(spark, tmp_path, "version_store_batches", events=events)


def test_a_log_of_one_table_is_not_one_task(spark, tmp_path) -> None:  # noqa: ANN001
    """Neither its table nor its file deals the rows; the newest versions are those without dealing, also of a key with half of all rows."""
    binlog.register(spark)
    i = F.col("id")
    rows = spark.range(0, 2000, 1, 2).select(F.when(i % 2 == 0, 0).otherwise(i % 37).alias("k"), i.alias("v"), F.lit("x").alias("text"))
    rows.write.format("binlog").options(db="shop", table="t", primaryKey="k", batch="3", gtids="true").mode("append").save(str(tmp_path / "log"))
    for path, once in ((f"{tmp_path}/log", False), (f"{tmp_path}/log,{tmp_path}/log", True)):
        r = replay.replay_log(spark, path, routing.table_groups(spark, [["shop.t"]]), once=once)
        assert r.pieces and r.routed().count() == 2000
        plan = r.routed()._jdf.queryExecution().sparkPlan().toString()
        assert not re.search(r"SortMergeJoin \[(tbl|file_ord)#", plan) and "BroadcastHashJoin" in plan
        got = sorted(map(tuple, r.latest().select("pk", "after").collect()))
        assert got == sorted(map(tuple, versions.live(versions.latest(r.routed())).select("pk", "after").collect())) and len(got) == 37


class _Handle:
    """State as Spark keeps it; ``calls`` counts what is read or written."""

    def __init__(self) -> None:
        self.values, self.calls = {}, 0

    def getValueState(self, name, *schemas):  # noqa: ANN001, ANN201, N802
        return _State(self, name)

    getMapState = getValueState  # noqa: N815


class _State:
    def __init__(self, handle, name) -> None:  # noqa: ANN001
        self.handle, self.name = handle, name

    def _at(self, key=()):  # noqa: ANN001, ANN202
        self.handle.calls += 1
        return self.name, key

    def containsKey(self, key=()):  # noqa: ANN001, ANN201, N802
        return self._at(key) in self.handle.values

    def getValue(self, key=()):  # noqa: ANN001, ANN201, N802
        return self.handle.values[self._at(key)]

    def updateValue(self, key, value):  # noqa: ANN001, ANN201, N802
        self.handle.values[self._at(key)] = value

    def removeKey(self, key):  # noqa: ANN001, ANN201, N802
        del self.handle.values[self._at(key)]

    def update(self, value):  # noqa: ANN001, ANN201
        self.updateValue((), value)

    exists, get = containsKey, getValue


def test_waiting_transactions_are_kept_together(monkeypatch) -> None:  # noqa: ANN001
    """Any order and repetition of cells gives the commits of plain Python, in far fewer calls of the state than there are cells."""
    for seed in range(6):
        rnd = random.Random(seed)
        n = rnd.choice([1, 3000, 20_000])
        monkeypatch.setattr(commits, "BUFFER_ROWS", rnd.choice([50, 1000, 1 << 20]) if n < 20_000 else 1 << 20)
        cells = [(s, rnd.randrange(10**6)) for s in range(1, n + 1)] + [(rnd.randrange(1, n + 1), 5) for _ in range(n // 3)]
        rnd.shuffle(cells)
        handle, got, first = _Handle(), [], {}
        p = commits.InOrder(1)
        p.init(handle)
        for at in range(0, len(cells), -(-len(cells) // 4)):
            batch = pd.DataFrame(cells[at : at + -(-len(cells) // 4)], columns=["txn_seq", "event_us"])
            for out in p.handleInputRows((7,), iter([batch[:100], batch[100:]]), None):
                got += out.itertuples(index=False, name=None)
        for s, us in cells:
            first.setdefault(s, us)
        assert [(g, s) for g, s, _ in got] == [(7, s) for s in range(1, n + 1)]
        assert [c for _, _, c in got] == list(itertools.accumulate((first[s] for s in range(1, n + 1)), max))
        assert n < 20_000 or handle.calls < 500


def test_short_splits_read_little(tmp_path, monkeypatch) -> None:  # noqa: ANN001
    """What is read for splits follows the file's length, not the number of splits times a long buffer; many splits are few partitions with the same rows."""
    file, big = tmp_path / "log.1", column_for("bigint")
    with file.open("wb") as f:
        log = LogWriter(f)
        for n in range(1, 12_001):
            log.transaction(0, n - 1, n, [("d", "t", ["id", "x"], [big, big], [0], [("I", None, [n, None if n % 3 == 0 else -n])])])
    size, seen = file.stat().st_size, [0]
    real = binlog._next_header
    monkeypatch.setattr(binlog, "_next_header", lambda data, pos: seen.__setitem__(0, seen[0] + len(data)) or real(data, pos))
    options = {"path": str(tmp_path), "mode": "splits", "splitBytes": str(1 << 14)}

    def splits(most: int) -> list[dict]:
        monkeypatch.setattr(binlog, "MAX_PARTITIONS", most)
        reader = binlog.BinlogReader(options)
        assert len(reader.partitions()) <= most
        return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]

    found = splits(1 << 20)
    assert len(found) > 100 and seen[0] < 4 * size
    assert splits(7) == found and sum(r["n_ends"] for r in found) == 12_000
    first = list(itertools.accumulate((r["n_ends"] for r in found), initial=1))
    cut = binlog.BinlogReader({"path": str(tmp_path), "mode": "changes", "splits": binlog._packed([(r["file"], 0, r["start"], r["stop"], n) for r, n in zip(found, first, strict=False) if r["start"] < r["stop"]])})
    assert len(cut.partitions()) <= 7
    got = [(r["txn_no"], r["after"]) for p in cut.partitions() for b in cut.read(p) for r in b.to_pylist()]
    assert got == [(n, f'{{"id": {n}, "x": {"null" if n % 3 == 0 else -n}}}') for n in range(1, 12_001)]
