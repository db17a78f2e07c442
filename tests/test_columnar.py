"""Typed columns of a log's rows against the row-by-row codec."""

from __future__ import annotations

import datetime as dt
import decimal
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import codec, columnar
from ledgerloom.functions.codec import TYPE_CODES, Column, TableMap
from ledgerloom.plans import replay
from ledgerloom.sources import binlog
from ledgerloom.sources.binlog_writer import LogWriter, image

TEXT = st.text(max_size=12)
DATES = st.dates(dt.date(1, 1, 1), dt.date(9999, 12, 31))
MOMENTS = st.datetimes(dt.datetime(1000, 1, 1), dt.datetime(9999, 12, 31))
KINDS = [
    (Column(TYPE_CODES["tinyint"]), st.integers(-128, 127)),
    (Column(TYPE_CODES["smallint"], unsigned=True), st.integers(0, 65535)),
    (Column(TYPE_CODES["mediumint"]), st.integers(-(2**23), 2**23 - 1)),
    (Column(TYPE_CODES["int"]), st.integers(-(2**31), 2**31 - 1)),
    (Column(TYPE_CODES["bigint"]), st.integers(-(2**63), 2**63 - 1)),
    (Column(TYPE_CODES["bigint"], unsigned=True), st.integers(0, 2**64 - 1)),
    (Column(TYPE_CODES["double"]), st.floats(allow_nan=False)),
    (Column(TYPE_CODES["float"]), st.floats(width=32, allow_nan=False)),
    (Column(TYPE_CODES["decimal"], 15 << 8 | 2), st.decimals(-(10**12), 10**12, places=2)),
    (Column(TYPE_CODES["decimal"], 18 << 8 | 0), st.decimals(-(10**17), 10**17, places=0)),
    (Column(TYPE_CODES["decimal"], 30 << 8 | 9), st.decimals(-(10**20), 10**20, places=9)),
    (Column(TYPE_CODES["date"]), DATES),
    (Column(TYPE_CODES["datetime"], 6), MOMENTS),
    (Column(TYPE_CODES["datetime"], 0), MOMENTS.map(lambda t: t.replace(microsecond=0))),
    (Column(TYPE_CODES["timestamp"], 3), st.datetimes(dt.datetime(1970, 1, 2), dt.datetime(2037, 1, 1)).map(lambda t: t.replace(microsecond=t.microsecond // 1000 * 1000))),
    (Column(TYPE_CODES["year"]), st.integers(1901, 2155)),
    (Column(TYPE_CODES["varchar"], 40), TEXT),
    (Column(TYPE_CODES["varchar"], 4000), TEXT),
    (Column(TYPE_CODES["blob"], 3), TEXT),
    (Column(TYPE_CODES["blob"], 4, binary=True), st.binary(max_size=12)),
    (Column(TYPE_CODES["time_old"]), st.timedeltas(dt.timedelta(hours=-800), dt.timedelta(hours=800)).map(lambda t: dt.timedelta(seconds=int(t.total_seconds())))),
    (Column(TYPE_CODES["enum"], 1, labels=["a", "b"]), st.integers(1, 2)),
    (Column(TYPE_CODES["set"], 1, labels=["x", "y"]), st.integers(0, 3)),
]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_columns_equal_the_codec(data) -> None:  # noqa: ANN001
    kinds = data.draw(st.lists(st.sampled_from(KINDS), min_size=1, max_size=10))
    columns = [c for c, _ in kinds]
    rows = data.draw(st.lists(st.tuples(*[st.none() | v for _, v in kinds]), max_size=12))
    present = data.draw(st.lists(st.booleans(), min_size=len(columns), max_size=len(columns)).filter(any))
    table = TableMap(1, "d", "t", columns)
    found = columnar.Images(table)
    want = []
    for own in (rows[:5], rows[5:]):  # of two events
        body = b"".join(image(list(r), columns, present) for r in own)
        base, at, cursor = found.begin(body), 0, codec.Cursor(body)
        while at < len(body):
            at = found.pass_over(body, at, base, bytes(present), (sum(present) + 7) // 8, True)
        while cursor.left():
            want.append(codec.read_image(cursor, table, present))
    raw = np.frombuffer(b"".join(found.data), np.uint8)
    for i in range(len(columns)):
        got = found.column(i, raw)
        assert got.type == columnar.arrow_type(columns[i])
        assert got.to_pylist() == [w[i] for w in want], (columns[i], i)


def test_zero_and_impossible_dates_and_odd_bytes() -> None:
    date, moment, text = Column(TYPE_CODES["date"]), Column(TYPE_CODES["datetime"], 0), Column(TYPE_CODES["varchar"], 10)
    raw = b"".join(x.to_bytes(3, "little") for x in (0, 2024 << 9 | 2 << 5 | 30, 2023 << 9 | 2 << 5 | 29, 2024 << 9 | 2 << 5 | 29, 2024 << 9 | 13 << 5 | 1))
    start = np.arange(0, 15, 3)
    assert columnar.decoded(date, np.frombuffer(raw, np.uint8), start, None).to_pylist() == [codec.read_date(raw[a : a + 3]) for a in start]
    raw = b"".join((((y * 13 + m) << 5 | d) << 17 | h << 12 | 5 << 6 | 61 * (h == 1)).__add__(1 << 39).to_bytes(5, "big") for y, m, d, h in ((0, 0, 0, 0), (2024, 2, 29, 3), (2024, 4, 31, 3), (2024, 1, 1, 24), (2024, 1, 1, 1)))
    start = np.arange(0, 25, 5)
    assert columnar.decoded(moment, np.frombuffer(raw, np.uint8), start, None).to_pylist() == [codec.read_datetime(raw[a : a + 5]) for a in start]
    raw = b"\xffab\xc3\xa9"
    assert columnar.decoded(text, np.frombuffer(raw, np.uint8), np.array([0, 3]), np.array([3, 2])).to_pylist() == ["�ab", "é"]


def test_damaged_images_are_taken_back() -> None:
    table = TableMap(1, "d", "t", [Column(TYPE_CODES["int"]), Column(TYPE_CODES["varchar"], 10)])
    found = columnar.Images(table)
    body = image([1, "abc"], table.columns) + image([2, "de"], table.columns)
    base = found.begin(body)
    at = found.pass_over(body, 0, base, b"\1\1", 1, True)
    with pytest.raises(codec.Corrupt):
        found.pass_over(body[:-1], at, base, b"\1\1", 1, True)
    found.pass_over(body, at, base, b"\1\1", 1, True)
    found.cut(1)
    assert found.column(1, np.frombuffer(body, np.uint8)).to_pylist() == ["abc"]


NAMES, COLUMNS = ["id", "v", "w"], [Column(TYPE_CODES["bigint"]), Column(TYPE_CODES["blob"], 2), Column(TYPE_CODES["decimal"], 10 << 8 | 2)]


def _write(path, n: int, seed: int) -> None:  # noqa: ANN001
    """Random inserts, updates (of keys too) and deletes in two tables, of which one gains a column."""
    rnd = random.Random(seed)
    live: dict[int, list] = {}
    with open(path, "wb") as f:
        log = LogWriter(f)
        for i in range(1, n + 1):
            changes = []
            for _ in range(rnd.randint(1, 5)):
                row = [rnd.randrange(40), rnd.choice([None, "x", "é" * 50]), rnd.choice([None, decimal.Decimal(rnd.randrange(10**6)) / 100])]
                if row[0] in live and rnd.random() < 0.4:
                    changes.append(("D", live.pop(row[0]), None))
                elif row[0] in live or not live:
                    changes.append(("U" if row[0] in live else "I", live.get(row[0]), row))
                    live[row[0]] = row
                else:
                    old = rnd.choice(sorted(live))
                    changes.append(("U", live.pop(old), row) if rnd.random() < 0.3 else ("I", None, row))
                    live[row[0]] = row
            log.transaction(100 + i, i - 1, i, [("d", "a", NAMES, COLUMNS, [0], changes), ("d", "b", ["x"], [Column(TYPE_CODES["int"])], [0], [("I", None, [i])])])
        log.transaction(900, n, n + 1, [("d", "b", ["x", "y"], [Column(TYPE_CODES["int"]), COLUMNS[1]], [0], [("I", None, [-1, "new"])])])
        log.gtid(901, n + 1, n + 2)
        log.event(2, 901, bytes(8) + b"\0\0\0\0\0\0BEGIN")
        log.table_map(901, 9, "d", "a", NAMES, COLUMNS, [0])
        log.rows(901, "I", 9, COLUMNS, [(None, [777, "open", None])])


SCHEMA = "id bigint, v string, w decimal(10,2)"


def test_typed_rows_equal_the_changes(spark, tmp_path) -> None:  # noqa: ANN001
    _write(tmp_path / "log.1", 60, 1)
    _write(tmp_path / "log.2", 10, 2)
    rows = binlog.table_rows(spark, str(tmp_path), "d.a", f"{SCHEMA}, _before_id bigint, _before_v string", 700)
    assert rows.rdd.getNumPartitions() > 5
    # An update of a key is two changes there and one row here.
    split = rows.select("*", F.explode(F.when((F.col("_op") == "U") & ~F.col("id").eqNullSafe(F.col("_before_id")), F.array(F.lit("D"), F.lit("I"))).otherwise(F.array("_op"))).alias("op"))
    gone = (F.col("op") == "D") & (F.col("_op") == "U")
    got = split.select("_file_ord", "_pos", "op", "_txn_no", F.when(gone, F.col("_before_id")).otherwise(F.col("id")).alias("id"), F.when(gone, F.col("_before_v")).otherwise(F.col("v")).alias("v"))
    changes = spark.read.format("binlog").option("mode", "changes").load(str(tmp_path)).where("tbl = 'a'")
    image_ = F.from_json(F.coalesce("after", "before"), "id bigint, v string")
    want = changes.select("file_ord", "pos", "op", "txn_no", image_["id"].alias("id"), image_["v"].alias("v"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {r["_partial"] for r in rows.select("_partial").collect()} == {False} and rows.where("_problem IS NOT NULL").count() == 0
    # A table that gained a column.
    other = binlog.table_rows(spark, str(tmp_path), "d.b", "x int, y string", meta=[]).collect()
    assert sorted(map(tuple, other), key=str) == sorted([*((i, None) for n in (60, 10) for i in range(1, n + 1)), (-1, "new"), (-1, "new")], key=str)


def test_latest_rows_equal_the_replay(spark, tmp_path) -> None:  # noqa: ANN001
    _write(tmp_path / "log.1", 80, 3)
    from ledgerloom.operators import routing

    r = replay.replay_log(spark, str(tmp_path), routing.table_groups(spark, [["d.a"]]))
    want = r.latest().select(F.from_json("after", SCHEMA).alias("row")).select("row.*")
    for split in (500, 1 << 20):
        got = replay.latest_rows(spark, str(tmp_path), "d.a", SCHEMA, ["id"], split)
        assert got.columns == ["id", "v", "w"] and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert all(x.id != 777 for x in got.collect())  # its transaction has no end


def test_problems_are_rows_or_errors(spark, tmp_path) -> None:  # noqa: ANN001
    _write(tmp_path / "log.1", 8, 4)
    binlog.register(spark)
    pos = spark.read.format("binlog").load(str(tmp_path)).where("tbl = 'a' AND event_type = 30").orderBy("pos").first().pos
    raw = bytearray((tmp_path / "log.1").read_bytes())
    raw[pos + 35] ^= 255
    (tmp_path / "log.1").write_bytes(raw)
    rows = binlog.table_rows(spark, str(tmp_path), "d.a", SCHEMA)
    assert [(r["_pos"], r["_problem"], r.id) for r in rows.where("_problem IS NOT NULL").collect()] == [(pos, "checksum", None)] and rows.where("_problem IS NULL").count() > 3
    with pytest.raises(Exception, match="checksum"):
        binlog.table_rows(spark, str(tmp_path), "d.a", SCHEMA, meta=[]).collect()


def test_images_that_leave_columns_out(spark, tmp_path) -> None:  # noqa: ANN001
    with open(tmp_path / "log.1", "wb") as f:
        log = LogWriter(f)
        log.transaction(1, 0, 1, [("d", "a", NAMES, COLUMNS, [0], [("I", None, [1, "x", None])])])
        log.transaction(2, 1, 2, [("d", "a", NAMES, COLUMNS, [0], [("U", [1, None, None], [None, "y", None], [True, False, False], [False, True, False])])])
    rows = binlog.table_rows(spark, str(tmp_path), "d.a", SCHEMA, meta=["_op", "_partial"])
    assert [tuple(r) for r in rows.collect()] == [(1, "x", None, "I", False), (None, "y", None, "U", True)]
    with pytest.raises(Exception, match="leave columns out"):
        replay.latest_rows(spark, str(tmp_path), "d.a", SCHEMA, ["id"]).collect()


def test_a_schema_and_a_table_are_needed(spark, tmp_path) -> None:  # noqa: ANN001
    with pytest.raises(ValueError, match="table"):
        binlog.BinlogReader({"path": str(tmp_path), "mode": "rows"}, T.StructType.fromDDL("id int"))
