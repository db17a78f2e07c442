"""Decoders against known bytes, and against the writer's own."""

from __future__ import annotations

import datetime as dt
import decimal
import io
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.functions import codec
from ledgerloom.functions.codec import TYPE_CODES, Column, Cursor
from ledgerloom.sources import binlog_writer as writer
from ledgerloom.sources.binlog import FileParser, Settings, _rows_of


def test_known_vectors() -> None:
    assert codec.read_decimal(bytes.fromhex("810DFB38D204D2"), 14, 4) == decimal.Decimal("1234567890.1234")
    assert codec.read_decimal(bytes.fromhex("7EF204C72DFB2D"), 14, 4) == decimal.Decimal("-1234567890.1234")
    assert codec.read_datetime(bytes.fromhex("99A976C8B8")) == dt.datetime(2021, 4, 27, 12, 34, 56)
    assert codec.read_date(bytes.fromhex("9BCA0F")) == dt.date(2021, 4, 27)
    assert codec.read_timestamp(bytes.fromhex("608804F0")) == dt.datetime(2021, 4, 27, 12, 34, 56)
    assert codec.time_text(codec.read_time_old(bytes.fromhex("40E201"))) == "12:34:56"
    c = Cursor(bytes.fromhex("0000C03F" + "00000000000002C0" + "FEFFFF"))
    assert [codec.read_value(c, Column(TYPE_CODES[k])) for k in ("float", "double", "mediumint")] == [1.5, -2.25, -2]


def test_zero_dates_are_null() -> None:
    assert codec.read_date(b"\0\0\0") is None
    assert codec.read_timestamp(b"\0\0\0\0") is None
    assert codec.read_datetime((1 << 39).to_bytes(5, "big")) is None


def test_lenenc_and_bounds() -> None:
    for n in (0, 250, 251, 65535, 65536, 1 << 24, 1 << 40):
        assert Cursor(writer.lenenc(n)).lenenc() == n
    assert Cursor(b"\xfb").lenenc() is None
    with pytest.raises(codec.Corrupt):
        Cursor(b"\xfc\x01").lenenc()


def test_versions_and_uuid() -> None:
    assert codec.server_version("8.0.23-log") == (8, 0, 23)
    assert codec.server_version("x") == (0, 0, 0)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 65), st.data())
def test_decimal_round_trip(precision: int, data: st.DataObject) -> None:
    scale = data.draw(st.integers(0, min(30, precision)))
    digits = data.draw(st.integers(-(10**precision) + 1, 10**precision - 1))
    with decimal.localcontext(decimal.Context(prec=80)):
        value = decimal.Decimal(digits).scaleb(-scale)
        raw = writer.value_bytes(value, Column(TYPE_CODES["decimal"], precision << 8 | scale))
        assert len(raw) == codec.decimal_size(precision, scale)
        assert codec.read_decimal(raw, precision, scale) == value


def _parse(data: bytes, mode: str = "events", **more: object) -> list[tuple]:
    parser = FileParser("f", 0, Settings(mode, **more))
    return [r for rows in _rows_of(parser, io.BytesIO(data)) for r in rows]


COLUMNS = [Column(TYPE_CODES[k], m) for k, m in (("int", 0), ("varchar", 400), ("datetime", 6), ("timestamp", 3), ("date", 0), ("double", 0), ("decimal", 14 << 8 | 4), ("bigint", 0), ("blob", 2))]
NAMES = [f"k{i}" for i in range(len(COLUMNS))]
ROW = [7, "x'é", dt.datetime(2020, 2, 29, 23, 59, 59, 123456), dt.datetime(2021, 1, 1, 0, 0, 0, 250000), dt.date(1999, 12, 31), 0.5, decimal.Decimal("-3.25"), -(2**60), "long"]


def _log(**options: object) -> tuple[writer.LogWriter, io.BytesIO]:
    out = io.BytesIO()
    return writer.LogWriter(out, **options), out


@pytest.mark.parametrize("checksum", [True, False])
@pytest.mark.parametrize("version", [1, 2])
def test_rows_of_all_kinds(checksum: bool, version: int) -> None:
    log, out = _log(checksum=checksum)
    log.table_map(5, 9, "db", "t", NAMES, COLUMNS, [0, 7])
    nulls = [1, *[None] * 8]
    log.rows(5, "I", 9, COLUMNS, [(None, ROW), (None, nulls)], version)
    log.rows(6, "U", 9, COLUMNS, [(ROW, [7, *[None] * 6, ROW[7], None])], version)
    log.rows(6, "U", 9, COLUMNS, [(ROW, nulls)], version)  # another key
    log.rows(7, "D", 9, COLUMNS, [(nulls, None)], version)
    log.xid(7, 1)
    rows = _parse(out.getvalue(), "changes")
    assert [(r[7], r[3]) for r in rows] == [("I", 0), ("I", 1), ("U", 0), ("D", 0), ("I", 1), ("D", 0)]
    import json

    first = json.loads(rows[0][10])
    assert first["k1"] == "x'é" and first["k2"] == "2020-02-29 23:59:59.123456" and first["k3"] == "2021-01-01 00:00:00.250000"
    assert first["k6"] == "-3.2500" and first["k7"] == -(2**60)
    assert json.loads(rows[1][10]) == {"k0": 1} | {f"k{i}": None for i in range(1, 9)}
    assert json.loads(rows[2][9]) == first and json.loads(rows[2][10]) == dict.fromkeys(first) | {"k0": 7, "k7": -(2**60)}
    assert json.loads(rows[3][9]) == first and rows[3][10] is None and rows[4][9] is None and json.loads(rows[4][10]) == json.loads(rows[1][10]) == json.loads(rows[5][9])
    assert json.loads(rows[0][8]) == {"k0": 7, "k7": -(2**60)}


def test_nulls_in_any_column_of_a_wide_table() -> None:
    columns = [Column(TYPE_CODES["tinyint"]) for _ in range(40)]
    for hole in (0, 7, 8, 31, 39):
        values: list[int | None] = list(range(40))
        values[hole] = None
        assert codec.read_image(Cursor(writer.image(values, columns)), codec.TableMap(1, "", "", columns), [True] * 40) == values


def test_remapped_table_id_and_absent_map() -> None:
    log, out = _log()
    one = [Column(TYPE_CODES["int"])]
    log.table_map(1, 5, "d", "a", ["x"], one, [])
    log.rows(1, "I", 5, one, [(None, [1])])
    log.table_map(1, 5, "d", "b", ["y"], one, [])
    log.rows(1, "I", 5, one, [(None, [2])])
    log.rows(1, "I", 1015, one, [(None, [3])])
    assert [(r[6], r[10]) for r in _parse(out.getvalue(), "changes")] == [("a", '{"x": 1}'), ("b", '{"y": 2}'), (None, None)]


def test_corrupt_checksum_is_flagged_and_reading_goes_on() -> None:
    log, out = _log()
    log.event(16, 1, (1).to_bytes(8, "little"), break_checksum=True)
    log.xid(2, 2)
    rows = _parse(out.getvalue())
    assert [r[15] for r in rows] == [False, True, False]
    assert not any(r[15] for r in _parse(out.getvalue(), verify=False))


def test_other_events() -> None:
    log, out = _log()
    log.gtid(3, 4, 5, kind=33, gno=12, sid=uuid.UUID(int=7))
    log.event(4, 0, (4).to_bytes(8, "little") + b"log.000002")
    log.event(29, 0, b"\x08SELECT 1")
    log.event(26, 0, b"\1\0\3abc")
    log.event(27, 0, b"log.000001")
    log.event(38, 0, b"\1" + (5).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + b"ggb")
    log.event(37, 0, b"view".ljust(40, b"\0") + (9).to_bytes(8, "little") + (1).to_bytes(4, "little") + b"\1\0k\2\0vv")
    log.event(39, 0, b"zzzz")
    log.event(40, 0, b"zzzz")
    log.event(36, 0, b"\2" + (7).to_bytes(4, "little") + b"\1" + b"".join(n.to_bytes(4, "little") for n in (3, 1, 2)) + b"ab")
    log.previous_gtids(0, {uuid.UUID(int=7): [(1, 4), (9, 9)]})
    log.event(200, 0, b"")
    import json

    rows = _parse(out.getvalue())
    detail = {r[6]: json.loads(r[14]) for r in rows if r[14]}
    assert (detail["GTID"]["last_committed"], detail["GTID"]["sequence_number"], detail["GTID"]["gno"]) == (4, 5, 12)
    assert detail["ROTATE"] == {"position": 4, "next_file": "log.000002"}
    assert detail["ROWS_QUERY"] == {"query": "SELECT 1"} and detail["INCIDENT"] == {"incident": 1, "message": "abc"}
    assert detail["HEARTBEAT"] == {"log": "log.000001"} and detail["XA_PREPARE"]["gtrid"] == b"gg".hex()
    assert detail["VIEW_CHANGE"] == {"view_id": "view", "view_seq": 9, "certification": {"k": "vv"}}
    assert [r[16] for r in rows if r[5] == 39] == [True] and [r[15] for r in rows if r[5] == 40] == [True] and rows[-1][15]
    assert detail["TRANSACTION_CONTEXT"] == {"server_uuid": "ab", "thread_id": 7, "gtid_specified": True, "snapshot_bytes": 3, "n_writes": 1, "n_reads": 2}
    assert detail["PREVIOUS_GTIDS"] == {"gtid_sets": {str(uuid.UUID(int=7)): [[1, 4], [9, 9]]}}


def test_cut_off_tail_is_a_damaged_event() -> None:
    log, out = _log()
    log.xid(1, 1)
    assert [r[15] for r in _parse(out.getvalue()[:-3])] == [False, True]
    assert [r[15] for r in _parse(out.getvalue()[:-15])] == [False, True]
    assert _parse(out.getvalue()[:4]) == []


def test_enum_set_and_signs() -> None:
    enum = Column(TYPE_CODES["string"], TYPE_CODES["enum"] << 8 | 1, labels=["a", "b"])
    flags = Column(TYPE_CODES["string"], TYPE_CODES["set"] << 8 | 1, labels=["x", "y", "z"])
    assert codec.read_value(Cursor(b"\2"), enum) == "b"
    assert codec.read_value(Cursor(b"\5"), flags) == "x,z"
    assert codec.read_value(Cursor(b"\xff"), Column(TYPE_CODES["tinyint"], unsigned=True)) == 255
    assert codec.read_value(Cursor(b"\3abc"), Column(TYPE_CODES["string"], 254 << 8 | 30)) == "abc"
    assert codec.time_text(codec.read_time((0x800000 - (1 << 12 | 2 << 6 | 3)).to_bytes(3, "big"))) == "-01:02:03"


def test_sizes_come_from_the_format_description() -> None:
    """A format with post-headers of six bytes has table ids of four; kinds that it doesn't give a size have that of the fourth version."""
    short = codec.FormatDescription(post_header_lengths=bytes(6 if k == 19 else 0 for k in range(1, 40)))
    assert (short.post_header(19), short.id_bytes(19)) == (6, 4) and (short.post_header(30), short.id_bytes(30)) == (10, 6)
    assert codec.FormatDescription().post_header(23) == 8
    inner = (5).to_bytes(4, "little") + b"\1\0\1d\0\1a\0" + b"\1\3\0\1"
    assert codec.read_table_map(inner, 4).table == "a"
