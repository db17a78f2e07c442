"""Writing logs in the public binary format: the inverse of the codec, for fixtures and for the log sink."""

from __future__ import annotations

import datetime as dt
import decimal
import functools
import io
import struct
import uuid
import zlib
from itertools import groupby
from typing import Any, BinaryIO

from ..functions import codec
from ..functions.codec import TYPE_CODES, Column


def column_for(spark_type: str) -> Column:
    """The wire column for a Spark type's simple name; other types are written as text."""
    simple = {"tinyint": "tinyint", "smallint": "smallint", "int": "int", "bigint": "bigint", "float": "float", "double": "double", "date": "date"}
    if spark_type in simple:
        return Column(TYPE_CODES[simple[spark_type]])
    if spark_type.startswith("decimal("):
        p, s = spark_type[8:-1].split(",")
        return Column(TYPE_CODES["decimal"], int(p) << 8 | int(s))
    if spark_type in ("timestamp", "timestamp_ntz"):
        return Column(TYPE_CODES["datetime"], 6)
    return Column(TYPE_CODES["blob"], 4, binary=spark_type == "binary")


def lenenc(n: int) -> bytes:
    if n < 251:
        return bytes([n])
    for mark, size in ((252, 2), (253, 3), (254, 8)):
        if n < 1 << 8 * size:
            return bytes([mark]) + n.to_bytes(size, "little")
    raise ValueError(n)


def bits(flags: list[bool], high_first: bool = False) -> bytes:
    out = bytearray((len(flags) + 7) // 8)
    for i, f in enumerate(flags):
        out[i // 8] |= f << ((7 - i % 8) if high_first else i % 8)
    return bytes(out)


def _fraction(micros: int, fsp: int) -> bytes:
    size = (fsp + 1) // 2
    return (micros // 10 ** (6 - 2 * size)).to_bytes(size, "big") if size else b""


def value_bytes(value: Any, col: Column) -> bytes:
    name, meta = codec.TYPE_NAMES[col.code], col.meta
    sizes = {"tinyint": 1, "smallint": 2, "mediumint": 3, "int": 4, "bigint": 8}
    if name in sizes:
        return int(value).to_bytes(sizes[name], "little", signed=not col.unsigned)
    if name == "float":
        return struct.pack("<f", value)
    if name == "double":
        return struct.pack("<d", value)
    if name == "decimal":
        return codec.write_decimal(decimal.Decimal(value), meta >> 8, meta & 0xFF)
    if name == "date":
        return (value.year << 9 | value.month << 5 | value.day).to_bytes(3, "little")
    if name == "datetime":
        date = (value.year * 13 + value.month) << 5 | value.day
        x = (date << 17 | value.hour << 12 | value.minute << 6 | value.second) + (1 << 39)
        return x.to_bytes(5, "big") + _fraction(value.microsecond, meta)
    if name == "timestamp":
        seconds = int(value.replace(tzinfo=dt.timezone.utc).timestamp())
        return seconds.to_bytes(4, "big") + _fraction(value.microsecond, meta)
    if name == "time_old":
        t = int(value.total_seconds())
        sign, t = (-1 if t < 0 else 1), abs(t)
        return (sign * (t // 3600 * 10000 + t // 60 % 60 * 100 + t % 60)).to_bytes(3, "little", signed=True)
    if name == "year":
        return bytes([value - 1900 if value else 0])
    if name in ("enum", "set"):
        return int(value).to_bytes(meta or 1, "little")
    raw = value if isinstance(value, bytes) else str(value).encode()
    if name in ("varchar", "var_string"):
        return len(raw).to_bytes(2 if meta > 255 else 1, "little") + raw
    if name in ("blob", "json"):
        return len(raw).to_bytes(meta, "little") + raw
    raise ValueError(f"column type {name} is not written")


def image(values: list[Any], columns: list[Column], present: list[bool] | None = None) -> bytes:
    """A row image: of the columns that are ``present``, which of them are null, and the values of the others."""
    own = [(v, c) for v, c, p in zip(values, columns, present or [True] * len(columns), strict=True) if p]
    return bits([v is None for v, _ in own]) + b"".join(value_bytes(v, c) for v, c in own if v is not None)


#: How ``struct`` writes the types that it writes as the format does.
_PACKED = {"tinyint": "b", "smallint": "h", "int": "i", "bigint": "q", "float": "f", "double": "d"}


@functools.lru_cache(256)
def _packer(columns: tuple[tuple[int, bool], ...]) -> struct.Struct | None:
    """Images of such columns, (code, unsigned), without nulls: zero bits and the values, in one step; None where a column is of another type."""
    kinds = [_PACKED.get(codec.TYPE_NAMES[code]) for code, _ in columns]
    if not kinds or None in kinds:
        return None
    return struct.Struct(f"<{(len(columns) + 7) // 8}x" + "".join(k.upper() if unsigned and k in "bhiq" else k for k, (_, unsigned) in zip(kinds, columns, strict=True)))


def images_of(rows: list[list[Any]], columns: list[Column]) -> list[bytes]:
    """Whole images; those with nulls, and values that ``struct`` doesn't take, one value at a time."""
    packer = _packer(tuple((c.code, c.unsigned) for c in columns))
    if packer is None:
        return [image(r, columns) for r in rows]
    pack, out = packer.pack, []
    for r in rows:
        try:
            out.append(pack(*r))
        except struct.error:
            out.append(image(r, columns))
    return out


class LogWriter:
    """Appends events to a file. ``checksum``: write CRC-32 tails."""

    def __init__(self, to: BinaryIO, server: str = "8.0.30", checksum: bool = True, server_id: int = 1) -> None:
        self.to, self.server_id, self.pos, self.ids = to, server_id, len(codec.MAGIC), {}
        #: The last table map's table and body: transactions of one table don't make it anew.
        self.mapped: tuple[tuple, bytes] | None = None
        self.tail = False
        to.write(codec.MAGIC)
        body = struct.pack("<H50sIB", 4, server.encode(), 0, codec.HEADER_SIZE) + bytes(40)
        modern = codec.server_version(server) >= codec.CHECKSUM_SINCE
        if modern:
            body += bytes([codec.CHECKSUM_CRC32 if checksum else codec.CHECKSUM_OFF])
        self.tail = modern
        self.event(15, 0, body)
        self.tail = modern and checksum

    def event(self, kind: int, seconds: int, body: bytes, flags: int = 0, break_checksum: bool = False) -> None:
        length = codec.HEADER_SIZE + len(body) + 4 * self.tail
        data = struct.pack("<IBIIIH", seconds, kind, self.server_id, length, self.pos + length & 0xFFFFFFFF, flags) + body
        if self.tail:
            data += ((zlib.crc32(data) + break_checksum) & 0xFFFFFFFF).to_bytes(4, "little")
        self.to.write(data)
        self.pos += length

    def gtid(self, seconds: int, last_committed: int, sequence: int, kind: int = 34, gno: int = 0, sid: uuid.UUID = uuid.UUID(int=0)) -> None:
        body = b"\1" + sid.bytes + gno.to_bytes(8, "little", signed=True) + b"\2" + struct.pack("<qq", last_committed, sequence)
        self.event(kind, seconds, body + (seconds * 10**6).to_bytes(7, "little") + lenenc(0) + (80030).to_bytes(4, "little"))

    def table_map(self, seconds: int, table_id: int, db: str, table: str, names: list[str] | None, columns: list[Column], keys: list[int]) -> None:
        of = (table_id, db, table, names and tuple(names), tuple((c.code, c.meta, c.unsigned, c.binary) for c in columns), tuple(keys))
        if self.mapped and self.mapped[0] == of:
            self.event(19, seconds, self.mapped[1])
            return
        meta = b""
        for c in columns:
            kind = codec.TYPE_NAMES[c.code]
            size = codec.META_SIZES.get(kind, 0)
            meta += c.meta.to_bytes(size, "big" if kind in ("decimal", "string", "enum", "set") else "little") if size else b""
        body = table_id.to_bytes(6, "little") + b"\1\0" + bytes([len(db)]) + db.encode() + b"\0" + bytes([len(table)]) + table.encode() + b"\0"
        body += lenenc(len(columns)) + bytes(c.code for c in columns) + lenenc(len(meta)) + meta + bits([True] * len(columns))

        def more(kind: int, data: bytes) -> bytes:
            return bytes([kind]) + lenenc(len(data)) + data

        body += more(1, bits([c.unsigned for c in columns if codec.TYPE_NAMES[c.code] in codec.NUMERIC], True))
        body += more(3, b"".join(lenenc(63 if c.binary else 255) for c in columns if codec.TYPE_NAMES[c.code] in codec.CHARACTER))
        if names:
            body += more(4, b"".join(lenenc(len(n.encode())) + n.encode() for n in names))
        if keys:
            body += more(8, b"".join(lenenc(k) for k in keys))
        self.mapped = of, body
        self.event(19, seconds, body)

    def rows(self, seconds: int, op: str, table_id: int, columns: list[Column], images: list[tuple[list | None, list | None]], version: int = 2, before: list[bool] | None = None, after: list[bool] | None = None) -> None:
        """``before``, ``after``: which columns the images have; all, where not given."""
        kind = {"I": 30, "U": 31, "D": 32}[op] - 7 * (version == 1)
        every = [True] * len(columns)
        before, after = before or every, after or every
        first = after if op == "I" else before
        body = table_id.to_bytes(6, "little") + b"\1\0" + (b"\2\0" if version == 2 else b"") + lenenc(len(columns)) + bits(first) + (bits(after) if op == "U" else b"")
        if op == "I" and all(after):
            data = images_of([x for _, x in images], columns)
        else:
            data = [image(x, columns, p) for pair in images for x, p in zip(pair, (before, after), strict=True) if x is not None]
        self.event(kind, seconds, body + b"".join(data))

    def xid(self, seconds: int, xid: int) -> None:
        self.event(16, seconds, xid.to_bytes(8, "little"))

    def transaction(self, seconds: int, last_committed: int, sequence: int, changes: list[tuple], sid: uuid.UUID | None = None, gno: int = 0, compress: bool = False, xa: tuple[bytes, bytes, int] | None = None) -> None:
        """``changes``: (db, table, names, columns, keys, [(op, before, after), or with the columns that both images have]), written in their order.

        ``sid``, ``gno``: its global identity. ``compress``: its events are packed into one. ``xa``: it is only prepared, under this identity.
        """
        self.gtid(seconds, last_committed, sequence, *((33, gno, sid) if sid else ()))
        if compress:
            import zstandard

            inner = io.BytesIO()
            nested = LogWriter.__new__(LogWriter)
            nested.to, nested.server_id, nested.pos, nested.ids, nested.tail, nested.mapped = inner, self.server_id, 0, self.ids, False, self.mapped
            nested._body(seconds, sequence, changes, None)
            self.mapped = nested.mapped
            packed, unpacked = zstandard.ZstdCompressor().compress(inner.getvalue()), len(inner.getvalue())
            fields = [(codec.PAYLOAD_COMPRESSION, lenenc(codec.ZSTD)), (codec.PAYLOAD_UNCOMPRESSED, lenenc(unpacked)), (codec.PAYLOAD_SIZE, lenenc(len(packed)))]
            self.event(codec.PAYLOAD, seconds, b"".join(lenenc(k) + lenenc(len(v)) + v for k, v in fields) + lenenc(codec.PAYLOAD_END) + packed)
        else:
            self._body(seconds, sequence, changes, xa)

    def statement(self, seconds: int, query: str) -> None:
        self.event(2, seconds, bytes(8) + b"\0\0\0\0\0\0" + query.encode())

    def xa_prepare(self, seconds: int, xid: tuple[bytes, bytes, int], one_phase: bool = False) -> None:
        gtrid, bqual, form = xid
        self.event(38, seconds, bytes([one_phase]) + struct.pack("<iII", form, len(gtrid), len(bqual)) + gtrid + bqual)

    def previous_gtids(self, seconds: int, sets: dict[uuid.UUID, list[tuple[int, int]]]) -> None:
        body = len(sets).to_bytes(8, "little")
        for sid, intervals in sets.items():
            body += sid.bytes + len(intervals).to_bytes(8, "little") + b"".join(struct.pack("<qq", a, b + 1) for a, b in intervals)
        self.event(35, seconds, body)

    def _body(self, seconds: int, sequence: int, changes: list[tuple], xa: tuple[bytes, bytes, int] | None) -> None:
        self.statement(seconds, f"XA START X'{xa[0].hex()}',X'{xa[1].hex()}',{xa[2]}" if xa else "BEGIN")
        for db, table, names, columns, keys, rows in changes:
            table_id = self.ids.setdefault((db, table), len(self.ids) + 1)
            self.table_map(seconds, table_id, db, table, names, columns, keys)
            for (op, *present), own in groupby(rows, lambda r: (r[0], *r[3:])):
                self.rows(seconds, op, table_id, columns, [(r[1], r[2]) for r in own], 2, *present)
        if xa:
            self.xa_prepare(seconds, xa)
        else:
            self.xid(seconds, sequence)
