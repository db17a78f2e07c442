"""The log source: binary log files as DataFrames of events, or of row changes, in batch and as a stream; and a sink.

``spark.read.format("binlog").load(path)`` gives one partition for each file; ``load`` also cuts long files into splits. Options:
``mode`` = events (default), changes, replay (changes and the ends of transactions), or rows; ``columns``: JSON of
{"db.table": [column names]} for logs whose table maps carry no names; ``verifyChecksum`` = true (default).

Mode rows gives the rows of one ``table`` ("db.table") in typed columns, those of the schema that the reader is given: the row after an insert or an
update, and before a delete; a column ``_before_x`` has x before an update or a delete; columns named in ``META`` tell where a row comes from. Only the columns asked for are
decoded, whole columns at a time (``functions.columnar``). Columns that an image leaves out are null, and ``_partial`` is true. What can't be read is a row with ``_problem``; a schema
without this column makes the read fail there. ``complete`` = true leaves out what follows a file's last end of a transaction.

Nothing is passed over in silence. Whatever can't be read is a row: in mode events one with ``corrupt`` (or
``unsupported``) true, in the other modes one with ``problem`` set and no op: damaged events, rows without a table map, rows that don't
decode, events whose rows aren't read. Behind a damaged length reading goes on at the next header whose
end position fits its own; the bytes between are one damaged event. A header whose end position doesn't fit is damaged too, unless
its event's checksum is right (a log that was copied from another place has such positions throughout).

An update that changes the key is a delete of the old key and an insert of the new one. Columns that an image leaves out are left out of
its JSON, so they differ from NULL (``versions.latest_columns`` puts them together).

Compressed transactions (payload events) are unpacked piece by piece; their rows have the payload's position, and are numbered through it by ``row_ord``.
``gtid`` ("server:number") is the transaction's global identity, where the log gives one. In mode replay the row that ends a transaction has, for distributed
(XA) transactions, prepare, commit or rollback in ``after`` and the identity in ``pk``.

Rows are numbered by transaction (``txn_no``, from 1 in each file) as they are read: from BEGIN to XID, or one statement outside of these.
Table maps hold until their transaction ends. Filters on ``event_type`` are pushed down (equality and IN), before any body is decoded. Files are opened through
Arrow's file systems, by a path or a URI (file, hdfs, s3, ...), on the executors; for stores that only Spark opens,
``read_log`` gets the bytes through Spark's ``binaryFile`` reader and parses the same way.

Splits (``load``): a first job finds, for every ``split_bytes`` of a file, the first place where a transaction has ended (from the next header
that fits and whose checksum is right), and counts the transactions between these places; prefix sums give each split its first number.
The second job reads the splits as partitions of their own.

Streams: an offset is each file's size, and whether the file is finished; the driver only lists files. Tasks find the ends of transactions, and a batch has
whole transactions: what follows a file's last end waits for more bytes, or until the file is finished. A file is finished when the
sink published it, when a later file of its name (up to the last number) exists, or when it hasn't changed for ``finishAfter`` seconds. Then its tail
is read as a batch reads it, damage included. ``stateLocation``: a folder where tasks leave, for each file and size, the place and the transaction
number they came to, so that the next batch goes on there; without it (or when a state is lost) tasks walk the file's
headers again. Bytes added to a finished file are read from where it ended.

Sink: tasks write files of unique names, which no reader sees until the job is committed: the driver then publishes a manifest
(one file, moved into place) that lists them in order of partitions. An aborted job's files are removed; files that attempts left
behind are in no manifest. Appends add manifests; ``overwrite`` publishes one that replaces all before, and then removes what it replaced. Readers
follow the manifests in their order, after the folder's other files.
"""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import fnmatch
import hashlib
import io
import json
import re
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions import codec, columnar

_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "timestamp": pa.timestamp("us", "UTC"), "binary": pa.binary(), "boolean": pa.bool_()}
EVENT_SCHEMA = "file string, file_ord int, pos long, end_pos long, event_time timestamp, event_type int, type_name string, server_id long, flags int, event_len long, payload binary, db string, tbl string, table_id long, detail string, corrupt boolean, unsupported boolean, ends_txn boolean"
CHANGE_SCHEMA = "file string, file_ord int, pos long, row_ord int, event_time timestamp, db string, tbl string, op string, pk string, before string, after string, partition_id int, source_partition_id int, txn_no long, gtid string, problem string"
SPLIT_SCHEMA = "file string, file_ord int, split int, start long, stop long, n_ends long"
#: Columns of mode rows that tell where a row comes from.
META = {"_op": "string", "_file_ord": "int", "_pos": "long", "_row_ord": "int", "_event_time": "timestamp", "_txn_no": "long", "_gtid": "string", "_partial": "boolean", "_problem": "string"}
BEFORE = "_before_"
#: The op of a row that says where a transaction ends, in mode replay.
END = "end"
CHUNK = 8 << 20
#: Bytes that are looked through for a header first; further windows are twice as long each, up to ``CHUNK``.
WINDOW = 1 << 14
#: Partitions of one read at most: with more splits, a partition has a run of them.
MAX_PARTITIONS = 1024
#: Rows of a batch, and bytes of their images or payloads.
BATCH_ROWS, BATCH_BYTES = 8192, 32 << 20
#: Rows that are decoded together in mode rows.
TYPED_ROWS = 1 << 16
SPLIT_BYTES = 128 << 20
#: Table maps that a parser remembers.
MAPS = 256
#: Where a folder's sink keeps its manifests, and the names of the files that count only if a manifest lists them.
MANIFESTS = "_manifests"
SINK_FILE = re.compile(r"log-[0-9a-f]{32}-\d+-\d+$")


def store_of(path: str) -> tuple[stores.FileSystem, str]:
    """The file system of a path or a URI, and the path within it."""
    if "://" in path:
        return stores.FileSystem.from_uri(path)
    return stores.LocalFileSystem(), path.removeprefix("file:")


def published(store: stores.FileSystem, folder: str) -> list[str]:
    """The names of the sink's files in a folder, in the order of its manifests."""
    where = f"{folder.rstrip('/')}/{MANIFESTS}"
    if store.get_file_info(where).type != stores.FileType.Directory:
        return []
    out: list[str] = []
    for info in sorted(store.get_file_info(stores.FileSelector(where)), key=lambda f: f.base_name):
        if info.type == stores.FileType.File and info.base_name.endswith(".json"):
            with store.open_input_stream(info.path) as f:
                manifest = json.loads(f.read())
            out = ([] if manifest["replaces"] else out) + manifest["files"]
    return out


def log_files(path: str) -> list[str]:
    """Files of a folder, a pattern for names or a comma-separated list (as given), in order of name; then the sink's, in order of their manifests."""
    out: list[str] = []
    for part in (p.strip() for p in path.split(",")):
        store, inner = store_of(part)
        head = part[: len(part) - len(inner)] if part.endswith(inner) else ""
        info = store.get_file_info(inner)
        if info.type == stores.FileType.Directory:
            folder, pattern = inner, "*"
        elif info.type == stores.FileType.NotFound and any(c in inner for c in "*?["):
            folder, pattern = inner.rsplit("/", 1)
        else:
            out.append(part)
            continue
        found = {f.base_name: f.path for f in store.get_file_info(stores.FileSelector(folder)) if f.type == stores.FileType.File and not f.base_name.startswith(("_", "."))}
        names = sorted(n for n in found if not SINK_FILE.fullmatch(n)) + [n for n in published(store, folder) if n in found]
        out += [head + found[n] for n in names if fnmatch.fnmatch(n, pattern)]
    return out


def _next_header(data: bytes, pos: int) -> int | None:
    """Where in ``data``, which begins at ``pos`` of the file, the next header is whose end position fits its length."""
    n = len(data) - codec.HEADER_SIZE + 1
    if n < 1:
        return None
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    number = lambda at: raw[at : at + n] | raw[at + 1 : at + 1 + n] << 8 | raw[at + 2 : at + 2 + n] << 16 | raw[at + 3 : at + 3 + n] << 24
    length, end = number(9), number(13)
    places = np.arange(n, dtype=np.uint64) + np.uint64(pos)
    fits = (length >= codec.HEADER_SIZE) & ((places + length) & np.uint64(0xFFFFFFFF) == end) & np.isin(raw[4 : 4 + n], list(codec.EVENT_TYPES))
    found = np.flatnonzero(fits)
    return int(found[0]) if len(found) else None


class Frames:
    """The events of a log file, by the lengths in the headers.

    ``own``: whether all headers up to here had the end position of their own event. ``tail``: gives the bytes of a checksum.
    """

    def __init__(self, read: Any, tail: Callable[[], int], own: bool = True) -> None:
        self.read, self.tail, self.own = read, tail, own

    def between(self, start: int, end: int, final: bool = True) -> Iterator[tuple[int, bytes, bool]]:
        """(position, bytes, whole) of each event; ``end`` is taken for the file's end.

        What no event can be made of, up to the next header or to the end, comes with ``whole`` false. Unless ``final``,
        nothing comes of an event, or of damage, that may be whole when more has been written.
        """
        pos, read = start, self.read
        while pos < end:
            read.seek(pos)
            head = read.read(min(codec.HEADER_SIZE, end - pos))
            length, stated = (int.from_bytes(head[9:13], "little"), int.from_bytes(head[13:17], "little")) if len(head) == codec.HEADER_SIZE else (0, 0)
            fits = (pos + length) & 0xFFFFFFFF == stated
            if length >= codec.HEADER_SIZE and pos + length <= end:
                data = head + read.read(length - codec.HEADER_SIZE)
                if len(data) == length and (fits or not self.tail() or codec.crc_matches(data)):
                    self.own &= fits
                    yield pos, data, True
                    pos += length
                    continue
            elif not final and (len(head) < codec.HEADER_SIZE or length >= codec.HEADER_SIZE and (fits or not self.own or not self.tail())):
                return
            after = next_header(read, pos + 1, end)
            if after is None and not final:
                return
            after = end if after is None else after
            read.seek(pos)
            yield pos, read.read(after - pos), False
            pos = after


def next_header(read: Any, start: int, end: int) -> int | None:
    """The first place at or behind ``start`` of a header that fits, looked for chunk by chunk."""
    at, length = start, WINDOW
    while at < end:
        read.seek(at)
        wanted = min(length, end - at)
        window = read.read(wanted)
        found = _next_header(window, at)
        if found is not None:
            return at + found
        if len(window) < wanted or at + wanted >= end:
            return None
        at, length = at + len(window) - codec.HEADER_SIZE + 1, min(2 * length, CHUNK)
    return None


def size_of(read: Any) -> int:
    return read.seek(0, io.SEEK_END)


def text_of(value: Any) -> Any:
    """A column value for JSON: numbers as they are, decimals and times as text, bytes in base 64."""
    if isinstance(value, bytes):
        return base64.b64encode(value).decode()
    if isinstance(value, decimal.Decimal):
        return format(value, "f")
    if isinstance(value, dt.datetime):
        return value.isoformat(" ")
    return value.isoformat() if isinstance(value, dt.date) else value


_encode = json.JSONEncoder(ensure_ascii=False, default=text_of).encode
_PLAIN = (str, int, float, bool, type(None))


def as_json(image: dict[str, Any] | None) -> str | None:
    if image is None:
        return None
    return _encode({k: v if isinstance(v, _PLAIN) else text_of(v) for k, v in image.items()})


@dataclass
class Settings:
    mode: str = "events"
    columns: dict[str, list[str]] | None = None
    verify: bool = True
    types: set[int] | None = None
    table: str | None = None
    complete: bool = False
    schema: pa.Schema | None = None


class FileParser:
    """Turns the events of one file into rows; keeps the file's format description, newest table maps and transaction."""

    def __init__(self, file: str, file_ord: int, settings: Settings, first_txn: int = 1) -> None:
        self.file, self.file_ord, self.settings = file, file_ord, settings
        self.format, self.tables, self.named = codec.FormatDescription(), {}, {}
        self.txn_no, self.inside = first_txn, False
        self.maps: dict[bytes, tuple[codec.TableMap, list[str]]] = {}
        self.gtid: str | None = None
        #: Rows of the present event so far; and what its end of a transaction means for a distributed one.
        self.made, self.xa = 0, None

    def table_map(self, body: bytes) -> codec.TableMap:
        """A table map takes hold; one that came before, byte for byte, isn't parsed again."""
        known = self.maps.get(body)
        if known is None:
            table = codec.read_table_map(body, self.format.id_bytes(19))
            if len(self.maps) >= MAPS:
                self.maps.clear()
            known = self.maps[body] = table, self.names(table)
        table, self.named[known[0].table_id] = known
        self.tables[table.table_id] = table
        return table

    def passed(self, event: bytes, whole: bool) -> bool:
        """Whether a transaction ends with an event: what the numbers of later rows depend on, without its rows."""
        kind = event[4] if whole else 0
        if kind not in (2, 15, 16, 38, codec.PAYLOAD):
            return False
        try:
            if kind == 15:
                self.format = codec.FormatDescription.read(event[codec.HEADER_SIZE :])
                return False
            tail = self.format.tail()
            if tail and self.settings.verify and not codec.crc_matches(event):
                return False
            ended = self._ends(kind, event[codec.HEADER_SIZE : len(event) - tail])
        except (codec.Corrupt, IndexError, ValueError):
            return False
        self.txn_no += ended
        return ended

    def learn(self, frames: Frames, end: int) -> None:
        """The format description at the file's start."""
        for _, event, whole in frames.between(4, end):
            self.passed(event, whole)
            break

    def format_tail(self) -> int:
        return self.format.tail()

    def names(self, table: codec.TableMap) -> list[str]:
        given = (self.settings.columns or {}).get(f"{table.db}.{table.table}")
        return [c.name or (given[i] if given and i < len(given) else f"c{i}") for i, c in enumerate(table.columns)]

    def _ends(self, kind: int, body: bytes) -> bool:
        """Whether an event ends a transaction: XID, XA PREPARE, a payload (which holds a whole one), or a statement that isn't between BEGIN and one of these."""
        self.xa = None
        if kind in (16, 38, codec.PAYLOAD):
            self.inside = False
            if kind == 38:
                d = codec.read_detail(38, body)
                self.xa = "commit" if d["one_phase"] else "prepare", codec.xid_text(d["gtrid"], d["bqual"], d["format_id"])
            return True
        if kind == 2:
            text = codec.read_detail(2, body)["query"].strip()
            query = text.upper()
            self.xa = codec.xa_decision(text) if query.startswith("XA ") else None
            if query == "BEGIN" or query.startswith(("XA START", "XA BEGIN", "START TRANSACTION")):
                self.inside = True
            elif not self.inside or query in ("COMMIT", "ROLLBACK"):
                self.inside = False
                return True
        return False

    def rows(self, pos: int, event: bytes, whole: bool = True) -> list[tuple]:
        """The rows of one event."""
        s, corrupt, detail, table, problem, ends, out = self.settings, not whole, {}, None, None, False, []
        head = codec.Header.read(event) if len(event) >= codec.HEADER_SIZE else codec.Header(0, 0, 0, len(event), 0, 0)
        body, kind, changes = event[codec.HEADER_SIZE :], head.type, s.mode != "events"
        wanted = s.types is None or kind in s.types
        when = dt.datetime.fromtimestamp(head.timestamp, dt.timezone.utc)
        if not whole:
            problem = "damaged length, or cut off"
        elif not head.known():
            corrupt, problem = True, f"unknown event type {kind}"
        try:
            if not corrupt and kind == 15:
                self.format = codec.FormatDescription.read(body)
            tail = self.format.tail()
            if not corrupt and tail and s.verify and (wanted or changes or kind in (2, 16, 38, codec.PAYLOAD)) and not codec.crc_matches(event):
                corrupt, problem = True, "checksum"
            body = body[: len(body) - tail] if tail and kind != 15 and whole else body
            if not corrupt:
                ends = self._ends(kind, body)
                if kind in (33, 34) and changes:
                    g = codec.read_gtid(body)
                    self.gtid = f"{g['sid']}:{g['gno']}" if kind == 33 else None
                self.made = 0
                if kind == codec.PAYLOAD and changes:
                    out = self._payload(pos, body)
                elif kind == 19:
                    table = self.table_map(body)
                elif kind in codec.ROW_OPS:
                    table = self.tables.get(int.from_bytes(body[: self.format.id_bytes(kind)], "little"))
                    if changes:
                        if table is None:
                            raise codec.Corrupt("rows without a table map")
                        out = self._changes(pos, kind, body, table, when)
                elif kind in codec.UNSUPPORTED_ROWS:
                    problem = f"rows of {codec.EVENT_TYPES[kind]} are not read"
                elif wanted and not changes:
                    detail = codec.read_detail(kind, body)
        except (codec.Corrupt, IndexError, ValueError) as e:
            corrupt, problem, detail, out = True, str(e) or type(e).__name__, {"error": str(e)}, []
        number, gtid = self.txn_no, self.gtid
        self.txn_no += ends
        if ends:
            self.tables, self.named, self.gtid = {}, {}, None
        if not changes:
            if not wanted:
                return []
            return [(self.file, self.file_ord, pos, pos + len(event), when, kind, codec.EVENT_TYPES.get(kind, "UNKNOWN"), head.server_id, head.flags, len(event), body, table and table.db, table and table.table, table and table.table_id, json.dumps(detail) if detail else None, corrupt, kind in codec.UNSUPPORTED, ends)]
        if problem:
            out.append(self._problem(pos, when, table, number, gtid, problem))
        if ends and s.mode == "replay":
            decided, xid = self.xa or (None, None)
            out.append((self.file, self.file_ord, pos, 0, when, None, None, END, xid, None, decided, None, None, number, gtid, None))
        return out

    def _problem(self, pos: int, when: dt.datetime, table: codec.TableMap | None, number: int, gtid: str | None, problem: str) -> tuple:
        return (self.file, self.file_ord, pos, 0, when, table and table.db, table and table.table, None, None, None, None, None, None, number, gtid, problem)

    def _payload(self, pos: int, body: bytes) -> list[tuple]:
        """The rows of the events in a payload, and what of it can't be read."""
        out: list[tuple] = []
        head, when = codec.read_payload_head(body), None
        try:
            for event in codec.payload_events(body, head):
                kind, inner, table = event[4], event[codec.HEADER_SIZE :], None
                when = dt.datetime.fromtimestamp(int.from_bytes(event[:4], "little"), dt.timezone.utc)
                try:
                    if kind == 19:
                        self.table_map(inner)
                    elif kind in codec.ROW_OPS:
                        table = self.tables.get(int.from_bytes(inner[: self.format.id_bytes(kind)], "little"))
                        if table is None:
                            raise codec.Corrupt("rows without a table map")
                        out += self._changes(pos, kind, inner, table, when)
                    elif kind in codec.UNSUPPORTED_ROWS:
                        raise codec.Corrupt(f"rows of {codec.EVENT_TYPES[kind]} are not read")
                except (codec.Corrupt, IndexError, ValueError) as e:
                    out.append(self._problem(pos, when, table, self.txn_no, self.gtid, str(e) or type(e).__name__))
        except codec.Corrupt as e:
            when = when or dt.datetime.fromtimestamp(0, dt.timezone.utc)
            out.append(self._problem(pos, when, None, self.txn_no, self.gtid, str(e)))
        return out

    def _changes(self, pos: int, kind: int, body: bytes, table: codec.TableMap, when: dt.datetime) -> list[tuple]:
        names, op, out = self.named[table.table_id], codec.ROW_OPS[kind], []
        head = codec.read_rows_head(kind, body, self.format.id_bytes(kind))
        own = lambda values, present: None if values is None else {n: v for n, v, p in zip(names, values, present, strict=True) if p}
        keys = [names[k] for k in table.primary_key]

        def key_of(*images: dict | None) -> str | None:
            """From the first image that has a key column; null where the table has no key."""
            found = {k: next((i[k] for i in images if i and k in i), None) for k in keys}
            return as_json(found) if keys else None

        def add(op: str, before: dict | None, after: dict | None, key: str | None) -> None:
            out.append((self.file, self.file_ord, pos, self.made + len(out), when, table.db, table.table, op, key, as_json(before), as_json(after), head.partition_id, head.source_partition_id, self.txn_no, self.gtid, None))

        for first, second in codec.read_rows(kind, body, table, self.format.id_bytes(kind)):
            before, after = own(first, head.before), own(second, head.after)
            if op == "U" and (old := key_of(before)) != (new := key_of(after, before)):
                # The new row is whole: what the after image leaves out is as it was before.
                add("D", before, None, old)
                add("I", None, before | after, new)
            else:
                add(op, before, after, key_of(after, before))
        self.made += len(out)
        return out


class TypedParser(FileParser):
    """Collects the rows of one table, and makes typed batches of them."""

    def __init__(self, *args: Any) -> None:
        super().__init__(*args)
        self.ready: list[pa.RecordBatch] = []
        self.images = self.old = None
        self.meta: dict[str, list] = {n: [] for n in META}
        self.has_old = any(n.startswith(BEFORE) for n in self.settings.schema.names)

    def _changes(self, pos: int, kind: int, body: bytes, table: codec.TableMap, when: dt.datetime) -> list[tuple]:
        if f"{table.db}.{table.table}" != self.settings.table:
            return []
        if self.images is None or self.images.table is not table:
            self.close()
            self.images, self.old = columnar.Images(table), columnar.Images(table)
        head, op, n, m = codec.read_rows_head(kind, body, self.format.id_bytes(kind)), codec.ROW_OPS[kind], self.images.n, self.old.n
        if head.width != len(table.columns):
            raise codec.Corrupt("the rows event and its table map differ in width")
        first, second, at = bytes(head.before), bytes(head.after), head.rows_at
        wide, wider = (sum(first) + 7) // 8, (sum(second) + 7) // 8
        base, old_base, end = self.images.begin(body), self.old.begin(body) if self.has_old else 0, len(body)
        try:
            while at < end:
                begun, behind = at, at
                if op != "I" and self.has_old:
                    behind = self.old.pass_over(body, at, old_base, first, wide, True)
                elif op == "U":
                    behind = self.images.pass_over(body, at, base, first, wide, False)
                elif self.has_old:
                    self.old.skip()
                at = self.images.pass_over(body, behind, base, second, wider, True) if op == "U" else self.images.pass_over(body, at, base, first, wide, True)
                if at == begun:
                    raise codec.Corrupt("rows without columns")
        except codec.Corrupt:
            self.images.cut(n)
            self.old.cut(m)
            raise
        made = self.images.n - n
        row = {"_op": op, "_file_ord": self.file_ord, "_pos": pos, "_event_time": when, "_txn_no": self.txn_no, "_gtid": self.gtid, "_partial": 0 in (second if op == "U" else first), "_problem": None}
        for name, value in row.items():
            self.meta[name] += [value] * made
        self.meta["_row_ord"] += range(self.made, self.made + made)
        self.made += made
        return []

    def problem(self, found: tuple) -> None:
        """A row of what could not be read."""
        if "_problem" not in self.settings.schema.names:
            raise ValueError(f"{self.file} at {found[2]}: {found[-1]} (give the schema a column _problem to get such as rows)")
        if self.images is None:
            self.images = self.old = columnar.Images(codec.TableMap(0, "", "", []))
        for images in {id(i): i for i in (self.images, self.old if self.has_old else self.images)}.values():
            images.skip()
        for name, value in zip(META, (None, self.file_ord, found[2], 0, found[4], found[-3], found[-2], None, found[-1]), strict=True):
            self.meta[name].append(value)

    def full(self) -> bool:
        return self.images is not None and (self.images.n >= TYPED_ROWS or self.images.size >= BATCH_BYTES)

    def close(self) -> None:
        """Make a batch of what is there."""
        if self.images is None or not self.images.n:
            return
        table, schema, columns = self.images.table, self.settings.schema, []
        names = {n: i for i, n in enumerate(self.names(table))}
        raw, old = (np.frombuffer(b"".join(x.data), np.uint8) for x in (self.images, self.old))
        for f in schema:
            own, images, data = (f.name.removeprefix(BEFORE), self.old, old) if f.name.startswith(BEFORE) else (f.name, self.images, raw)
            if f.name in META:
                columns.append(pa.array(self.meta[f.name], f.type))
            elif own in names:
                found = images.column(names[own], data)
                columns.append(found if found.type == f.type else found.cast(f.type))
            else:
                columns.append(pa.nulls(self.images.n, f.type))
        self.ready.append(pa.RecordBatch.from_arrays(columns, schema=schema))
        self.meta = {n: [] for n in META}
        self.images, self.old = columnar.Images(table, plans=self.images.plans), columnar.Images(table, plans=self.old.plans)


@dataclass
class FilePart(InputPartition):
    file: str
    file_ord: int
    start: int = 4
    end: int | None = None
    first_txn: int = 1


@dataclass
class SplitPart(InputPartition):
    """A piece of a file whose splits are wanted: from the first end of a transaction behind ``start`` to that behind ``end``."""

    file: str
    file_ord: int
    split: int
    start: int
    end: int


@dataclass
class RunOfParts(InputPartition):
    """Consecutive parts that one task reads, one after another."""

    parts: list[InputPartition]


def _in_runs(parts: list[InputPartition]) -> list[InputPartition]:
    n = -(-len(parts) // MAX_PARTITIONS)
    return parts if n <= 1 else [RunOfParts(parts[i : i + n]) for i in range(0, len(parts), n)]


@dataclass
class StreamPart(InputPartition):
    """What is new of a file: its size, and whether it was finished, before and now."""

    file: str
    file_ord: int
    size: int
    was_finished: bool
    end: int
    finished: bool


def _settings(options: dict[str, str]) -> Settings:
    get = {k.lower(): v for k, v in options.items()}.get
    out = Settings(get("mode", "events"), json.loads(get("columns", "null")), get("verifychecksum", "true") == "true", None, get("table"), get("complete", "false") == "true")
    if out.mode == "rows" and not out.table:
        raise ValueError("mode rows needs the option table")
    return out


def _schema_of(settings: Settings) -> str:
    if settings.mode == "rows":
        raise ValueError("mode rows reads into a given schema: spark.read.format('binlog').schema(...)")
    return {"events": EVENT_SCHEMA, "splits": SPLIT_SCHEMA}.get(settings.mode, CHANGE_SCHEMA)


def _batches(rows: Iterator[list[tuple]], settings: Settings) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, _ARROW[t]) for n, t in (f.split(" ") for f in _schema_of(settings).split(", "))])
    heavy = [schema.names.index(n) for n in (("payload",) if settings.mode == "events" else ("before", "after"))]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) if held else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for more in rows:
        held += more
        size += sum(len(r[i] or b"") for r in more for i in heavy)
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _rows_of(parser: FileParser, f: Any, start: int = 4, end: int | None = None, own: bool = True, final: bool = True) -> Iterator[list[tuple]]:
    frames, end = Frames(f, parser.format_tail, own), size_of(f) if end is None else end
    if start > 4:
        parser.learn(frames, end)
    for pos, event, whole in frames.between(start, end, final):
        yield parser.rows(pos, event, whole)


@contextmanager
def _opened(file: str, length: int = CHUNK) -> Iterator[io.BufferedReader]:
    """``length``: of what is going to be read; a short split reads no long buffers."""
    store, path = store_of(file)
    with store.open_input_file(path) as raw, io.BufferedReader(raw, min(max(length, WINDOW), CHUNK)) as f:
        yield f


def _typed(parser: TypedParser, f: Any, start: int, end: int, own: bool = True) -> Iterator[pa.RecordBatch]:
    for found in _rows_of(parser, f, start, end, own):
        for problem in found:
            parser.problem(problem)
        if parser.full():
            parser.close()
        yield from parser.ready
        parser.ready.clear()
    parser.close()
    yield from parser.ready


def _read_part(part: FilePart, settings: Settings) -> Iterator[pa.RecordBatch]:
    with _opened(part.file, CHUNK if part.end is None else part.end - part.start) as f:
        if settings.mode == "rows":
            end = size_of(f) if part.end is None else part.end
            if settings.complete:
                walker = FileParser(part.file, part.file_ord, settings)
                walker.learn(Frames(f, walker.format_tail), end)
                end = _walked(f, Place(part.start), end, True, walker).pos
            yield from _typed(TypedParser(part.file, part.file_ord, settings, part.first_txn), f, part.start, end)
            return
        yield from _batches(_rows_of(FileParser(part.file, part.file_ord, settings, part.first_txn), f, part.start, part.end), settings)


def transaction_end(f: Any, at: int, end: int, parser: FileParser) -> int:
    """The first place at or behind ``at`` where a transaction has just ended, found from there on; ``end`` where there is none.

    It looks for a header that fits and whose event's checksum is right (without checksums: behind whose event the next header fits), and goes on from there.
    """
    if at <= 4:
        return 4
    frames, start = Frames(f, parser.format_tail), at
    while (start := next_header(f, start, end)) is not None:
        f.seek(start)
        length = int.from_bytes(f.read(codec.HEADER_SIZE)[9:13], "little")
        if start + length <= end:
            f.seek(start)
            event = f.read(length)
            if codec.crc_matches(event) if parser.format.tail() else start + length == end or next_header(f, start + length, start + length + codec.HEADER_SIZE) is not None:
                break
        start += 1
    if start is None:
        return end
    for pos, event, whole in frames.between(start, end):
        # An end for certain, whatever came before: a statement is one only outside of a transaction.
        if whole and event[4] in (16, 38, codec.PAYLOAD) and parser.passed(event, True):
            return pos + len(event)
    return end


def _read_split(part: SplitPart, settings: Settings) -> Iterator[pa.RecordBatch]:
    with _opened(part.file, part.end - part.start) as f:
        size = size_of(f)
        parser = FileParser(part.file, part.file_ord, settings)
        parser.learn(Frames(f, parser.format_tail), size)
        start, stop = (transaction_end(f, at, size, parser) if at < size else size for at in (part.start, part.end))
        parser.txn_no, parser.inside = 0, False
        if start < stop:
            for _, event, whole in Frames(f, parser.format_tail).between(start, stop):
                parser.passed(event, whole)
        row = [part.file, part.file_ord, part.split, start, stop, parser.txn_no]
        schema = pa.schema([(n, _ARROW[t]) for n, t in (x.split(" ") for x in SPLIT_SCHEMA.split(", "))])
        yield pa.RecordBatch.from_arrays([pa.array([v], x.type) for v, x in zip(row, schema, strict=True)], schema=schema)


def _typed_schema(settings: Settings, schema: Any) -> pa.Schema | None:
    return to_arrow_schema(schema) if settings.mode == "rows" else None


class BinlogReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: Any = None) -> None:
        self.files, self.settings = log_files(options["path"]), _settings(options)
        self.settings.schema = _typed_schema(self.settings, schema)
        get = {k.lower(): v for k, v in options.items()}.get
        self.split_bytes, self.splits = int(get("splitbytes", SPLIT_BYTES)), _unpacked(get("splits"))

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("event_type",):
                self.settings.types = (self.settings.types or {f.value}) & {f.value}
            elif isinstance(f, In) and f.attribute == ("event_type",):
                self.settings.types = set(f.value) & self.settings.types if self.settings.types is not None else set(f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.settings.mode == "splits":
            sizes = [size_on_disk(f) for f in self.files]
            return _in_runs([SplitPart(f, i, k, at, at + self.split_bytes) for i, (f, n) in enumerate(zip(self.files, sizes, strict=True)) for k, at in enumerate(range(0, max(n, 1), self.split_bytes))])
        if self.splits is not None:
            return _in_runs([FilePart(file, file_ord, start, stop, first) for file, file_ord, start, stop, first in self.splits])
        return [FilePart(f, i) for i, f in enumerate(self.files)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, RunOfParts):
            for part in partition.parts:
                yield from self.read(part)
        else:
            yield from _read_split(partition, self.settings) if isinstance(partition, SplitPart) else _read_part(partition, self.settings)


def size_on_disk(file: str) -> int:
    store, path = store_of(file)
    return store.get_file_info(path).size or 0


def _packed(splits: list[tuple]) -> str:
    return base64.b64encode(zlib.compress(json.dumps(splits).encode())).decode()


def _unpacked(text: str | None) -> list[list] | None:
    return None if text is None else json.loads(zlib.decompress(base64.b64decode(text)))


def _stem(file: str) -> str:
    """A file's name up to its last number: log.000001 and log.000002 are one log."""
    return re.sub(r"\d+(?=\D*$)", "", file)


class BinlogStreamReader(DataSourceStreamReader):
    """Offsets are {file: [size, finished]} for the files that exist; see the module's docstring."""

    def __init__(self, options: dict[str, str], schema: Any = None) -> None:
        get = {k.lower(): v for k, v in options.items()}.get
        self.path, self.settings, self.state = options["path"], _settings(options), get("statelocation")
        self.settings.schema = _typed_schema(self.settings, schema)
        self.finish_after = float(get("finishafter")) if get("finishafter") else None

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        files, now = log_files(self.path), time.time()
        newest = {_stem(f): f for f in files}
        out = {}
        for file in files:
            store, path = store_of(file)
            info = store.get_file_info(path)
            finished = SINK_FILE.search(file) is not None or newest[_stem(file)] != file
            finished |= self.finish_after is not None and now - (info.mtime_ns or 0) / 1e9 >= self.finish_after
            out[file] = [info.size or 0, finished]
        return out

    def partitions(self, start: dict, end: dict) -> list[StreamPart]:
        # JSON objects come back in any order: sink files are ordered by the manifests, others by name.
        order = {f: i for i, f in enumerate(log_files(self.path))}
        files = sorted(end, key=lambda f: (order.get(f, -1), f))
        out = []
        for i, f in enumerate(files):
            (size, was), (now, finished) = start.get(f, [0, False]), end[f]
            if now > size or (finished and not was):
                out.append(StreamPart(f, i, size, was, max(now, size), finished))
        return out

    def read(self, partition: StreamPart) -> Iterator[pa.RecordBatch]:
        return _follow(partition, self.settings, self.state)

    def commit(self, end: dict) -> None:
        """States of sizes before the committed ones are no longer needed."""
        if not self.state:
            return
        store, folder = store_of(self.state)
        if store.get_file_info(folder).type != stores.FileType.Directory:
            return
        sizes = {_key(f): size for f, (size, _) in end.items()}
        for info in store.get_file_info(stores.FileSelector(folder)):
            key, _, size = info.base_name.removesuffix(".json").partition("-")
            if key in sizes and size.isdigit() and int(size) < sizes[key]:
                store.delete_file(info.path)


def _key(file: str) -> str:
    return hashlib.md5(file.encode(), usedforsecurity=False).hexdigest()


@dataclass
class Place:
    """Where a transaction has just ended, the number of the next one, and whether headers had their own end positions up to there."""

    pos: int = 4
    txn_no: int = 1
    own: bool = True


def _place_at(f: Any, part: StreamPart, parser: FileParser, state: str | None) -> Place:
    """Up to where a file of the batch before has been read: as its task left it, or by walking the headers."""
    if not part.size:
        return Place()
    if state:
        store, folder = store_of(state)
        path = f"{folder.rstrip('/')}/{_key(part.file)}-{part.size}.json"
        if store.get_file_info(path).type == stores.FileType.File:
            with store.open_input_stream(path) as saved:
                place = Place(**json.loads(saved.read()))
            return Place(part.size, place.txn_no, place.own) if part.was_finished else place
    place = _walked(f, Place(), part.size, part.was_finished, parser)
    return Place(part.size, place.txn_no, place.own) if part.was_finished else place


def _walked(f: Any, start: Place, end: int, final: bool, parser: FileParser) -> Place:
    """The last end of a transaction before ``end``, or of a file (a rotation), by the headers and statements alone."""
    parser.txn_no, parser.inside = start.txn_no, False
    frames, out = Frames(f, parser.format_tail, start.own), start
    for pos, event, whole in frames.between(start.pos, end, final):
        if parser.passed(event, whole) or (whole and event[4] in (3, 4) and not parser.inside):
            out = Place(pos + len(event), parser.txn_no, frames.own)
    return out


def _follow(part: StreamPart, settings: Settings, state: str | None) -> Iterator[pa.RecordBatch]:
    with _opened(part.file) as f:
        walker = FileParser(part.file, part.file_ord, settings)
        walker.learn(Frames(f, walker.format_tail), part.end)
        start = _place_at(f, part, walker, state)
        stop = _walked(f, start, part.end, part.finished, walker)
        until = part.end if part.finished else stop.pos
        if until > start.pos:
            kind = TypedParser if settings.mode == "rows" else FileParser
            parser = kind(part.file, part.file_ord, settings, start.txn_no)
            yield from _typed(parser, f, start.pos, until, start.own) if settings.mode == "rows" else _batches(_rows_of(parser, f, start.pos, until, start.own), settings)
        if state:
            store, folder = store_of(state)
            store.create_dir(folder, recursive=True)
            path = f"{folder.rstrip('/')}/{_key(part.file)}-{part.end}.json"
            publish(store, path, vars(stop))


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote; no file where it had no rows."""

    partition: int
    file: str | None


class BinlogWriter(DataSourceWriter):
    """Writes rows as changes, ``batch`` rows to a transaction, one file for each partition that has rows.

    Options: ``db``, ``table``, ``primaryKey`` (comma-separated), ``eventTime`` (a column), ``op``: a column with I, U or D (without it, rows are
    inserts), which isn't written; ``beforePrefix``: columns of this prefix hold a row before its update. Without them, the image before an update
    has the key only. ``compress`` = true packs each transaction; ``gtids`` = true gives transactions global identities: each partition of a job is a server.
    """

    def __init__(self, options: dict[str, str], schema: Any, overwrite: bool = False) -> None:
        get = {k.lower(): v for k, v in options.items()}.get
        self.path, self.db, self.table, self.time, self.batch = options["path"], get("db", "db"), get("table", "t"), get("eventtime"), int(get("batch", "100"))
        self.job, self.overwrite = uuid.uuid4().hex, overwrite
        self.op, prefix = get("op"), get("beforeprefix")
        self.compress, self.gtids = get("compress", "false") == "true", get("gtids", "false") == "true"
        self.fields = schema.names
        own = [f for f in schema.fields if f.name != self.op and not (prefix and f.name.startswith(prefix))]
        self.names, self.types = [f.name for f in own], [f.dataType.simpleString() for f in own]
        self.keys = [self.names.index(k) for k in (get("primarykey", "") or "").split(",") if k]
        self.old = [prefix + n if prefix and prefix + n in self.fields else None for n in self.names]

    def _folder(self) -> tuple[stores.FileSystem, str]:
        store, folder = store_of(self.path)
        return store, folder.rstrip("/")

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        from .binlog_writer import LogWriter, column_for

        context = TaskContext.get()
        store, folder = self._folder()
        name = f"log-{self.job}-{context.partitionId()}-{context.taskAttemptId()}"
        columns = [column_for(t) for t in self.types]
        place = {n: i for i, n in enumerate(self.fields)}
        at, before_at = [place[n] for n in self.names], [place[o] if o else None for o in self.old]
        op_at, time_at = place.get(self.op), place.get(self.time)
        whole, key_only = [True] * len(columns), [i in self.keys for i in range(len(columns))]
        sid = uuid.uuid5(uuid.UUID(self.job), str(context.partitionId())) if self.gtids else None
        iterator = iter(iterator)
        first = next(iterator, None)
        if first is None:
            return Written(context.partitionId(), None)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}") as f:
            log, rows, n = LogWriter(f), [first], 0

            def flush() -> None:
                nonlocal rows, n
                if rows:
                    n += 1
                    when = rows[-1][time_at] if time_at is not None else None
                    seconds = int(when.replace(tzinfo=dt.timezone.utc).timestamp()) if when else 0
                    log.transaction(seconds, n - 1, n, [(self.db, self.table, self.names, columns, self.keys, list(map(change, rows)))], sid, n, self.compress)
                    rows = []

            def change(row: Any) -> tuple:
                op, own = row[op_at] if op_at is not None else "I", [row[i] for i in at]
                if op == "I":
                    return op, None, own
                if op == "D":
                    return op, own, None
                if any(i is not None for i in before_at):
                    return op, [row[i] if i is not None else row[j] for i, j in zip(before_at, at, strict=True)], own
                return op, own, own, key_only if any(key_only) else whole, whole

            if len(rows) >= self.batch:
                flush()
            for row in iterator:
                rows.append(row)
                if len(rows) >= self.batch:
                    flush()
            flush()
        return Written(context.partitionId(), name)

    def _own_files(self) -> list[str]:
        store, folder = self._folder()
        if store.get_file_info(folder).type != stores.FileType.Directory:
            return []
        return [f.path for f in store.get_file_info(stores.FileSelector(folder)) if f.base_name.startswith(f"log-{self.job}-")]

    def commit(self, messages: list[Written | None]) -> None:
        """Publish the files of the tasks that counted; remove what other attempts left."""
        store, folder = self._folder()
        files = [m.file for m in sorted((m for m in messages if m), key=lambda m: m.partition) if m.file]
        where = f"{folder}/{MANIFESTS}"
        store.create_dir(where, recursive=True)
        listed = [f for f in store.get_file_info(stores.FileSelector(where)) if f.base_name.endswith(".json")]
        number = max((int(f.base_name.split("-")[0]) for f in listed), default=0) + 1
        replaced = [f.path for f in store.get_file_info(stores.FileSelector(folder)) if f.type == stores.FileType.File and not f.base_name.startswith((f"log-{self.job}-", "_", "."))] if self.overwrite else []
        publish(store, f"{where}/{number:012d}-{self.job}.json", {"replaces": self.overwrite, "files": files})
        for path in self._own_files():
            if path.rsplit("/", 1)[1] not in files:
                store.delete_file(path)
        for path in [*replaced, *(f.path for f in listed if self.overwrite)]:
            store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = self._folder()
        for path in self._own_files():
            store.delete_file(path)


def publish(store: stores.FileSystem, path: str, content: dict) -> None:
    """Write a small file so that it is there whole or not at all."""
    folder, name = path.rsplit("/", 1)
    partial = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(partial) as f:
        f.write(json.dumps(content).encode())
    store.move(partial, path)


class BinlogDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "binlog"

    def schema(self) -> str:
        return _schema_of(_settings(self.options))

    def reader(self, schema: Any) -> BinlogReader:
        return BinlogReader(dict(self.options), schema)

    def streamReader(self, schema: Any) -> BinlogStreamReader:  # noqa: N802
        return BinlogStreamReader(dict(self.options), schema)

    def writer(self, schema: Any, overwrite: bool) -> BinlogWriter:
        return BinlogWriter(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BinlogDataSource)


def load(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, schema: Any = None, **options: str) -> DataFrame:
    """The log as ``spark.read.format("binlog")`` gives it, with files of more than ``split_bytes`` cut into that many partitions.

    One number for each split comes to the driver.
    """
    register(spark)
    reader = spark.read.format("binlog").options(**options)
    reader = reader if schema is None else reader.schema(schema)
    if all(size_on_disk(f) <= split_bytes for f in log_files(path)):
        return reader.load(path)
    found = spark.read.format("binlog").options(**options).option("mode", "splits").option("splitBytes", split_bytes).load(path)
    splits, at = [], {}
    for r in sorted(found.collect(), key=lambda r: (r.file_ord, r.split)):
        first = at.get(r.file_ord, 1)
        if r.start < r.stop:
            splits.append((r.file, r.file_ord, r.start, r.stop, first))
        at[r.file_ord] = first + r.n_ends
    return reader.option("splits", _packed(splits)).load(path)


def table_rows(spark: SparkSession, path: str, table: str, schema: str, split_bytes: int = SPLIT_BYTES, meta: Iterable[str] = tuple(META), **options: str) -> DataFrame:
    """The rows of one table ("db.table") of a log in typed columns; ``schema``: "name type, ..." of its columns (and _before_ columns). ``meta``: which of ``META`` follow."""
    fields = ", ".join([schema, *(f"{n} {META[n]}" for n in meta)])
    return load(spark, path, split_bytes, fields, mode="rows", table=table, **options)


def read_log(spark: SparkSession, path: str, mode: str = "events", columns: dict[str, list[str]] | None = None) -> DataFrame:
    """The same rows through Spark's ``binaryFile`` reader: for stores that only Spark opens. Files are ordered by name."""
    settings = Settings(mode, columns)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = files.select("path").distinct().withColumn("file_ord", F.row_number().over(Window.orderBy("path")) - 1)  # one row for each file

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, number, content in zip(*(batch.column(c) for c in ("path", "file_ord", "content")), strict=True):
                f = io.BytesIO(content.as_buffer())
                yield from _batches(_rows_of(FileParser(path.as_py(), number.as_py(), settings), f), settings)

    return files.join(names, "path").select("path", "file_ord", "content").mapInArrow(parse, _schema_of(settings))
