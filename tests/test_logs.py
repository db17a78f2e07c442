"""Log files through the source, in batch and as a stream, and streaming commits."""

from __future__ import annotations

import datetime as dt
import json
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo

from ledgerloom.functions.codec import TYPE_CODES, Column
from ledgerloom.operators import gtid, metrics, routing, transactions, versions
from ledgerloom.plans import replay
from ledgerloom.sources import binlog
from ledgerloom.sources.binlog_writer import LogWriter
from ledgerloom.streaming import commits
from ledgerloom.streaming.progress import ProgressTable

COLUMNS = [Column(TYPE_CODES["int"]), Column(TYPE_CODES["blob"], 2)]


def _write(path, transactions, start=1):  # noqa: ANN001, ANN202
    with open(path, "wb") as f:
        log = LogWriter(f)
        for i, (seconds, rows) in enumerate(transactions, start):
            by = {}
            for table, op, before, after in rows:
                by.setdefault(table, []).append((op, before, after))
            log.transaction(seconds, i - 1, i, [("d", t, ["id", "v"], COLUMNS, [0], r) for t, r in by.items()])
        return log


ONE = [(100, [("a", "I", None, [1, "x"]), ("b", "I", None, [1, "y"])]), (101, [("a", "U", [1, "x"], [1, "z"])])]
TWO = [(102, [("b", "D", [1, "y"], None)]), (103, [("c", "I", None, [5, "q"])])]


def test_replay_of_two_files(spark, tmp_path) -> None:  # noqa: ANN001
    _write(tmp_path / "log.1", ONE)
    _write(tmp_path / "log.2", TWO)
    groups = routing.table_groups(spark, [["d.a"], ["d.b"]])
    for mode in replay.MODES:
        r = replay.replay_log(spark, str(tmp_path), groups, mode)
        assert [(x.tbl, x.after) for x in r.latest().collect()] == [("d.a", '{"id": 1, "v": "z"}')]
        assert r.versions().where("tbl = 'd.b'").count() == 2
    r = replay.replay_log(spark, str(tmp_path), groups)
    assert {x.group_id: (x.last_txn, x.n_rows) for x in r.high_water().collect()} == {0: (4, 2), 1: (4, 2)}
    assert replay.register_views(r, {"d.a": (spark.createDataFrame([], "id int, v string").schema, ["id"])}, prefix="re_") == ["re_a"]
    assert spark.sql("SELECT v FROM re_a").first().v == "z"
    assert replay.clock_metrics(spark.read.format("binlog").load(str(tmp_path))).agg(F.sum("n_txns")).first()[0] == 4
    r.save(str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 4


def test_filters_reach_the_source(spark, tmp_path) -> None:  # noqa: ANN001
    _write(tmp_path / "log.1", ONE)
    binlog.register(spark)
    df = spark.read.format("binlog").load(str(tmp_path)).where("event_type = 16")
    assert df.count() == 2
    # A filter that the source takes over is not applied again above it.
    assert "= 16" not in df._jdf.queryExecution().optimizedPlan().toString()
    reader = binlog.BinlogReader({"path": str(tmp_path)})
    assert list(reader.pushFilters([EqualTo(("event_type",), 16), EqualTo(("pos",), 4)])) == [EqualTo(("pos",), 4)] and reader.settings.types == {16}
    assert sum(b.num_rows for part in reader.partitions() for b in reader.read(part)) == 2
    assert spark.read.format("binlog").load(str(tmp_path)).where("event_type IN (16, 34)").count() == 4


def _read(spark, path, mode="changes"):  # noqa: ANN001, ANN202
    binlog.register(spark)
    return sorted(spark.read.format("binlog").option("mode", mode).load(str(path)).collect(), key=lambda r: (r.file_ord, r.pos))


def test_every_damage_is_a_row(spark, tmp_path) -> None:  # noqa: ANN001
    whole = tmp_path / "whole" / "log.1"
    whole.parent.mkdir()
    _write(whole, [*ONE, *TWO])
    data, events = whole.read_bytes(), _read(spark, whole.parent, "events")
    rows = [r for r in events if r.type_name == "WRITE_ROWS"]

    def damaged(name: str, change) -> list:  # noqa: ANN001
        folder = tmp_path / name
        folder.mkdir()
        raw = bytearray(data)
        change(raw)
        (folder / "log.1").write_bytes(raw)
        both = spark.read.format("binlog").option("mode", "changes").load(str(folder)).collect(), binlog.read_log(spark, str(folder / "log.*"), "changes").collect()
        assert sorted(map(str, (r[1:] for r in both[0]))) == sorted(map(str, (r[1:] for r in both[1])))
        return sorted(both[0], key=lambda r: (r.pos, r.row_ord))

    def problems(found: list) -> list:
        return [(r.pos, r.problem) for r in found if r.problem]

    good = damaged("none", lambda raw: None)
    assert problems(good) == [] and len(good) == 5
    # A byte of rows: the checksum tells. A changed length: reading goes on at the next header.
    found = damaged("body", lambda raw: raw.__setitem__(rows[0].pos + 30, raw[rows[0].pos + 30] ^ 255))
    assert problems(found) == [(rows[0].pos, "checksum")] and len(found) == 5
    for wrong in (3, 10_000_000, rows[0].event_len + 5):
        found = damaged(f"length{wrong}", lambda raw, wrong=wrong: raw.__setitem__(slice(rows[0].pos + 9, rows[0].pos + 13), wrong.to_bytes(4, "little")))
        assert problems(found)[0][0] == rows[0].pos and len([r for r in found if not r.problem]) >= 3
    found = damaged("tail", lambda raw: raw.__delitem__(slice(len(raw) - 10, None)))
    assert problems(found) == [(events[-1].pos, "damaged length, or cut off")] and len(found) == 6
    # Without its table map, an event's rows can't be read.
    maps = [r for r in events if r.type_name == "TABLE_MAP"]
    found = damaged("map", lambda raw: raw.__setitem__(maps[0].pos + 25, raw[maps[0].pos + 25] ^ 255))
    assert problems(found) == [(maps[0].pos, "checksum"), (rows[0].pos, "rows without a table map")]
    assert [r.corrupt for r in _read(spark, tmp_path / "map", "events")].count(True) == 1


def test_events_whose_rows_are_not_read(spark, tmp_path) -> None:  # noqa: ANN001
    with open(tmp_path / "log.1", "wb") as f:
        log = LogWriter(f)
        log.event(39, 100, b"partial")
        log.event(99, 100, b"new")
    assert [(r.op, r.problem) for r in _read(spark, tmp_path)] == [(None, "rows of PARTIAL_UPDATE_ROWS are not read"), (None, "unknown event type 99")]
    assert [(r.event_type, r.unsupported, r.corrupt) for r in _read(spark, tmp_path, "events")][1:] == [(39, True, False), (99, False, True)]
    assert {r.problem for r in replay.replay_log(spark, str(tmp_path), routing.table_groups(spark, [["d.a"]])).problems.collect()} == {"rows of PARTIAL_UPDATE_ROWS are not read", "unknown event type 99"}


def test_keys_that_change_and_images_that_leave_columns_out(spark, tmp_path) -> None:  # noqa: ANN001
    names, columns = ["id", "v", "w"], [COLUMNS[0], COLUMNS[1], COLUMNS[1]]
    key, some = [True, False, False], [False, False, True]
    with open(tmp_path / "log.1", "wb") as f:
        log = LogWriter(f)

        def write(n: int, *changes: tuple) -> None:
            log.transaction(100 + n, n - 1, n, [("d", "a", names, columns, [0], list(changes))])

        write(1, ("I", None, [1, "x", "p"]), ("I", None, [2, "y", None]))
        write(2, ("U", [1, "x", "p"], [7, "x", "p"]))  # the key changes
        write(3, ("U", [2, None, None], [None, None, "q"], key, some))  # only w is written
        write(4, ("U", [7, None, None], [None, None, None], key, some))  # w becomes NULL
        write(5, ("D", [2, "y", "q"], None), ("I", None, [2, "z", None]))
        write(6, ("I", None, [3, None, "r"]))
    got = _read(spark, tmp_path)
    assert [(r.op, r.pk, r.before, r.after) for r in got if r.txn_no in (2, 3)] == [
        ("D", '{"id": 1}', '{"id": 1, "v": "x", "w": "p"}', None),
        ("I", '{"id": 7}', None, '{"id": 7, "v": "x", "w": "p"}'),
        ("U", '{"id": 2}', '{"id": 2}', '{"w": "q"}'),
    ]
    r = replay.replay_log(spark, str(tmp_path), routing.table_groups(spark, [["d.a"]]))
    rows = {x.pk: (x.v, x.w) for x in versions.live(versions.latest_columns(r.changes, ["v", "w"])).collect()}
    assert rows == {'{"id": 7}': ("x", None), '{"id": 2}': ("z", None), '{"id": 3}': (None, "r")}
    assert r.problems.count() == 0


def test_schema_changes_are_transactions(spark, tmp_path) -> None:  # noqa: ANN001
    binlog.register(spark)
    with open(tmp_path / "log.1", "wb") as f:
        log = LogWriter(f)
        log.transaction(100, 0, 1, [("d", "a", ["id", "v"], COLUMNS, [0], [("I", None, [1, "x"])])])
        log.gtid(101, 1, 2)
        log.event(2, 101, bytes(8) + b"\0\0\0\0\0\0ALTER TABLE a ADD COLUMN w INT")
        log.transaction(102, 2, 3, [("d", "a", ["id", "v"], COLUMNS, [0], [("U", [1, "x"], [1, "y"])])])
    events = spark.read.format("binlog").load(str(tmp_path))
    sizes = {r.txn_seq: r.n_events for r in transactions.summary(transactions.complete_only(transactions.assemble(events))).collect()}
    assert sizes == {1: 6, 2: 2, 3: 5}  # the first has the format description
    assert {r.txn_no: r["count"] for r in transactions.by_logical_clock(events).groupBy("txn_no").count().collect()} == {1: 5, 2: 2, 3: 5}
    r = replay.replay_log(spark, str(tmp_path), routing.table_groups(spark, [["d.a"]]))
    assert [(x.txn_seq, x.n_rows) for x in r.grid().orderBy("txn_seq").collect()] == [(1, 1), (2, 0), (3, 1)]


def test_sink_writes_all_three_operations(spark, tmp_path) -> None:  # noqa: ANN001
    binlog.register(spark)
    schema = "op string, id int, v string, old_v string, at timestamp_ntz"
    t = dt.datetime(2024, 5, 1, 10)
    df = spark.createDataFrame([("I", 1, "a", None, t), ("U", 1, None, "a", t), ("D", 1, None, None, t), ("I", 2, "é", None, t)], schema).coalesce(1)
    for name, more in (("whole", {"beforePrefix": "old_"}), ("key", {})):
        out = df if more else df.drop("old_v")
        out.write.format("binlog").options(db="d", table="a", primaryKey="id", op="op", eventTime="at", batch="3", **more).mode("append").save(f"file://{tmp_path}/{name}")
        got = _read(spark, f"file://{tmp_path}/{name}")
        assert [(r.op, r.txn_no) for r in got] == [("I", 1), ("U", 1), ("D", 1), ("I", 2)] and all(r.problem is None for r in got)
        before = '{"id": 1, "v": "a", "at": "2024-05-01 10:00:00"}' if more else '{"id": 1}'
        assert got[1].before == before and got[1].after == '{"id": 1, "v": null, "at": "2024-05-01 10:00:00"}' and got[3].pk == '{"id": 2}'


def test_stream_equals_batch(spark, tmp_path) -> None:  # noqa: ANN001
    binlog.register(spark)
    logs = tmp_path / "logs"
    logs.mkdir()
    _write(logs / "log.1", ONE)

    def drain() -> list:
        q = spark.readStream.format("binlog").option("mode", "changes").load(str(logs)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.read.parquet(str(tmp_path / "out")).select("tbl", "op", "after").collect()

    assert len(drain()) == 3
    _write(logs / "log.2", TWO)
    batch = spark.read.format("binlog").option("mode", "changes").load(str(logs)).select("tbl", "op", "after").collect()
    assert sorted(map(str, drain())) == sorted(map(str, batch))


def test_compressed_transactions_equal_plain_ones(spark, tmp_path) -> None:  # noqa: ANN001
    binlog.register(spark)
    for name in ("plain", "packed"):
        (tmp_path / name).mkdir()
        with open(tmp_path / name / "log.1", "wb") as f:
            log = LogWriter(f)
            for i in range(1, 6):
                changes = [("d", t, ["id", "v"], COLUMNS, [0], [("I", None, [i, "x" * 2000]), ("I", None, [i + 10, None])]) for t in "ab"]
                log.transaction(100 + i, i - 1, i, changes, uuid.UUID(int=9), i, compress=name == "packed" and i != 3)
    plain, packed = (_read(spark, tmp_path / n) for n in ("plain", "packed"))
    key = lambda r: (r.txn_no, r.tbl, r.op, r.pk, r.after, r.gtid, r.event_time, r.problem)
    assert sorted(map(key, packed)) == sorted(map(key, plain)) and len(packed) == 20
    assert len({(r.pos, r.row_ord) for r in packed}) == 20 and packed[0].gtid == f"{uuid.UUID(int=9)}:1"
    typed = binlog.table_rows(spark, str(tmp_path / "packed"), "d.b", "id int, v string", 300)
    assert sorted((r["_txn_no"], r.id, r["_row_ord"]) for r in typed.collect()) == sorted((i, i + k, int(k > 0)) for i in range(1, 6) for k in (0, 10))
    events = spark.read.format("binlog").load(str(tmp_path / "packed")).where("event_type = 40").collect()
    assert len(events) == 4 and all(json.loads(r.detail)["compression"] == "zstd" and r.ends_txn and not r.unsupported for r in events)
    # Damage inside a payload whose checksum is right: the rows before it, and a problem.
    with open(tmp_path / "packed" / "log.2", "wb") as f:
        log = LogWriter(f)
        log.event(40, 100, b"\2\1\0\0not packed")
        log.event(40, 100, b"\2\1\7\0never known")
        log.event(40, 100, b"\1\1\x50\0short")
    bad = [r for r in _read(spark, tmp_path / "packed") if r.file_ord == 1]
    assert [r.txn_no for r in bad] == [1, 2, 3] and all(r.problem and r.op is None for r in bad) and "compression 7" in bad[1].problem


def test_prepared_transactions_take_the_place_of_their_commits(spark, tmp_path) -> None:  # noqa: ANN001
    row = lambda i, v: [("d", "a", ["id", "v"], COLUMNS, [0], [("I", None, [i, v])])]
    xid = lambda t: (t.encode(), b"", 1)
    with open(tmp_path / "log.1", "wb") as f:
        log = LogWriter(f)
        log.transaction(1, 0, 1, row(1, "prepared first"), xa=xid("one"))
        log.transaction(2, 1, 2, row(1, "plain"))
        log.transaction(3, 2, 3, row(2, "rolled back"), xa=xid("two"))
        log.transaction(4, 3, 4, row(3, "in the next file"), xa=xid("three"))
        log.statement(5, "XA COMMIT 'one'")
        log.statement(6, "XA ROLLBACK X'74776f',X'',1")
    with open(tmp_path / "log.2", "wb") as f:
        log = LogWriter(f)
        log.statement(7, "XA COMMIT X'7468726565',X'',1")
        log.transaction(8, 0, 1, row(4, "again"), xa=xid("two"))
        log.transaction(9, 1, 2, row(5, "never decided"), xa=xid("four"))
        log.statement(10, "XA COMMIT 'two'")
    r = replay.replay_log(spark, str(tmp_path), routing.table_groups(spark, [["d.a"]]))
    found = {json.loads(x.pk)["id"]: (json.loads(x.after)["v"], x.txn_seq) for x in r.latest().collect()}
    assert found == {1: ("prepared first", 5), 3: ("in the next file", 7), 4: ("again", 10)}
    assert r.versions().where("pk = '{\"id\": 1}'").count() == 2 and r.txns.count() == 10 and r.problems.count() == 0


def test_two_copies_of_a_log_are_replayed_once(spark, tmp_path) -> None:  # noqa: ANN001
    """The second copy begins later and goes on longer; a transaction without an identity is never taken for another."""
    sid = uuid.UUID(int=3)
    for name, numbers in (("log.1", range(1, 8)), ("log.2", range(4, 12))):
        with open(tmp_path / name, "wb") as f:
            log = LogWriter(f)
            log.previous_gtids(1, {sid: [(1, numbers[0] - 1)]} if numbers[0] > 1 else {})
            for n, i in enumerate(numbers, 1):
                log.transaction(100 + i, n - 1, n, [("d", "a", ["id", "v"], COLUMNS, [0], [("I", None, [i, name])])], sid, i)
            log.transaction(200, n, n + 1, [("d", "a", ["id", "v"], COLUMNS, [0], [("I", None, [99, name])])])
    groups = routing.table_groups(spark, [["d.a"]])
    once, both = (replay.replay_log(spark, str(tmp_path), groups, once=o) for o in (True, False))
    assert both.changes.count() == 17 and both.txns.count() == 17
    assert sorted((json.loads(x.after)["id"], json.loads(x.after)["v"]) for x in once.changes.collect()) == sorted([(i, "log.1" if i < 8 else "log.2") for i in range(1, 12)] + [(99, "log.1"), (99, "log.2")])
    assert once.txns.count() == 13
    events = spark.read.format("binlog").load(str(tmp_path))
    assert [tuple(x) for x in gtid.previous(events).collect()] == [(1, str(sid), 1, 3)]


def test_gtid_sets(spark) -> None:  # noqa: ANN001
    rnd = random.Random(4)
    held = [{(s, rnd.randrange(60)) for s in "ab" for _ in range(35)} for _ in range(2)]
    one, two = (gtid.intervals(spark.createDataFrame(sorted(h) * 2, "sid string, gno long"), segment=8) for h in held)
    numbers = lambda df: {(r.sid, n) for r in df.collect() for n in range(r["first"], r["last"] + 1)}
    assert numbers(one) == held[0] and numbers(gtid.union(one.unionByName(two))) == held[0] | held[1]
    assert numbers(gtid.difference(one, two)) == held[0] - held[1] and numbers(gtid.intersection(one, two)) == held[0] & held[1]
    rows = sorted((r.sid, r["first"], r["last"]) for r in one.collect())
    assert all(x[0] != y[0] or x[2] + 1 < y[1] for x, y in zip(rows, rows[1:], strict=False))  # none touch
    assert {r.sid: r.n for r in gtid.size(one).collect()} == {s: sum(x == s for x, _ in held[0]) for s in "ab"}
    inner = {(s, n) for s in "ab" for n in range(min(x for t, x in held[0] if t == s), max(x for t, x in held[0] if t == s))}
    assert numbers(gtid.gaps(one)) == inner - held[0]


def _damages(data: bytes, events: list) -> dict[str, bytes]:
    """A log, and copies of it with a changed body, map, statement or length, with a hole, and cut off."""
    rows = [r for r in events if r.type_name == "WRITE_ROWS"]
    maps = [r for r in events if r.type_name == "TABLE_MAP"]
    ends = [r for r in events if r.type_name == "XID"]

    def changed(at: int, new: bytes) -> bytes:
        return data[:at] + new + data[at + len(new) :]

    flip = lambda at: changed(at, bytes([data[at] ^ 255]))
    out = {"none": data, "body": flip(rows[0].pos + 30), "map": flip(maps[1].pos + 25), "end": flip(ends[1].pos + 20), "end_pos": flip(rows[1].pos + 14), "type": flip(rows[1].pos + 4)}
    out |= {f"length{n}": changed(rows[0].pos + 9, n.to_bytes(4, "little")) for n in (3, 10_000_000, rows[0].event_len + 5, rows[0].event_len + ends[0].event_len)}
    out |= {"hole": changed(maps[2].pos, bytes(200)), "cut": data[:-10], "cut_in_header": data[: events[-1].pos + 7], "format": flip(10)}
    return out


def _more(path) -> bytes:  # noqa: ANN001
    """A log of eight transactions, one of them a schema change, with one open at the end."""
    with open(path, "wb") as f:
        log = LogWriter(f)
        for i in range(1, 8):
            log.transaction(100 + i, i - 1, i, [("d", t, ["id", "v"], COLUMNS, [0], [("I", None, [i, "x" * 40]), ("I", None, [i + 100, None])]) for t in "ab"])
        log.gtid(110, 7, 8)
        log.event(2, 110, bytes(8) + b"\0\0\0\0\0\0ALTER TABLE a ADD COLUMN w INT")
        log.transaction(111, 8, 9, [("d", "a", ["id", "v"], COLUMNS, [0], [("U", [1, "x"], [1, "y"])])])
        log.gtid(112, 9, 10)
        log.event(2, 112, bytes(8) + b"\0\0\0\0\0\0BEGIN")
    return path.read_bytes()


def _tuples(batches) -> list[tuple]:  # noqa: ANN001
    return [tuple(r[k] for k in sorted(r) if k != "file") for b in batches for r in b.to_pylist()]


@pytest.mark.parametrize("mode", ["changes", "replay", "events"])
def test_stream_and_splits_equal_batch_for_every_damage(spark, tmp_path, mode: str) -> None:  # noqa: ANN001
    """The source's reader classes, driven as Spark drives them: any sizes at which a growing file is seen, with and without kept states."""
    (tmp_path / "first").mkdir()
    data = _more(tmp_path / "first" / "log.1")
    damages = _damages(data, _read(spark, tmp_path / "first", "events"))
    rnd = random.Random(mode)
    for name, raw in damages.items():
        file = tmp_path / name / "log.1"
        file.parent.mkdir()
        file.write_bytes(raw)
        options = {"path": str(file.parent), "mode": mode}
        whole = binlog.BinlogReader(options)
        want = _tuples(b for p in whole.partitions() for b in whole.read(p))
        assert want
        # Splits of any length: the rows of one task, and its numbers.
        for split_bytes in (100, 300, 1000):
            parts = [r for b in (binlog.BinlogReader(options | {"mode": "splits", "splitBytes": str(split_bytes)}),) for p in b.partitions() for x in b.read(p) for r in x.to_pylist()]
            splits, first = [], 1
            for r in parts:
                splits += [(r["file"], 0, r["start"], r["stop"], first)] if r["start"] < r["stop"] else []
                first += r["n_ends"]
            if name in ("none", "body"):
                assert len(splits) > 2
            cut = binlog.BinlogReader(options | {"splits": binlog._packed(splits)})
            assert _tuples(b for p in cut.partitions() for b in cut.read(p)) == want, (name, split_bytes)
        # A stream that sees the file at one, two or many sizes, begun anew each time.
        for triggers in (1, 2, 12):
            for kept in (False, True):
                more = {"stateLocation": str(tmp_path / f"state-{name}-{triggers}")} if kept else {}
                sizes = [*sorted(rnd.randrange(len(raw)) for _ in range(triggers - 1)), len(raw)]
                offset, got = {}, []
                for i, size in enumerate(sizes):
                    file.write_bytes(raw[:size])
                    stream = binlog.BinlogStreamReader(options | more | ({"finishAfter": "0"} if i == len(sizes) - 1 else {}))
                    last, offset = offset, stream.latestOffset()
                    assert offset == {str(file): [size, i == len(sizes) - 1]}
                    got += _tuples(b for p in stream.partitions(last, offset) for b in stream.read(p))
                    stream.commit(offset)
                assert got == want, (name, triggers, kept)
                if kept:
                    assert len(list((tmp_path / f"state-{name}-{triggers}").iterdir())) == 1


def test_streams_finish_files_by_their_successors(tmp_path) -> None:  # noqa: ANN001
    data = _more(tmp_path / "log.1")
    (tmp_path / "log.1").write_bytes(data[:-10])
    stream = binlog.BinlogStreamReader({"path": str(tmp_path), "mode": "changes"})
    first = stream.latestOffset()
    rows = lambda a, b: [r for p in stream.partitions(a, b) for x in stream.read(p) for r in x.to_pylist()]
    found = rows({}, first)
    assert len(found) == 29 and not any(r["problem"] for r in found)
    (tmp_path / "other.1").write_bytes(data)  # another log's file doesn't finish it
    assert stream.latestOffset()[str(tmp_path / "log.1")] == first[str(tmp_path / "log.1")]
    (tmp_path / "log.2").write_bytes(data)
    second = stream.latestOffset()
    tail = [r for r in rows(first, second) if r["file"].endswith("log.1")]
    assert [(r["problem"], r["txn_no"]) for r in tail] == [("damaged length, or cut off", 10)]


def test_one_long_file_is_many_partitions(spark, tmp_path) -> None:  # noqa: ANN001
    _more(tmp_path / "log.1")
    _more(tmp_path / "log.2")
    one = binlog.load(spark, str(tmp_path), mode="replay")
    cut = binlog.load(spark, str(tmp_path), 500, mode="replay")
    assert one.rdd.getNumPartitions() == 2 and cut.rdd.getNumPartitions() > 6
    assert sorted(map(str, cut.collect())) == sorted(map(str, one.collect()))
    groups = routing.table_groups(spark, [["d.a"], ["d.b"]])
    latest = [sorted(map(str, replay.replay_log(spark, str(tmp_path), groups, split_bytes=n).latest().drop("file_ord", "pos", "event_ord").collect())) for n in (500, 1 << 20)]
    assert latest[0] == latest[1] and latest[0]


def test_appends_add_and_overwrites_replace(spark, tmp_path) -> None:  # noqa: ANN001
    binlog.register(spark)
    path = str(tmp_path / "sink")
    ids = lambda: sorted(int(json.loads(r.pk)["id"]) for r in _read(spark, path))

    def write(a: int, b: int, mode: str = "append") -> None:
        spark.range(a, b, 1, 3).select(F.col("id").cast("int").alias("id")).write.format("binlog").options(db="d", table="a", primaryKey="id").mode(mode).save(path)

    write(0, 10)
    write(10, 20)
    assert ids() == list(range(20))
    # Files that no manifest lists, as attempts leave them behind, don't count; a database's own files do.
    (tmp_path / "sink" / f"log-{'0' * 32}-0-0").write_bytes(b"left behind")
    _write(tmp_path / "sink" / "binlog.1", [(100, [("a", "I", None, [77, "x"])])])
    assert ids() == [*range(20), 77]
    write(30, 35, "overwrite")
    assert ids() == list(range(30, 35))
    write(0, 0)
    write(50, 51)
    assert ids() == [*range(30, 35), 50]
    assert len([f for f in (tmp_path / "sink").iterdir() if f.is_file()]) == 4


def test_a_failed_job_publishes_nothing(spark, tmp_path) -> None:  # noqa: ANN001
    binlog.register(spark)
    path = str(tmp_path / "sink")
    good = spark.range(5).select(F.col("id").cast("int").alias("id"))
    good.write.format("binlog").options(db="d", table="a", primaryKey="id").mode("append").save(path)
    before = sorted(f.name for f in (tmp_path / "sink").iterdir())
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") < 90, F.col("id")).otherwise(F.raise_error(F.lit("no"))).cast("int").alias("id"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="no"):
            bad.write.format("binlog").options(db="d", table="a", primaryKey="id", batch="1").mode(mode).save(path)
        assert len(_read(spark, path)) == 5
    # A task that is killed while the driver cleans up may leave a file, which no manifest lists.
    assert set(before) <= {f.name for f in (tmp_path / "sink").iterdir()}
    assert len(binlog.log_files(path)) == len([n for n in before if not n.startswith("_")])


def test_attempts_of_one_task_count_once(tmp_path) -> None:  # noqa: ANN001
    """Two attempts of a partition leave a file each: the one whose message the driver got is published."""
    schema = T.StructType.fromDDL("id int")
    writer = binlog.BinlogWriter({"path": str(tmp_path), "db": "d", "table": "a", "primaryKey": "id"}, schema)
    for attempt in (0, 1):
        (tmp_path / f"log-{writer.job}-0-{attempt}").write_bytes((_more(tmp_path / "x")))
    (tmp_path / "x").unlink()
    writer.commit([binlog.Written(0, f"log-{writer.job}-0-1"), None])
    assert [f.rsplit("/", 1)[1] for f in binlog.log_files(str(tmp_path))] == [f"log-{writer.job}-0-1"]
    assert sorted(f.name for f in tmp_path.iterdir()) == ["_manifests", f"log-{writer.job}-0-1"]


def test_commits_wait_for_their_turn(spark, tmp_path) -> None:  # noqa: ANN001
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "group_id int, txn_seq long, event_us long"
    parts = [[(0, 2, 20), (0, 3, 15), (1, 1, 5)], [(0, 1, 10), (1, 3, 9)], [(1, 2, 7), (0, 2, 20)]]

    def run() -> set:
        stream = spark.readStream.schema(schema).parquet(str(src))
        q = commits.ordered_commits(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(out)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(90)
        return {tuple(r) for r in spark.read.schema("group_id int, txn_seq long, commit_us long").parquet(str(out)).collect()}

    spark.createDataFrame(parts[0], schema).coalesce(1).write.mode("append").parquet(str(src))
    assert run() == {(1, 1, 5)}
    for p in parts[1:]:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(src))
    assert run() == {(1, 1, 5), (0, 1, 10), (0, 2, 20), (0, 3, 20), (1, 2, 7), (1, 3, 9)}


def test_waiting_transactions_cost_nothing_until_their_turn(spark, tmp_path) -> None:  # noqa: ANN001
    """Two groups with thousands that wait: a batch writes the entries it adds, and the last one commits all."""
    src, out = tmp_path / "in", tmp_path / "out"
    schema = "group_id int, txn_seq long, event_us long"
    n = 4000

    def run() -> tuple[int, int]:
        stream = spark.readStream.schema(schema).parquet(str(src))
        q = commits.ordered_commits(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(out)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        states = [s for p in q.recentProgress if p.numInputRows for s in p.stateOperators]
        return spark.read.schema(commits.COMMIT_SCHEMA).parquet(str(out)).count(), sum(s.numRowsUpdated for s in states)

    rows = spark.range(2, n + 1).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("group_id"), F.col("id").alias("txn_seq"), (F.col("id") * 10).alias("event_us"))
    rows.coalesce(1).write.mode("append").parquet(str(src))
    assert run()[0] == 0
    spark.createDataFrame([(0, n + 2, 5), (1, n + 5, 5)], schema).coalesce(1).write.mode("append").parquet(str(src))
    count, updated = run()
    assert count == 0 and updated <= 8  # not the thousands that wait
    spark.createDataFrame([(0, 1, 1), (1, 1, 7), (1, 3, 99)], schema).coalesce(1).write.mode("append").parquet(str(src))
    assert run()[0] == 2 * n
    got = spark.read.schema(commits.COMMIT_SCHEMA).parquet(str(out))
    assert got.where(f"txn_seq = {n}").agg(F.max("commit_us")).first()[0] == n * 10 and got.where("group_id = 1 AND txn_seq = 3").first().commit_us == 30


def test_progress_of_streams_is_a_table(spark, tmp_path) -> None:  # noqa: ANN001
    src = tmp_path / "in"
    spark.range(20).write.parquet(str(src))
    with ProgressTable(spark, str(tmp_path / "progress")) as table:
        for name in ("sampled", "again"):
            q = spark.readStream.schema("id long").parquet(str(src)).writeStream.format("noop").queryName(name).trigger(availableNow=True).start()
            q.awaitTermination(60)
    assert table.rows().count() == 0 and {r.name: r.n for r in table.read().groupBy("name").agg(F.sum("n_rows").alias("n")).collect()} == {"sampled": 20, "again": 20}


def test_heartbeats_close_the_windows_of_a_quiet_source(spark, tmp_path) -> None:  # noqa: ANN001
    src, beats, out = (tmp_path / x for x in ("in", "beats", "out"))
    t = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    at = lambda *s: spark.createDataFrame([(t + dt.timedelta(seconds=x),) for x in s], "event_time timestamp").coalesce(1)
    at().write.parquet(str(beats))

    def run() -> list:
        read = lambda p: spark.readStream.schema("event_time timestamp").parquet(str(p))
        stream = commits.throughput(read(src), beats=read(beats))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(out)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(90)
        return sorted((r.window_start.second, r.n_events) for r in spark.read.schema("window_start timestamp, n_events long").parquet(str(out)).collect())

    at(0, 0.5, 1).write.mode("append").parquet(str(src))
    assert run() == []
    at(30).write.mode("append").parquet(str(beats))
    assert run() == [(0, 2), (1, 1)]  # no further event, and no window of the heartbeat's own
    marks = spark.createDataFrame([(0, 5, 100), (1, 3, 50)], "group_id int, last_txn long, commit_us long")
    beat = spark.createDataFrame([(1, 80), (1, 70), (0, 60)], "group_id int, beat_us long")
    assert {r.group_id: r.commit_us for r in commits.quiet_marks(marks, beat).collect()} == {0: 100, 1: 80}


def test_commit_report_by_group(spark, tmp_path) -> None:  # noqa: ANN001
    t = dt.datetime(2024, 1, 1)
    rows = [(0, 1, t), (0, 2, t + dt.timedelta(milliseconds=900)), (0, 3, t + dt.timedelta(seconds=5)), (1, 1, t)]
    report = metrics.commit_report(spark.createDataFrame(rows, "group_id int, txn_seq long, commit_time timestamp_ntz"))
    assert [(r.group_id, r.n_commits, r.last_txn, r.elapsed_s) for r in report.orderBy("group_id", "window_start").collect()] == [(0, 2, 2, 0), (0, 1, 3, 5), (1, 1, 1, 0)]
    metrics.write_report(report, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).where("group_id = 0").count() == 2


def test_upserts_and_throughput_in_batches(spark, tmp_path) -> None:  # noqa: ANN001
    schema = "txn_seq long, event_ord int, row_ord int, tbl string, pk string, op string, event_time timestamp"
    t = dt.datetime(2024, 1, 1)
    apply = commits.upsert_into(str(tmp_path / "state"))
    apply(spark.createDataFrame([(1, 0, 0, "a", "k", "I", t), (2, 0, 0, "a", "l", "I", t)], schema), 0)
    second = spark.createDataFrame([(3, 0, 0, "a", "k", "D", t)], schema)
    apply(second, 1)
    apply(second, 1)
    state = spark.read.schema(schema).parquet(str(tmp_path / "state" / "state-1"))
    apply(spark.createDataFrame([(4, 0, 0, "a", "m", "I", t)], schema), 2)
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["state-1", "state-2"]
    with pytest.raises(Exception, match="state-6"):
        apply(second, 7)  # the state before it is gone
    assert state.count() == 2 and [r.pk for r in commits.current_state(state).collect()] == ["l"]
    assert commits.throughput(spark.createDataFrame([(t,), (t,)], "event_time timestamp")).first().n_events == 2
    assert commits.marks(spark.createDataFrame([(0, 1, 5), (0, 2, 5)], "group_id int, txn_seq long, commit_us long")).first().last_txn == 2
