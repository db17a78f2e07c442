"""Operators of the change log on small hand-made tables, and invariants on random ones."""

from __future__ import annotations

import datetime as dt
import decimal
import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import decimals
from ledgerloom.operators import commit, freshness, logical_clock, metrics, prefix, routing, transactions, versions
from ledgerloom.plans import replay
from ledgerloom.sources import catalog, config, traces

CONFIG = """<root><is_remote>false</is_remote><is_single_group>false</is_single_group><mysql_mode>true</mysql_mode>
<files><file>a.1</file><file>a.2</file></files><parse_pool>8</parse_pool><interval>5</interval>
<group><group_num>2</group_num><group_cfg><pool>5</pool><group_table>d.a</group_table><group_table>d.b</group_table></group_cfg>
<group_cfg><pool>2</pool><group_table>d.c</group_table></group_cfg></group>
<tables><table>a</table><table>b</table></tables>
<query_freqs><query_ferq><freq>700</freq><query_tables>d.a</query_tables><query_tables>d.c</query_tables></query_ferq></query_freqs></root>"""


def _changes(spark, rows):  # noqa: ANN001, ANN202
    schema = "txn_seq long, event_ord int, row_ord int, tbl string, pk string, op string, event_time timestamp_ntz, v int"
    return spark.createDataFrame([(t, e, r, tb, k, op, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), v) for t, e, r, tb, k, op, s, v in rows], schema)


CHANGES = [(1, 0, 0, "a", "k", "I", 10, 1), (1, 0, 1, "a", "l", "I", 10, 2), (2, 0, 0, "b", "k", "I", 11, 3), (3, 0, 0, "a", "k", "U", 12, 4), (3, 1, 0, "a", "k", "U", 12, 5), (4, 0, 0, "a", "l", "D", 13, None), (5, 0, 0, "z", "k", "I", 14, 6)]


@pytest.mark.parametrize("segment", [1, 3, 1000])
def test_running_and_following_equal_plain_windows(spark, segment: int) -> None:  # noqa: ANN001
    df = spark.range(200).select(F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 3).alias("k"), F.col("id").alias("t"), (F.col("id") * 37 % 11).alias("v"))
    w = Window.partitionBy("k").orderBy("t")
    got = prefix.running(df, ["k"], [F.col("t")], F.floor(F.col("t") / segment), {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "n": ("count", F.lit(1))})
    want = df.withColumn("s", F.sum("v").over(w)).withColumn("m", F.max("v").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    after = prefix.following(df, ["k"], [F.col("t")], F.floor(F.col("t") / segment), {"nx": F.col("v")})
    want = df.withColumn("nx", F.lead("v").over(w))
    assert after.exceptAll(want).count() == want.exceptAll(after).count() == 0


def test_versions_latest_and_snapshots(spark) -> None:  # noqa: ANN001
    c = _changes(spark, CHANGES)
    assert {(r.tbl, r.pk): r.v for r in versions.live(versions.latest(c)).collect()} == {("a", "k"): 5, ("b", "k"): 3, ("z", "k"): 6}
    chain = {(r.tbl, r.pk, r.version_no): (r.valid_to, r.is_deleted) for r in versions.versions(c, 2).collect()}
    assert chain["a", "k", 3] == (None, False) and chain["a", "l", 2] == (None, True) and chain["a", "k", 1][0] == dt.datetime(2024, 1, 1, 0, 0, 12)
    at = F.lit(dt.datetime(2024, 1, 1, 0, 0, 11)).cast("timestamp_ntz")
    assert {(r.tbl, r.pk): r.v for r in versions.as_of(c, at).collect()} == {("a", "k"): 1, ("a", "l"): 2, ("b", "k"): 3}
    assert versions.point_as_of(c, "a", F.lit("l"), F.lit(dt.datetime(2025, 1, 1)).cast("timestamp_ntz")).count() == 0
    assert versions.collapse_same_time(c).where("tbl = 'a' AND pk = 'k'").count() == 2


def test_snapshot_is_the_fold_of_changes(spark) -> None:  # noqa: ANN001
    rows = [(i, 0, 0, "t", str(i * 7 % 5), "IUUD"[i * 3 % 4], i // 3, i) for i in range(60)]
    c = _changes(spark, rows)
    for second in (0, 7, 19):
        state = {}
        for t, _, _, _, k, op, s, v in rows:
            if s <= second:
                state[k] = None if op == "D" else v
        at = F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)).cast("timestamp_ntz")
        assert {r.pk: r.v for r in versions.as_of(c, at).collect()} == {k: v for k, v in state.items() if v is not None}


def test_groups_grid_marks(spark) -> None:  # noqa: ANN001
    groups = routing.table_groups(spark, [["a"], ["b"]])
    r = replay.replay_changes(_changes(spark, CHANGES), groups)
    assert [x.tbl for x in routing.unrouted(r.changes, groups).collect()] == ["z"]
    grid = {(x.txn_seq, x.group_id): x.n_rows for x in r.grid().collect()}
    assert len(grid) == 10 and grid[1, 0] == 2 and grid[5, 0] == grid[5, 1] == 0
    assert {x.group_id: x.n_empty for x in commit.empty_transactions(r.grid()).collect()} == {0: 2, 1: 4}
    strict = {x.group_id: x.commit_time.second for x in r.high_water(False).collect()}
    assert strict == {0: 13, 1: 11} and {x.commit_time.second for x in r.high_water().collect()} == {14}
    marks = {(x.group_id, x.txn_seq): x.commit_time for x in r.timeline(False).collect()}
    assert marks[1, 1] is None and marks[1, 5].second == 11
    with pytest.raises(ValueError):
        routing.table_groups(spark, [["a"], ["a"]])
    with pytest.raises(ValueError):
        replay.replay_changes(r.changes, groups, "none")


def test_replay_modes_agree(spark) -> None:  # noqa: ANN001
    c, groups = _changes(spark, CHANGES), routing.table_groups(spark, [["a"], ["b"]])
    states = [sorted(map(tuple, replay.replay_changes(c, groups, m).latest().select("tbl", "pk", "v").collect())) for m in replay.MODES]
    assert states[0] == states[1] == states[2]


def test_assembly_over_files_and_more_than_100_events(spark) -> None:  # noqa: ANN001
    rows = [(0, i, 16 if i in (149, 151) else 30, 1) for i in range(153)] + [(1, i, 16 if i == 2 else 30, 1) for i in range(4)]
    e = spark.createDataFrame(rows, "file_ord int, pos long, event_type int, event_len long")
    done = transactions.assemble(e, segment=F.floor(F.col("pos") / 10))
    assert sorted((r.txn_seq, r.n_events) for r in transactions.summary(transactions.complete_only(done)).collect()) == [(1, 150), (2, 2), (3, 3)]
    assert sorted((r.file_ord, r.pos) for r in transactions.incomplete_tail(done).collect()) == [(0, 152), (1, 3)]
    assert [tuple(r) for r in transactions.crossing_transactions(e).collect()] == [(0, 30)]


def test_many_probes_of_versions_as_of_a_time(spark) -> None:  # noqa: ANN001
    """Against a search for each probe: deletes, equal times, versions whose times go back, a hot key, and clashing names."""
    rnd = random.Random(6)
    t0 = dt.datetime(2024, 1, 1)
    at = lambda: t0 + dt.timedelta(hours=rnd.randrange(24 * 400))
    changes = [(n, 0, 0, "t", rnd.choice([1, 1, 1, 2, 3]), rnd.choice("IUUD"), at(), f"v{n}") for n in range(300)]
    probes = [(i, "t", rnd.choice([1, 2, 3, 9]), rnd.choice([at(), changes[rnd.randrange(300)][6]]), "own") for i in range(400)]
    c = spark.createDataFrame(changes, "txn_seq long, event_ord int, row_ord int, tbl string, pk long, op string, event_time timestamp_ntz, value string").repartition(3)
    p = spark.createDataFrame(probes, "id long, tbl string, pk long, at timestamp_ntz, value string").repartition(3)
    want = {}
    for i, _, pk, when, _ in probes:
        seen = [x for x in changes if x[4] == pk and x[6] <= when]
        newest = max(seen, default=None)
        want[i] = newest[7] if newest and newest[5] != "D" else None
    for days in (1, 30, 10_000):
        found = versions.as_of_join(p, c, ["value"], segment_days=days)
        assert found.columns == ["id", "tbl", "pk", "at", "value", "version"]
        got = {r.id: (r.value, r.version and r.version.value) for r in found.collect()}
        assert got == {i: ("own", v) for i, v in want.items()}


def test_exact_decimals(spark) -> None:  # noqa: ANN001
    d = decimal.Decimal
    rows = [(d("7.00"), d("2.00")), (d("-7.05"), d("2.00")), (d("1.00"), d("3.00")), (d("-1.00"), d("3.00")), (d("5.50"), d("0.00")), (d("99999999999.99"), d("0.01")), (None, d("1.00"))]
    df = spark.createDataFrame(rows, "a decimal(15,2), b decimal(15,2)")
    got = df.select(decimals.divided(F.col("a"), F.col("b"), 4).alias("q"), decimals.remainder(F.col("a"), F.col("b")).alias("r"), decimals.compared(F.col("a"), F.col("b")).alias("c")).collect()
    with decimal.localcontext(decimal.Context(prec=60, rounding=decimal.ROUND_DOWN)):
        assert [r.q for r in got] == [None if a is None or not b else (a / b).quantize(d("0.0001")) for a, b in rows]
        assert [r.r for r in got] == [None if a is None or not b else a % b for a, b in rows]
    assert [r.c for r in got] == [1, -1, -1, -1, 1, 1, None]
    texts = ["12.345", " -7e2x", "+.5", "abc", "", "1e30", None, "3."]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(decimals.from_text(F.col("t"), 10, 2).alias("x")).collect()
    assert [r.x for r in got] == [d("12.35"), d("-700"), d("0.5"), None, None, None, None, d("3")]
    x = spark.createDataFrame([(d("-12.500000000"),), (d("0.000000001"),), (d("18446744073709551616.000000000"),), (d("1200.340000000"),)], "x decimal(38,9)")
    got = x.select(decimals.parts(F.col("x")).alias("p"), decimals.to_long(F.col("x"), True).alias("u"), decimals.integer_digits(F.col("x")).alias("n"), decimals.fraction_digits(F.col("x")).alias("f"), decimals.is_zero(F.col("x")).alias("z")).collect()
    assert [(r.p.quot, r.p.rem) for r in got] == [(-12, -500_000_000), (0, 1), (None, None), (1200, 340_000_000)]
    assert [r.u for r in got] == [None, 0, None, 1200] and [(r.n, r.f, r.z) for r in got] == [(2, 1, False), (0, 9, False), (20, 0, False), (4, 2, False)]
    assert spark.range(1).select(decimals.largest(5, 2).alias("m"), decimals.from_double(F.lit(0.1), 5, 3).alias("d"), decimals.to_double(F.lit(d("1.25"))).alias("f")).first() == (d("999.99"), d("0.100"), 1.25)
    assert decimals.stored_bytes(14, 4) == 7


@pytest.mark.parametrize("shape", ["near", "far", "chain", "few", "gaps"])
def test_levels_of_one_long_file_are_those_of_a_scan(spark, shape: str) -> None:  # noqa: ANN001
    """Segments that refer to the one before, to any earlier number, to the one right before, or to a few far ones; numbers that are missing."""
    rnd = random.Random(shape)
    rows, n = [], 3000
    for f in (0, 1):
        for q in range(1, n + 1):
            if shape == "gaps" and 400 < q < 1100 or rnd.random() < (0.2 if shape == "gaps" else 0):
                continue
            last = {"near": max(0, q - rnd.randint(1, 12)), "far": rnd.randrange(q), "chain": q - 1, "few": rnd.choice([0, q - 1, q // 500 * 500, max(0, q - 60)]), "gaps": max(0, q - rnd.randint(1, 900))}[shape]
            rows.append((f, q, last))
    want, levels = {}, {}
    for f, q, last in rows:
        below = levels.setdefault(f, [])  # (number, highest level so far)
        k = bisect_right(below, (last, 10**9))
        level = 1 + (below[k - 1][1] if k else 0)
        below.append((q, max(level, below[-1][1] if below else 0)))
        want[f, q] = level
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "file_ord int, sequence_number long, last_committed long").repartition(4)
    for segment in (128, 1000, 1 << 16):
        got = {(r.file_ord, r.sequence_number): r.level for r in logical_clock.dependency_levels(df, segment).collect()}
        assert got == want, segment
    groups = {(r.file_ord, r.last_committed): r.commit_group for r in logical_clock.commit_groups(df, 100).collect()}
    assert groups == {(f, x): i for f in (0, 1) for i, x in enumerate(sorted({r[2] for r in rows if r[0] == f}), 1)}
    numbers = {f: sorted(r[1] for r in rows if r[0] == f) for f in (0, 1)}
    before = {(f, q): p for f in (0, 1) for p, q in zip([None, *numbers[f]], numbers[f], strict=False)}
    blocked = {(r.file_ord, r.sequence_number): r.is_blocked for r in logical_clock.blocked(df, 100).collect()}
    assert blocked == {(f, q): before[f, q] is not None and before[f, q] <= last for f, q, last in rows}


def test_logical_clock_boundaries(spark) -> None:  # noqa: ANN001
    kinds = [30, 34, 2, 30, 16, 30, 34, 2, 34, 30, 4]
    e = spark.createDataFrame([(0, i, k) for i, k in enumerate(kinds)], "file_ord int, pos long, event_type int")
    got = sorted((r.txn_no, r.pos) for r in transactions.by_logical_clock(e).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 6), (2, 7), (3, 8), (3, 9), (3, 10)]


def test_dependency_levels_brute_force(spark) -> None:  # noqa: ANN001
    txns = [(f, s * 13 % 7 + max(0, s - 9) if s > 1 else 0, s) for f in (0, 1) for s in range(1, 60)]
    txns = [(f, min(last, s - 1), s) for f, last, s in txns]
    level: dict[tuple[int, int], int] = {}
    for f, last, s in txns:
        level[f, s] = 1 + max([level[f, x] for x in range(1, s) if x <= last], default=0)
    df = spark.createDataFrame(txns, "file_ord int, last_committed long, sequence_number long")
    got = {(r.file_ord, r.sequence_number): r.level for r in logical_clock.dependency_levels(df).collect()}
    assert got == level


def test_sql_tables_and_queries(spark) -> None:  # noqa: ANN001
    find = lambda s: freshness.tables_of_sql(spark, s)
    assert find("SELECT (SELECT max(x) FROM m.s) FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.i IN (SELECT j FROM c))") == ["a", "b", "c", "m.s"]
    assert find("SELECT 1") == []
    high = spark.createDataFrame([(0, dt.datetime(2024, 1, 2)), (1, None)], "group_id int, commit_time timestamp_ntz")
    asked = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), [0]), (2, dt.datetime(2024, 1, 1), [0, 1]), (3, dt.datetime(2024, 1, 3), [0])], "query_id int, query_time timestamp_ntz, groups array<int>")
    assert {r.query_id: r.is_fresh for r in freshness.waits(asked, high).collect()} == {1: True, 2: False, 3: False}


def test_config() -> None:
    c = config.load_config(CONFIG)
    assert c.mode() == "logical_clock" and c.files == ["a.1", "a.2"] and c.groups == [["d.a", "d.b"], ["d.c"]] and c.pools == [5, 2]
    assert c.tables == ["a", "b"] and c.queries[0].freq == 700 and c.group_of("d.c") == 1
    with pytest.raises(KeyError):
        config.load_config(CONFIG.replace("<query_tables>d.c", "<query_tables>d.none"))
    with pytest.raises(ValueError):
        config.load_config(CONFIG.replace("<group_num>2", "<group_num>3"))


def test_catalog_types() -> None:
    kinds = {"int(11)": "int", "int unsigned": "bigint", "bigint(20) unsigned": "decimal(20,0)", "varchar(20)": "string", "decimal(14,4)": "decimal(14,4)", "decimal(65,30)": "string", "datetime(6)": "timestamp_ntz", "longblob": "binary", "tinyint(1)": "tinyint", "enum('a','b')": "string", "double unsigned": "double"}
    assert {k: catalog.spark_type(k).simpleString() for k in kinds} == kinds
    with pytest.raises(ValueError):
        catalog.spark_type("money")


def test_catalog_schemas(spark) -> None:  # noqa: ANN001
    rows = [("d", "t", "a", "int", 1, "PRI"), ("d", "t", "b", "int", 2, "PRI"), ("d", "t", "c", "text", 3, "")]
    columns = spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, column_type string, ordinal_position int, column_key string")
    schema, keys = catalog.table_schemas(columns)["d.t"]
    assert schema.names == ["a", "b", "c"] and keys == ["a", "b"]


def test_traces(spark, tmp_path) -> None:  # noqa: ANN001
    (tmp_path / "x.txt").write_text("5\n9\n")
    (tmp_path / "y.txt").write_text("9\n")
    merged = traces.gaps(traces.read_trace_folder(spark, str(tmp_path)))
    assert sorted((r.arrival, r.tables, r.gap) for r in merged.collect()) == [(5, ["x"], None), (9, ["x", "y"], 4000)]


def test_metrics_text(spark, tmp_path) -> None:  # noqa: ANN001
    e = spark.createDataFrame([("f", 4, "XID", 1, 31, None, None, '{"xid": 3}')], "file string, pos long, type_name string, server_id long, event_len long, db string, tbl string, detail string")
    assert metrics.describe(e).first().description == 'f:4 XID server=1 len=31  {"xid": 3}'
    metrics.write_lines(e.select("pos"), str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).first().value == '{"pos":4}'
