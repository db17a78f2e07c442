"""The incremental version store against one aggregation over all changes."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators import versions
from ledgerloom.streaming.version_store import VersionStore

FIELDS = [("txn_seq", T.LongType()), ("event_ord", T.IntegerType()), ("row_ord", T.IntegerType()), ("tbl", T.StringType()), ("pk", T.LongType()), ("op", T.StringType()), ("event_time", T.TimestampType()), ("value", T.StringType())]
SCHEMA = T.StructType([T.StructField(n, t) for n, t in FIELDS])
T0 = dt.datetime(2024, 1, 1)


def _batches(n: int, size: int) -> list[list[tuple]]:
    rnd = random.Random(n)
    return [[(b * size + i, 0, 0, rnd.choice("ab"), rnd.randrange(50), rnd.choice("IUUD"), T0 + dt.timedelta(seconds=b * size + i), f"v{b}-{i}") for i in range(size)] for b in range(n)]


def _rows(df) -> list[tuple]:  # noqa: ANN001
    return sorted(tuple(r[c] for c in SCHEMA.names) for r in df.collect())


def test_merges_repeats_and_point_reads(spark, tmp_path) -> None:  # noqa: ANN001
    store = VersionStore(spark, str(tmp_path / "store"), SCHEMA, buckets=4, fan=3)
    batches = _batches(11, 20)
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        store.apply(df, number)
        if number in (2, 7):
            store.apply(df, number)  # comes again
            store.apply(spark.createDataFrame(batches[0], SCHEMA), 0)
        every = spark.createDataFrame([r for b in batches[: number + 1] for r in b], SCHEMA)
        if number in (0, 2, 3, 10):
            assert _rows(store.current()) == _rows(versions.live(versions.latest(every)))
    assert [r["level"] for r in store.manifest()["runs"]] == [2, 0, 0] and store.manifest()["batch"] == 10
    # A merge of everything leaves deleted keys out; replaced runs are gone but for those of the last manifests.
    held = [r["name"] for r in store.manifest()["runs"]]
    on_disk = {p.name for p in Path(tmp_path / "store").iterdir() if p.name.startswith("run-")}
    assert set(held) <= on_disk and len(on_disk - set(held)) <= 12
    assert spark.read.parquet(f"{tmp_path}/store/{held[0]}").where("op = 'D'").count() == 0
    for tbl, pk in (("a", 7), ("b", 7), ("a", 999)):
        assert _rows(store.get(tbl, F.lit(pk))) == _rows(store.current().where((F.col("tbl") == tbl) & (F.col("pk") == pk)))
    plan = store.get("a", F.lit(7))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_a_batch_costs_what_it_changes(spark, tmp_path) -> None:  # noqa: ANN001
    store = VersionStore(spark, str(tmp_path / "store"), SCHEMA, buckets=4, fan=8)
    many = spark.range(20_000).select(F.col("id").alias("txn_seq"), F.lit(0).alias("event_ord"), F.lit(0).alias("row_ord"), F.lit("a").alias("tbl"), F.col("id").alias("pk"), F.lit("I").alias("op"), F.lit(T0).alias("event_time"), F.lit("x").alias("value"))
    store.apply(many, 0)
    for number in range(1, 4):
        store.apply(spark.createDataFrame([(10**6 + number, 0, 0, "a", number, "U", T0, "y")], SCHEMA), number)
    assert [r["rows"] for r in store.manifest()["runs"]] == [20_000, 1, 1, 1]
    assert store.current().where("value = 'y'").count() == 3 and store.current().count() == 20_000


def test_what_a_failed_batch_leaves_behind_does_not_count(spark, tmp_path, monkeypatch) -> None:  # noqa: ANN001
    store = VersionStore(spark, str(tmp_path / "store"), SCHEMA, buckets=2)
    one, two = (spark.createDataFrame(b, SCHEMA) for b in _batches(2, 10))
    store.apply(one, 0)
    before = _rows(store.current())
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda manifest: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.apply(two, 1)
    assert _rows(store.current()) == before
    store.apply(two, 1)
    assert _rows(store.current()) == _rows(versions.live(versions.latest(one.unionByName(two))))


def test_of_a_stream(spark, tmp_path) -> None:  # noqa: ANN001
    store = VersionStore(spark, str(tmp_path / "store"), SCHEMA, buckets=2, fan=2)
    batches = _batches(4, 15)
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).writeStream.foreachBatch(store.writer()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    every = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    assert _rows(store.current()) == _rows(versions.live(versions.latest(every))) and store.manifest()["batch"] == 3


def test_versions_older_than_a_delete_that_was_merged(spark, tmp_path) -> None:  # noqa: ANN001
    store = VersionStore(spark, str(tmp_path / "store"), SCHEMA, buckets=4, fan=2)
    batches = _batches(8, 20)
    order = [7, 2, 5, 0, 6, 1, 4, 3]
    for number, b in enumerate(order):
        store.apply(spark.createDataFrame(batches[b], SCHEMA).coalesce(1), number)
    every = versions.latest(spark.createDataFrame([r for b in batches for r in b], SCHEMA))
    assert every.where("op = 'D'").count() > 0
    assert _rows(store.newest()) == _rows(every) and _rows(store.current()) == _rows(versions.live(every))
    for tbl, pk, op in [(r.tbl, r.pk, r.op) for r in every.orderBy("op").limit(2).collect()]:
        assert store.get(tbl, F.lit(pk)).count() == (op != "D")
    # A store of one level has nothing aside but what was deleted.
    assert [r["level"] for r in store.manifest()["runs"]] == [3] and spark.read.parquet(f"{tmp_path}/store/{store.manifest()['runs'][0]['deleted']}").where("op <> 'D'").count() == 0
