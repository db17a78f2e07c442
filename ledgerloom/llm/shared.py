"""Helpers that the training-data operators share: where intermediate tables go, and ordering at scale."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space: the bytes 0x20 and 0x09 to 0x0D.
WHITE = " \t\n\x0b\f\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id wherever documents are ordered: after all others.
LAST_ID = 2**63 - 1
#: Bytes of text for each task that texts are dealt to by hand.
RANGE_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and Spark runs on one machine, as in tests, a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier call returned."""
    return f"{shared_dir(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"


#: With this setting Spark removes the shuffle files of a query when the query is over.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that outlives lost executors.

    Its shuffle files go as soon as it is written, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def carried(docs: DataFrame, needed: list[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(the ``needed`` columns and all others in one, a function that gives back those that are still there, followed by further ones).

    So a column of the input never meets a helper column or a result of the same name.
    """
    names = docs.columns
    others = [c for c in names if c not in needed]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("_rest")
    packed = docs.select(*[c for c in names if c in needed], *([rest] if others else []))

    def restored(df: DataFrame, *more: str) -> DataFrame:
        of = {c: F.col(f"_rest.c{i}").alias(c) for i, c in enumerate(others)}
        return df.select(*[of.get(c, F.col(f"`{c}`")) for c in names if c in of or c in df.columns], *more)

    return packed, restored


def strip(c: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def words_of(text: Column) -> Column:
    """The runs of characters other than ASCII white space; null: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_CLASS + "+"), "")


def uniform(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) that only depends on the columns' values and the seed."""
    return F.pmod(F.xxhash64(F.lit(seed).cast("long"), *cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def ranked(df: DataFrame, order: list[Column], name: str, rank: str) -> DataFrame:
    """``df`` with a global row number from 0 in ``order``, without one task seeing all rows.

    Rows are range-partitioned and written; only the row count of each partition
    (at most as many numbers as there are partitions) comes to the driver.
    """
    spark = df.sparkSession
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    sizes = sorted((r[0], r[1]) for r in parts.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    starts = spark.createDataFrame(offsets or [(0, 0)], "_part int, _start long")
    within = Window.partitionBy("_part").orderBy(*order)
    return parts.join(F.broadcast(starts), "_part").withColumn(rank, F.col("_start") + F.row_number().over(within) - 1).drop("_part", "_start")



ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32())}


@lru_cache(maxsize=64)
def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))])


def batch_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """``rows`` as a batch with the columns of a schema that is written as "name type, name type"."""
    fields = _arrow(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)


def grouped(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number that is in ``part``, ascending, with the indexes where it is."""
    order = np.argsort(part, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(part[order])) + 1, len(part)) if len(part) else []
    start = 0
    for end in ends:
        yield int(part[order[start]]), order[start:end]
        start = end
