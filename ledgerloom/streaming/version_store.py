"""An incremental store of the newest version of each key: levelled runs of changes, merged when they are read.

Each batch writes one run with the newest version of the keys it touches, so its cost follows the batch, not the state. ``fan`` runs of one
level are merged into one of the next; a merge that takes in the oldest run puts deleted keys aside, in a folder of their own beside the run: a later batch may
still bring versions that are older than a delete. A run is a folder of Parquet, cut into buckets of keys, so a read of one key opens one bucket of each run. A manifest (one small file, renamed into place) lists the runs that count and the number
of the newest batch: a batch that comes again is passed over, and a run that a failed batch left behind is in no manifest. Runs that a merge has replaced
are removed when the next manifest but one is published, so that a reader that is under way doesn't lose them.

Changes have tbl, pk, op, event_time, txn_seq, event_ord, row_ord and any other columns, as in ``operators.versions``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.versions import KEYS, latest, live

BUCKETS = 64
FAN = 4


class VersionStore:
    """The store below ``path``, any path that Spark's file systems open; ``schema``: of the changes."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, buckets: int = BUCKETS, fan: int = FAN) -> None:
        self.spark, self.path, self.schema, self.buckets, self.fan = spark, path.rstrip("/"), schema, buckets, fan

    # ---- manifests -----------------------------------------------------------------------------

    def _hadoop(self, path: str):  # noqa: ANN202
        name = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return name.getFileSystem(self.spark._jsc.hadoopConfiguration()), name

    def _manifests(self) -> list[str]:
        fs, folder = self._hadoop(f"{self.path}/_manifests")
        return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")) if fs.exists(folder) else []

    def manifest(self) -> dict:
        """batch: the newest batch's number (-1: none); runs: [{name, level, rows, deleted}], the oldest first (deleted: the folder of its deleted keys, if it has any); gone: folders to be removed next."""
        names = self._manifests()
        if not names:
            return {"batch": -1, "buckets": self.buckets, "runs": [], "gone": []}
        fs, path = self._hadoop(f"{self.path}/_manifests/{names[-1]}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        names = self._manifests()
        number = int(names[-1].split(".")[0]) + 1 if names else 0
        fs, partial = self._hadoop(f"{self.path}/_manifests/.{uuid.uuid4().hex}")
        out = fs.create(partial, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(partial, self._hadoop(f"{self.path}/_manifests/{number:012d}.json")[1]):
            raise RuntimeError("another batch has published a manifest meanwhile")
        for old in names[:-1]:
            fs.delete(self._hadoop(f"{self.path}/_manifests/{old}")[1], False)

    # ---- writing -------------------------------------------------------------------------------

    def _bucket(self, *keys: Column) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.manifest()["buckets"])).cast("int")

    def _run(self, rows: DataFrame, level: int, kind: str = "run") -> dict:
        name = f"{kind}-{level}-{uuid.uuid4().hex}"
        bucketed = rows.withColumn("bucket", self._bucket(*[F.col(k) for k in KEYS]))
        bucketed.write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return {"name": name, "level": level, "rows": self._read([name]).count()}

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take a batch in; for ``foreachBatch``. A batch whose number isn't higher than the newest one's is passed over."""
        manifest = self.manifest()
        if number <= manifest["batch"]:
            return
        rows = latest(batch.select(*self.schema.names))
        runs, gone = [*manifest["runs"], self._run(rows, 0)], []
        while (level := self._full(runs)) is not None:
            merged = [r for r in runs if r["level"] == level]
            kept = [r for r in runs if r["level"] != level]
            state = latest(self._read(self._folders(merged)))
            # Runs are in order of arrival, and higher levels came earlier: of these, the first run alone has deleted keys aside.
            if runs[: len(merged)] == merged:
                run = self._run(live(state), level + 1)
                deleted = self._run(state.where("op = 'D'"), level + 1, "deleted")
                run["deleted"] = deleted["name"] if deleted["rows"] else None
                gone += [] if deleted["rows"] else [deleted["name"]]
            else:
                run = self._run(state, level + 1)
            at = next((i for i, r in enumerate(kept) if r["level"] <= level), len(kept))
            runs, gone = [*kept[:at], run, *kept[at:]], [*gone, *self._folders(merged)]
        self._publish({"batch": number, "buckets": manifest["buckets"], "runs": runs, "gone": gone})
        for name in manifest["gone"]:
            fs, folder = self._hadoop(f"{self.path}/{name}")
            fs.delete(folder, True)

    def _full(self, runs: list[dict]) -> int | None:
        levels = [r["level"] for r in runs]
        return next((n for n in sorted(set(levels)) if levels.count(n) >= self.fan), None)

    def writer(self) -> Callable[[DataFrame, int], None]:
        return self.apply

    # ---- reading -------------------------------------------------------------------------------

    @staticmethod
    def _folders(runs: list[dict]) -> list[str]:
        return [name for r in runs for name in (r["name"], r.get("deleted")) if name]

    def _read(self, names: list[str]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        out = None
        for name in names:
            run = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
            out = run if out is None else out.unionByName(run)
        out = self.spark.createDataFrame([], schema) if out is None else out
        return out

    def newest(self) -> DataFrame:
        """The newest version of each key; keys whose newest is a delete have op D."""
        return latest(self._read(self._folders(self.manifest()["runs"])).drop("bucket"))

    def current(self) -> DataFrame:
        return live(self.newest())

    def get(self, tbl: str, pk: Column) -> DataFrame:
        """The live row of one key: one bucket of each run is read."""
        kind = self.schema["pk"].dataType
        bucket = self._bucket(F.lit(tbl), pk.cast(kind))
        rows = self._read(self._folders(self.manifest()["runs"]))
        return live(latest(rows.where((F.col("bucket") == bucket) & (F.col("tbl") == tbl) & (F.col("pk") == pk)).drop("bucket")))
