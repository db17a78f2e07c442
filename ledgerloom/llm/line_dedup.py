"""Operator 4: line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

A store holds runs: tables of 128-bit line hashes, bucketed and sorted by hash, each with
the smallest document that holds the line. New runs enter level 0; when a level has
``fanout`` runs they are merged into one of the next level, so each hash is rewritten
once per level. A batch of documents is handled by merging its own aggregated hashes
against the runs (a sort-merge join; the runs' buckets need no sort and, where the
counts agree, no shuffle): hashes in no run are new and form the batch's run, hashes in a
run are repeats, but for the document that the run has them from. Batches come in ascending order of doc_id, so the run that has a hash
has it from a smaller document, or from the same one where a batch is handed in again.

Which lines count: a line's key is the line without ASCII white space at its ends and with
A-Z in lower case; keys with at least ``MIN_KEY`` code points that at least two documents
hold lose all their lines but those of the smallest doc_id.

Defined cases: a null or empty text is one empty line; rows of equal doc_id are one
document as to who holds a line, and each row is cleaned by itself; a null doc_id orders
after all others; an empty table gives an empty result; other columns pass through, whatever their names, but
columns named like results are replaced. A line in a third of all documents is combined
before the shuffle, and its rows join by Spark's skew-splitting sort-merge join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LAST_ID, carried, documents, fresh_path, materialize, strip

MIN_KEY = 10
#: Runs of one level that are merged into one of the next.
FANOUT = 2
#: Batches that one call deals its documents into, by quantiles of doc_id.
BATCHES = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULTS = ["n_lines", "n_dropped"]


class LineRuns:
    """Levelled sorted runs below ``path``. A run's folder name holds its level, number and bucket count."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.path, self.fanout = spark, path, fanout
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.tables: dict[str, str] = {}
        jvm = spark._jvm
        self._folder = jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.runs: list[tuple[int, int, str]] = []
        if self._fs.exists(self._folder):
            for status in self._fs.listStatus(self._folder):
                name = status.getPath().getName()
                if name.startswith("L") and self._fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
                    level, number, _ = name[1:].split("-")
                    self.runs.append((int(level), int(number), name))
        self.runs.sort()

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            table, buckets = f"line_run_{uuid.uuid4().hex}", int(name.rsplit("b", 1)[1])
            self.spark.sql(
                f"CREATE TABLE {table} (h1 BIGINT, h2 BIGINT, first BIGINT) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'"
            )
            self.tables[name] = table
        return self.spark.table(self.tables[name])

    def hashes(self) -> DataFrame | None:
        """All runs' rows; a hash is in one run only."""
        out = None
        for _, _, name in self.runs:
            out = self._table(name) if out is None else out.unionByName(self._table(name))
        return out

    def each(self) -> list[DataFrame]:
        return [self._table(name) for _, _, name in self.runs]

    def _write(self, rows: DataFrame, level: int) -> None:
        number = max([n for _, n, _ in self.runs], default=-1) + 1
        name, table = f"L{level}-{number:06d}-b{self.buckets}", f"line_run_{uuid.uuid4().hex}"
        dealt = rows.select("h1", "h2", "first").repartition(self.buckets, "h1", "h2")
        dealt.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.path}/{name}").saveAsTable(table)
        self.tables[name] = table
        self.runs.append((level, number, name))
        self.runs.sort()

    def add(self, rows: DataFrame) -> None:
        """Add a run (h1, h2, first) of hashes that no run has, then merge full levels."""
        self._write(rows, 0)
        level = 0
        while len(full := [r for r in self.runs if r[0] == level]) >= self.fanout:
            merged = None
            for _, _, name in full:
                merged = self._table(name) if merged is None else merged.unionByName(self._table(name))
            self._write(merged, level + 1)
            for run in full:
                self.runs.remove(run)
                self.spark.sql(f"DROP TABLE {self.tables.pop(run[2])}")
                self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{run[2]}"), True)
            level += 1

    def close(self) -> None:
        """Forget the runs' tables; their files stay, to be opened again."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables.clear()


def line_key(line: Column) -> Column:
    return F.translate(strip(line), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _with_ids(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))).withColumn("_text", F.xxhash64("text"))


def hashed_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """A row (_doc, _text, pos, h1, h2) for each line that counts."""
    keys = _with_ids(docs).select("_doc", "_text", F.posexplode(F.transform(_lines(F.col("text")), line_key)).alias("pos", "key"))
    keys = keys.where(F.char_length("key") >= min_key)
    return keys.select("_doc", "_text", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))


def dropped_lines(docs: DataFrame, runs: LineRuns, min_key: int = MIN_KEY) -> DataFrame:
    """The lines (_doc, _text, pos) that one batch loses; its new hashes become a run.

    The batch's doc_ids must be above those of earlier batches, null last; but a batch may be handed in again (after a failure, say): a
    document keeps the lines that a run has from itself.
    """
    lines = materialize(hashed_lines(docs, min_key), "lines-hashed")
    own = lines.groupBy("h1", "h2").agg(F.min("_doc").alias("first"), F.max("_doc").alias("last"))
    own = materialize(own, "lines-own")
    fresh = own
    for run in runs.each():
        fresh = fresh.join(run, ["h1", "h2"], "left_anti")
    fresh = materialize(fresh, "lines-fresh")
    repeats = fresh.where(F.col("first") < F.col("last")).select("h1", "h2", F.col("first").alias("keep"))
    for run in runs.each():
        repeats = repeats.unionByName(own.select("h1", "h2").join(run.withColumnRenamed("first", "keep"), ["h1", "h2"]))
    gone = lines.join(repeats, ["h1", "h2"]).where(F.col("_doc") != F.col("keep"))
    gone = materialize(gone.select("_doc", "_text", "pos"), "lines-gone")
    runs.add(fresh)
    return gone


def dedup_lines(docs: DataFrame, runs: LineRuns | None = None, batches: int = BATCHES, min_key: int = MIN_KEY) -> DataFrame:
    """``docs`` with repeated lines removed from text (null becomes empty), with n_lines (before) and n_dropped.

    With ``runs`` of earlier calls, lines that those documents hold are repeats too.
    """
    spark, own = docs.sparkSession, runs is None
    docs, restored = carried(docs.drop(*RESULTS), ["doc_id", "text"])
    runs = runs or LineRuns(spark, fresh_path(spark, "line-runs"))
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)], F.lit(1000))).first()[0] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    doc, gone = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), None
    try:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            part = docs if low is None else docs.where(doc > low)
            part = part if high is None else part.where(F.col("doc_id") <= high)
            part = dropped_lines(part.select("doc_id", "text"), runs, min_key)
            gone = part if gone is None else gone.unionByName(part)
    finally:
        if own:
            runs.close()  # what the batches lose is written down by now
    lost = gone.groupBy("_doc", "_text").agg(F.collect_set("pos").alias("_gone"))
    out = _with_ids(docs).join(lost, ["_doc", "_text"], "left")
    out = out.withColumn("_lines", _lines(F.col("text"))).withColumn("_gone", F.coalesce("_gone", F.array().cast("array<int>")))
    out = out.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dropped", F.size("_gone").cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    text = F.when(F.size("_gone") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n"))
    return restored(out.withColumn("text", text), *RESULTS)


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP4_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS k FROM lines
), shared AS (
  SELECT k, min(doc_id) AS keep FROM keyed WHERE length(k) >= {MIN_KEY} GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT keyed.*, shared.k IS NOT NULL AND doc_id <> keep AS gone FROM keyed LEFT JOIN shared ON keyed.k = shared.k
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
