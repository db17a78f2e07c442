"""Operator 8: mixing sources to target weights by capped water-filling.

Every source gets a share of the token budget in proportion to its weight. A share
above ``max_epochs`` times the source's own size is clamped there, and what is cut off
goes to the other sources in proportion to their weights; this repeats until no share is
above its cap. A document of a source with target t and size s is then taken t / s
times: the whole repetitions, and a fractional repetition: a seeded run of consecutive
words that is as long as the fraction says, rounded up or down by a coin seeded with doc_id and text. Rows that are repeated
(source, doc_id and text alike) would all be rounded alike; they are numbered, and the running sum over them is rounded, so that together they take what
they should. So each source comes within a few words of its target whatever the sizes of its documents and however often one is repeated.

Only three sums per round reach the driver; sources are ranked and clamped as rows.

Defined cases: a null text has size 0; a null source is a source of its own, ranked last;
a source of size 0 has target 0; repeated rows are documents of their own (which of them takes a word more than another is arbitrary, how many do is not);
an empty table gives an empty result; further columns pass through ``mix`` untouched, and
columns named like its results are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import carried, documents, materialize, ranked, uniform, words_of

MAX_EPOCHS = 3
WEIGHT_CYCLE = (1, 2, 3)
SEED = 20240817
RESULTS = ["size", "source_size", "target", "taken"]


def with_sizes(docs: DataFrame) -> DataFrame:
    return docs.drop(*RESULTS).withColumn("size", F.size(words_of(F.col("text"))).cast("long"))


def cycled_weights(totals: DataFrame) -> DataFrame:
    """``totals`` (source, source_size) with weights 1, 2, 3, 1, ... by code point of the source, null last."""
    out = ranked(totals, [F.col("source").isNull(), F.col("source")], "mix-sources", "_rank")
    cycle = F.array(*[F.lit(float(w)) for w in WEIGHT_CYCLE])
    return out.withColumn("weight", F.get(cycle, F.pmod(F.col("_rank"), F.lit(len(WEIGHT_CYCLE))).cast("int"))).drop("_rank")


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``; targets add up to the sum of sizes."""
    cap = F.col("source_size") * float(max_epochs)
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = float(total or 0) / weight if weight else 0.0
    while True:
        above = F.lit(level) * F.col("weight") > cap
        clamped, free = sources.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        higher = (float(total or 0) - (clamped or 0.0)) / free if free else level
        if not free or higher <= level * (1 + 1e-15):
            break
        level = higher
    return sources.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap))


def mix(docs: DataFrame, max_epochs: float = MAX_EPOCHS, seed: int = SEED, weights: DataFrame | None = None) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words, repetitions counted).

    ``weights``: a table (source, weight); without it weights repeat 1, 2, 3 by source.
    """
    docs, restored = carried(docs.drop(*RESULTS), ["doc_id", "text", "source"])
    sized = with_sizes(docs)
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        weighed = cycled_weights(totals)
    else:
        weighed = materialize(totals.join(weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight")), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"]), "mix-sources")
    targets = water_fill(materialize(weighed, "mix-weights"), max_epochs)
    targets = targets.select(F.col("source").alias("_s"), "source_size", "target")
    # One row per source. No broadcast hint: Spark broadcasts it below its threshold and else joins by (source), split where skewed.
    out = sized.join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    share, coin = (rate - whole) * F.col("size"), uniform(F.col("doc_id"), F.xxhash64("text"), seed=seed)
    numbered = with_copies(out.select("*", *_keys()), sized)
    part = F.floor((F.col("_copy") + 1) * share + coin) - F.floor(F.col("_copy") * share + coin)
    taken = F.least(whole * F.col("size") + F.least(part, F.col("size")), (F.col("size") * float(max_epochs)).cast("long"))
    return restored(numbered.withColumn("taken", taken.cast("long")), *RESULTS)


#: Two hashes of what makes rows repeated ones: source, doc_id and text, nulls told apart.
_SAME = ["source", "doc_id", "text"]


def _keys() -> list[Column]:
    return [F.xxhash64(F.lit(n), *[x for c in _SAME for x in (F.col(c).isNull(), F.col(c))]).alias(f"_k{n}") for n in (1, 2)]


def with_copies(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (with _k1 and _k2) with _copy: the number, from 0, of a row among those that are repeated; 0 for all others.

    Only repeated rows are moved. They are numbered within the partition that they were read in, behind the counts of the partitions before, so a row
    that makes a third of the table is numbered by as many tasks as have read it.
    """
    repeated = materialize(docs.groupBy(*_keys()).agg(F.count("*").alias("_n")).where("_n > 1").select("_k1", "_k2"), "mix-repeated")
    if not repeated.take(1):
        return rows.withColumn("_copy", F.lit(0).cast("long"))
    keys = ["_k1", "_k2"]
    many = materialize(rows.join(repeated, keys, "left_semi").withColumn("_part", F.spark_partition_id()), "mix-copies")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = many.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rest = [F.xxhash64("_rest")] if "_rest" in many.columns else [F.col("_k1")]
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*rest))
    numbered = many.withColumn("_own", own).join(materialize(counts, "mix-counts"), [*keys, "_part"]).withColumn("_copy", F.col("_before") + F.col("_own") - 1)
    once = rows.join(repeated, keys, "left_anti").withColumn("_copy", F.lit(0).cast("long"))
    return once.unionByName(numbered.select(*once.columns))


def repetitions(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """The documents of the mix: a row per whole repetition, and one with the words of the fractional one."""
    mixed, restored = carried(mixed.drop("source_size", "target"), ["doc_id", "text", "size", "taken"])
    schema = mixed.drop("size", "taken").schema
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def part(text: str | None, k: int, u: float) -> str | None:
        """``k`` consecutive words of a text, beginning where ``u`` says; the text itself, if k is negative."""
        if k < 0:
            return text
        spans = [m.span() for m in word.finditer(text)]
        first = int(u * (len(spans) - k + 1))
        return text[spans[first][0] : spans[first + k - 1][1]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [part(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("text", "_words", "_at")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in schema.names], names=schema.names)

    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0)
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    every = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(rest > 0, F.array(rest.cast("long"))).otherwise(F.array().cast("array<long>")))
    rows = mixed.withColumn("_at", uniform(F.col("doc_id"), F.xxhash64("text"), seed=seed + 1)).withColumn("_words", F.explode(every))
    return restored(rows.select(*schema.names, "_words", "_at").mapInArrow(cut, schema))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", *RESULTS)
