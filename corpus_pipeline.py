"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage is a whole-table job of one operator, on all that its predecessor kept:

1. quality rules: failing lines go, documents that are rejected go;
2. line dedup: lines that an earlier document holds go (a document may become empty);
3. near-duplicates: of each class of near-duplicates one document stays;
4. mixing: documents are repeated, or taken in part, as the sources' target weights ask;
5. BPE encoding and decoding: ids of each document, and its text as the ids give it back.

Defined cases, in every stage: a null text counts as empty (the quality rules reject it, having fewer than ten words); a null doc_id is a
document of its own, which the near-duplicate stage never drops; of rows with equal doc_id and text one stays, as of any copies, and rows of one
doc_id with different texts are different documents; an empty table gives an empty result with the same columns.
Further columns pass through, whatever their names: only ``n_tokens``, ``ids`` and ``decoded`` of the input are replaced by the last stage's results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, line_dedup, mixing, near_dup, quality
from ledgerloom.llm.shared import carried, documents, materialize


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """``docs`` with n_chars of their present texts."""
    return docs.withColumn("n_chars", F.char_length("text").cast(like.schema["n_chars"].dataType)) if "n_chars" in like.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed, restored = carried(docs, ["doc_id", "text", "n_chars"])
    return restored(_counted(line_dedup.dedup_lines(packed), docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed, restored = carried(docs, ["doc_id", "text", "source", "n_chars"])
    return restored(_counted(mixing.repetitions(mixing.mix(packed)), docs))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` but n_chars, text as decoded from the ids, and with these n_tokens and ids."""
    made = ("n_tokens", "ids", "decoded", "text")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*made, "n_chars")]
    coded = bpe.round_trip(docs.drop("n_chars"))
    return coded.select(*kept, F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: Sampled signatures and byte-pair merges have no SQL; the tests hold run()'s rows against five stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
