"""Operator 6: token ids as binary files of directly addressable codes.

Ids of all documents, in ascending order of doc_id and each document's followed by an end
id, are cut into shards. In a shard every id is split into chunks of ``CHUNK_BITS`` bits:
level 0 has the lowest chunk of every id, and a continuation bitmap says which ids have a
further chunk in level 1, and so on. Where in level 1 an id's chunk lies is the number of
continuation bits before it, which a rank directory (a running count for every
``RANK_EVERY`` bits) and at most that many bits give: any token is read from a few bytes at
computed places, and no block is decoded.

A file is a Parquet file of shards, a row each, written by Spark's committer, so that lost
executors leave no half files. Texts are range-partitioned by doc_id, so each task writes
a contiguous range; the only numbers that reach the driver are the partitions' totals.

Ids are those of the tokenizers library for the same vocabulary file; the merging is done
by tiktoken's compiled merger over the vocabulary's ranks, which is several times faster
and gives the same ids (held against the library in the tests). Its splitter goes back over runs of white space and fails on very long ones, so texts
with a run of ``RUN`` white spaces, and any that it should fail on, are split and merged as operator 1 does.

Defined cases: a null text is empty and has the end id only; null doc_ids come last; rows
of equal doc_id follow each other in order of their texts' hashes, then of their texts; an empty table gives an empty
result; columns other than doc_id and text are not written. A document longer than a
shard has a shard of its own; runs of millions of white spaces or of one letter are encoded like any text.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import classes, compiled_encoding, encoder, tokenizer_path, vocabulary
from .shared import RANGE_BYTES, documents, fresh_path

CHUNK_BITS = 8
RANK_EVERY = 512
#: Ids after which a shard is closed.
SHARD_IDS = 1 << 20
END_ID = 0
#: White spaces in a row from which a text is split by operator 1's splitter.
RUN = 4096
MAGIC = b"DACIDS01"
SHARD_SCHEMA = "part int, shard int, start_in_part long, n_ids long, doc_ids binary, doc_nulls binary, doc_lengths binary, codes binary"


def pack(ids: np.ndarray) -> bytes:
    """Directly addressable codes of unsigned ids."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        more = rest >> CHUNK_BITS > 0
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, max(len(more), 1), RANK_EVERY), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(blocks)]).astype("<u4")
        levels.append((len(rest), (rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = rest[more] >> np.uint64(CHUNK_BITS)
        if not len(rest):
            break
    head = MAGIC + struct.pack("<II", len(ids), len(levels)) + b"".join(struct.pack("<III", n, len(bits), len(ranks)) for n, _, bits, ranks in levels)
    return head + b"".join(chunks + bits + ranks for _, chunks, bits, ranks in levels)


class Codes:
    """Packed ids. ``codes[i]`` reads one id by rank; ``all()`` reads every id."""

    def __init__(self, data: bytes) -> None:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not directly addressable codes")
        self.data, (self.n, levels) = data, struct.unpack_from("<II", data, len(MAGIC))
        heads = [struct.unpack_from("<III", data, len(MAGIC) + 8 + 12 * i) for i in range(levels)]
        at, self.levels = len(MAGIC) + 8 + 12 * levels, []
        for n, bits, ranks in heads:
            self.levels.append((n, at, at + n, at + n + bits))
            at += n + bits + ranks

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (_, chunks, bits, ranks) in enumerate(self.levels):
            value |= self.data[chunks + i] << CHUNK_BITS * level
            if not self.data[bits + i // 8] >> i % 8 & 1:
                break
            block = i // RANK_EVERY
            (before,) = struct.unpack_from("<I", self.data, ranks + 4 * block)
            first = bits + block * RANK_EVERY // 8
            within = int.from_bytes(self.data[first : bits + i // 8 + 1], "little") & ((1 << i % RANK_EVERY) - 1)
            i = before + within.bit_count()
        return value

    def all(self) -> np.ndarray:
        out = np.zeros(self.n, np.uint32)
        at = np.arange(self.n)
        for level, (n, chunks, bits, ranks) in enumerate(self.levels):
            out[at] |= np.frombuffer(self.data, np.uint8, n, chunks).astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            at = at[np.unpackbits(np.frombuffer(self.data, np.uint8, ranks - bits, bits), count=n, bitorder="little").astype(bool)]
        return out


@lru_cache(maxsize=2)
def merger(spec: str, known: tuple[str, str, int]) -> Callable[[str], list[int]]:
    """A text's ids, special tokens included, without an end id."""
    vocab = vocabulary(spec)
    encoding = compiled_encoding(vocab)
    allowed, exact, long_run = set(vocab.special), encoder(spec, known, None), re.compile(rf"\s{{{RUN}}}").search

    def merged(text: str) -> list[int]:
        if not long_run(text):
            try:
                return encoding.encode(text, allowed_special=allowed) if any(t in text for t in allowed) else encoding.encode_ordinary(text)
            except BaseException as e:  # a panic of the compiled code is none of Exception's
                if type(e).__name__ != "PanicException":
                    raise
        return np.frombuffer(exact(text), "<u4").tolist()

    return merged


def write_ids(docs: DataFrame, to: str, path: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of ``docs`` (doc_id, text) as files of shards in the folder ``to``, in ascending doc_id order."""
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        spec = f.read()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((spec, classes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part = merger(*shared.value), TaskContext.get().partitionId()
        names = [x.split()[0] for x in SHARD_SCHEMA.split(", ")]
        doc_ids, ids, lengths, size, shard, start = [], [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            known = np.array([d if d is not None else 0 for d in doc_ids], "<i8").tobytes()
            nulls = np.array([d is None for d in doc_ids], np.uint8).tobytes()
            values = [[part], [shard], [start], [size], [known], [nulls], [np.array(lengths, "<u4").tobytes()], [pack(np.concatenate(ids))]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = of(text) if text else []
                own.append(end_id)
                doc_ids.append(doc_id)
                ids.append(np.array(own, np.uint32))
                lengths.append(len(own))
                size += len(own)
                if size >= SHARD_IDS:
                    yield closed()
                    start, shard = start + size, shard + 1
                    doc_ids, ids, lengths, size = [], [], [], 0
        if doc_ids:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / RANGE_BYTES))
    # The hash also cuts rows of one doc_id, or of none, into several ranges.
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    rows.mapInArrow(run, SHARD_SCHEMA).write.parquet(to)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens (with the end id), ids_crc32."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    totals = sorted((r[0], r[1]) for r in shards.groupBy("part").agg(F.sum("n_ids")).collect())
    before, total = {}, 0
    for part, n in totals:
        before[part], total = total, total + n
    offsets = spark.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Codes(row["codes"]).all()
                lengths = np.frombuffer(row["doc_lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                doc_ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["doc_nulls"], np.uint8).astype(bool))
                columns = [doc_ids, pa.array(starts + row["start_in_part"] + offsets.value[row["part"]]), pa.array(lengths), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "start_in_part", "doc_ids", "doc_nulls", "doc_lengths", "codes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_at(spark: SparkSession, folder: str, position: int) -> int:
    """The id at a position of the whole sequence, read from its shard's codes alone."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    for part, n in sorted((r[0], r[1]) for r in shards.groupBy("part").agg(F.sum("n_ids")).collect()):
        if position < n:
            row = shards.where((F.col("part") == part) & (F.col("start_in_part") <= position) & (F.col("start_in_part") + F.col("n_ids") > position)).select("start_in_part", "codes").first()
            return Codes(bytes(row["codes"]))[position - row["start_in_part"]]
        position -= n
    raise IndexError(position)


def op6_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "dac")
    write_ids(documents(spark, sf_dir).select("doc_id", "text"), folder)
    return read_ids(spark, folder)
