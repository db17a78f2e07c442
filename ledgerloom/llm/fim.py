"""Operator 11: fill-in-the-middle documents, cut by overlapping chunks.

A document is a run of units; a unit begins where a predicate on two adjacent bytes says so (``UNITS``: code points, words,
lines). Two ranks cut it into prefix, middle and suffix. The bytes of an Arrow batch, all its documents after each other, are
decomposed into chunks of ``CHUNK`` bytes that overlap by the byte before their first one, so that each chunk can
count its boundaries by itself:

1. the predicate counts boundaries chunk by chunk, ``BLOCK`` bytes of chunks at a time;
2. prefix sums over the chunks' counts give each document's number of units (the difference of the ranks at its two ends) and,
   by binary search, the chunk that owns each cut rank;
3. only the owning chunks, and those that hold the ends of documents, are scanned again to find places in them.

So no text is decoded or walked character by character, whatever its length, and what is held beside the batch is one
number for each chunk. A row stays whole in its task: there is no shuffle, and a lost task is run again by itself.

Which documents are cut, where, and in which form follows from the SHA-256 of seed and doc_id, so reruns agree.

Defined cases: a null text is an empty one; empty texts and texts that contain a sentinel are plain (output is the text; cuts are null); a
null doc_id is hashed as ``null``; rows of equal doc_id are cut by equal numbers, each in its own text; an empty table gives
an empty result; bytes that are no UTF-8 count by the same predicate; other columns pass through, and columns named like
the results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import carried, documents

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many stay plain, and of a hundred others so many have the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
SEED = 1
#: Bytes of a chunk, and of the chunks whose boundaries are counted at once.
CHUNK, BLOCK = 4096, 4 << 20
RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output"]

_white = np.zeros(256, bool)
_white[[0x20, *range(0x09, 0x0E)]] = True

#: Whether a unit begins at a byte, by the byte before and the byte itself. The first byte of a document begins a unit in any case.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "code_point": lambda before, own: (own & 0xC0) != 0x80,
    "word": lambda before, own: _white[before] & ~_white[own],
    "line": lambda before, own: before == 0x0A,
}


class Boundaries:
    """The unit boundaries of documents that lie after each other in ``data``; document i is ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, data: np.ndarray, at: np.ndarray, unit: str = "code_point", chunk: int = CHUNK) -> None:
        self.data, self.at, self.chunk, self.begins = data, at, chunk, UNITS[unit]
        # The first bytes of documents are boundaries by themselves; they are taken out of the chunks' counts and counted apart.
        filled = at[:-1][np.diff(at) > 0]
        self.first = filled
        step = max(1, BLOCK // chunk) * chunk
        counts = [self._counted(a, min(a + step, len(data))) for a in range(0, len(data), step)]
        self.before = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        self.n = self._rank(at[1:]) - self._rank(at[:-1])

    def _flags(self, start: int, end: int) -> np.ndarray:
        """Where in a range, which overlaps the byte before it, boundaries lie."""
        own = self.data[start:end]
        before = self.data[start - 1 : end - 1] if start else np.concatenate([own[:1], own[:-1]])
        flags = self.begins(before, own)
        a, b = np.searchsorted(self.first, [start, end])
        flags[self.first[a:b] - start] = True
        return flags

    def _counted(self, start: int, end: int) -> np.ndarray:
        return np.add.reduceat(self._flags(start, end), np.arange(0, end - start, self.chunk), dtype=np.int64)

    def _rank(self, places: np.ndarray) -> np.ndarray:
        """The boundaries before each of some places: whole chunks by their sums, the place's own chunk by a scan."""
        chunks = places // self.chunk
        out = self.before[np.minimum(chunks, len(self.before) - 1)].astype(np.int64)
        last, sums = -1, np.zeros(1, np.int64)
        for i, (c, within) in enumerate(zip(chunks.tolist(), (places % self.chunk).tolist(), strict=True)):
            if within:
                if c != last:
                    last, sums = c, np.cumsum(self._flags(c * self.chunk, min((c + 1) * self.chunk, len(self.data))))
                out[i] += sums[within - 1]
        return out

    def places(self, docs: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Where the unit of each rank (from 0) of its document begins; its end for the rank behind the last one."""
        out = self.at[docs + 1].copy()
        inner = np.flatnonzero(ranks < self.n[docs])
        wanted = self._starts()[docs[inner]] + ranks[inner]
        owners = np.searchsorted(self.before, wanted, "right") - 1
        for i, c, rank in zip(inner.tolist(), owners.tolist(), wanted.tolist(), strict=True):
            flags = self._flags(c * self.chunk, min((c + 1) * self.chunk, len(self.data)))
            out[i] = c * self.chunk + np.flatnonzero(flags)[rank - int(self.before[c])]
        return out

    def _starts(self) -> np.ndarray:
        """The rank, over the whole of ``data``, of each document's first unit."""
        return np.concatenate([[0], np.cumsum(self.n)])[:-1]


def numbers(seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of seed and doc_id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")))
    digest = F.sha2(F.encode(name, "UTF-8"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = SEED, unit: str = "code_point", plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, chunk: int = CHUNK) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), prefix_chars and middle_chars (units; null if plain) and output."""
    packed, restored = carried(docs.drop(*RESULTS), ["doc_id", "text"])
    names = packed.columns
    # Only numbers and texts go to Python and back; the other columns travel with them as they are.
    rows = packed.select(*names, *[h.alias(f"_h{i}") for i, h in enumerate(numbers(seed))])
    added = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = _texts(batch.column("text"))
            cut = Boundaries(np.frombuffer(data, np.uint8), offsets, unit, chunk)
            h = [batch.column(f"_h{i}").to_numpy() for i in range(4)]
            x, y = h[0] % (cut.n + 1), h[1] % (cut.n + 1)
            first, second = np.minimum(x, y), np.maximum(x, y)
            at, every = offsets.tolist(), np.arange(len(cut.n))
            whole = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            plain = (cut.n == 0) | (h[2] % 100 >= 100 - plain_percent) | np.fromiter((any(m in t for m in marks) for t in whole), bool, len(whole))
            forms = np.where(plain, "plain", np.where(h[3] % 100 < spm_percent, "spm", "psm"))
            own = every[~plain]
            ends = dict(zip(own.tolist(), zip(cut.places(own, first[own]).tolist(), cut.places(own, second[own]).tolist(), strict=True), strict=True))
            out = []
            for i, (text, form) in enumerate(zip(whole, forms.tolist(), strict=True)):
                if form == "plain":
                    out.append(text)
                    continue
                a, b = (e - at[i] for e in ends[i])
                p, s, m = marks
                out.append(p + text[:a] + s + text[b:] + m + text[a:b] if form == "psm" else s + text[b:] + p + text[:a] + m + text[a:b])
            results = [pa.array(cut.n, pa.int64()), pa.array(forms.tolist(), pa.string()), pa.array(first, pa.int64(), mask=plain), pa.array(second - first, pa.int64(), mask=plain), _strings(out)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *results], names=[*names, *RESULTS])

    return restored(rows.mapInArrow(run, T.StructType([*packed.schema.fields, *added])), *RESULTS)


def _texts(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """The offsets and the bytes of a batch's texts, nulls as empty ones."""
    values = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(values.buffers()[1], "<i8", len(values) + 1, 8 * values.offset) if len(values) else np.zeros(1, np.int64)
    data = values.buffers()[2].to_pybytes() if values.buffers()[2] is not None else b""
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def _strings(texts: list[bytes]) -> pa.Array:
    """Bytes as a string column, without decoding them."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    if offsets[-1] < 2**31:
        return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(b"".join(texts)))
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(b"".join(texts)))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. A cut text has no sentinel of its own, and none arises where pieces meet, so the sentinels alone split it."""
    pieces = F.split(output, "|".join(rf"\Q{m}\E" for m in (PREFIX, SUFFIX, MIDDLE)))
    piece = lambda i: F.get(pieces, F.lit(i))
    return F.when(form == "plain", output).when(form == "psm", F.concat(piece(1), piece(3), piece(2))).otherwise(F.concat(piece(2), piece(3), piece(1)))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
