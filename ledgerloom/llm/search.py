"""Operator 12: ranked lexical search by TPUT (three-phase uniform threshold) over term-partitioned postings.

Terms are dealt to ``PARTS`` partitions by a hash, and each partition holds the whole lists of its terms: the index is a table
in a folder for each partition. A list is stored in segments of documents (what one task indexed, up to ``POSTINGS``
postings), so a term that every document holds is as many rows as there are segments, and no task ever holds a whole
list. A posting is the document's place in its segment and the term's occurrences; contributions follow from these, the
document's length and the corpus's statistics, all in 64-bit integers.

For each item a partition's list is the documents by the sum of the contributions of the item's terms in that partition. Then:

1. heads: the ``k`` best documents of each partition's list are looked up exactly; the k-th best of these scores is a lower bound;
2. uniform threshold: with m partitions that hold terms of the item, each sends the documents whose partial sum is at
   least the bound divided by m. Any document that reaches the bound has such a sum in some partition. Partial sums
   give a higher bound, and what a document may still have in the partitions that didn't send it is less than the threshold in each, which
   rules most documents out;
3. look-ups: the exact scores of the candidates that are left, from all partitions' lists, decide.

The result is that of scoring every document. Of equal texts in one segment only the ``k`` with the smallest doc_ids are sent: the
others can't be among the best k. Items are handled in blocks of some ``BLOCK_PAIRS`` (item, term) pairs; only a
block's terms with their weights, and one bound for each item, pass the driver. The index is a written table, and so are the results of
the phases, so lost executors cost their running tasks only.

Defined cases: null texts and texts without terms hold no term and are never found; a null doc_id is a document like others, last among equal
scores; rows of equal doc_id (equal texts or not) are documents of their own; the rows of one item_id (null ones too) are one
item with all their terms; items without terms, or whose terms no document holds, have no rows; empty tables give an
empty result; other columns of either table are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import documents, fresh_path, materialize

K = 10
#: Partitions of the terms.
PARTS = 4
#: Postings of a segment, all partitions together.
POSTINGS = 1 << 20
#: Terms up to which the index is built for these alone; beyond, it holds all terms.
MAX_WANTED = 1 << 20
#: (item, term) pairs of a block of items.
BLOCK_PAIRS = 1 << 18
#: Bytes of a text that are split into terms at once, and unwanted terms that a worker remembers.
PIECE, REMEMBERED = 1 << 20, 200_000
INDEX = "part int, seg long, n_docs int, n_held long, n_terms long, terms array<binary>, sizes array<int>, rows binary, tfs binary, lens binary, ids binary, nulls binary, copies binary"
_INDEX = pa.schema([("part", pa.int32()), ("seg", pa.int64()), ("n_docs", pa.int32()), ("n_held", pa.int64()), ("n_terms", pa.int64()), ("terms", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("rows", "tfs", "lens", "ids", "nulls", "copies"))])
FOUND = "item int, part int, seg long, row int, doc_id long, partial long"
_FOUND = pa.schema([("item", pa.int32()), ("part", pa.int32()), ("seg", pa.int64()), ("row", pa.int32()), ("doc_id", pa.int64()), ("partial", pa.int64())])

#: ASCII letters and digits stay, in lower case; all other ASCII separates; bytes of other characters stay.
_FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a folded text, in pieces of bounded size."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def part_of(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term) % PARTS


class Numbers(dict):
    """Numbers the wanted terms (None: all) as they come; -1 for others."""

    def __init__(self, wanted: frozenset[bytes] | None) -> None:
        super().__init__()
        self.wanted, self.terms = wanted, []

    def __missing__(self, term: bytes) -> int:
        if self.wanted is not None and term not in self.wanted:
            if len(self) < REMEMBERED:
                self[term] = -1
            return -1
        self[term] = n = len(self.terms)
        self.terms.append(term)
        return n


class Segment:
    """Collects the postings of documents until they are written as rows of the index, one for each partition of the terms."""

    def __init__(self, number: int, wanted: frozenset[bytes] | None) -> None:
        self.number, self.numbers = number, Numbers(wanted)
        self.docs, self.lens, self.hashes, self.terms, self.tfs, self.n = [], [], [], [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        own = folded(text)
        found = [np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)) for words in pieces(own)]
        known = np.concatenate(found) if found else np.zeros(0, np.int32)
        self.docs.append(doc_id)
        self.lens.append(len(known))
        self.hashes.append(xxhash.xxh3_128_digest(own))
        terms, tfs = np.unique(known[known >= 0], return_counts=True)
        self.terms.append(terms)
        self.tfs.append(tfs.astype("<u4"))
        self.n += len(terms)

    def rows(self) -> Iterator[pa.RecordBatch]:
        n = len(self.docs)
        nulls = np.array([d is None for d in self.docs], np.uint8)
        ids = np.array([0 if d is None else d for d in self.docs], "<i8")
        lens = np.array(self.lens, "<i8")
        terms, tfs = np.concatenate(self.terms), np.concatenate(self.tfs)
        rows = np.repeat(np.arange(n, dtype="<u4"), [len(t) for t in self.terms])
        copies = _copies(np.frombuffer(b"".join(self.hashes), "<u8").reshape(n, 2), ids, nulls)
        # Terms in order of their partition; postings in order of their terms, and by document within a term.
        names = self.numbers.terms
        parts = np.array([part_of(t) for t in names], np.int64)
        order = np.argsort(parts, kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        by_term = np.argsort(place[terms], kind="stable")
        sizes = np.bincount(place[terms], minlength=len(names))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        firsts = np.searchsorted(parts[order], np.arange(PARTS + 1))
        shared = [lens.tobytes(), ids.tobytes(), nulls.tobytes(), copies.tobytes()]
        for part in range(PARTS):
            a, b = int(firsts[part]), int(firsts[part + 1])
            if a == b and part:  # the first partition's rows also have the segment's statistics
                continue
            own = by_term[starts[a] : starts[b]]
            values = [part, self.number, n, int((lens > 0).sum()), int(lens.sum()), [names[i] for i in order[a:b]], sizes[a:b].tolist(), rows[own].tobytes(), tfs[own].tobytes(), *shared]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _INDEX, strict=True)], schema=_INDEX)


def _copies(hashes: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """For each document, how many of the same terms in the same order come before it by doc_id."""
    order = np.lexsort((ids, nulls, hashes[:, 1], hashes[:, 0]))
    same = hashes[order]
    new = np.append(True, (same[1:] != same[:-1]).any(1)) if len(order) else np.zeros(0, bool)
    at = np.arange(len(order))
    out = np.empty(len(order), "<u4")
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0)) if len(order) else out
    return out


def build_index(docs: DataFrame, folder: str, wanted: list[bytes] | None = None, postings: int = POSTINGS) -> None:
    """Write the postings of ``docs`` (doc_id, text): of the ``wanted`` terms, or of all; ``postings`` to a segment, and those of one more document."""
    shared = docs.sparkSession.sparkContext.broadcast(None if wanted is None else frozenset(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        number, segment = first, Segment(first, shared.value)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                segment.add(doc_id.as_py(), text.as_py())
                if segment.n >= postings:
                    yield from segment.rows()
                    number += 1
                    segment = Segment(number, shared.value)
        if segment.docs:
            yield from segment.rows()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(run, INDEX).write.partitionBy("part").parquet(folder)


def terms_of(items: DataFrame) -> DataFrame:
    """(item_id, term, qtf) of ``items`` (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, terms = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = [t for words in pieces(folded(text)) for t in words]
                ids += [item] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], names=["item_id", "term"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, term binary").groupBy("item_id", "term").agg(F.count("*").alias("qtf"))


class Block:
    """The items of one block as tasks need them: by partition and item, the terms with their weights; the corpus's statistics; the bounds."""

    def __init__(self, plan: dict[int, dict[int, list[tuple[bytes, int]]]], n: int, length: int, k: int) -> None:
        self.plan, self.n, self.length, self.k = plan, n, length, k
        self.lists: dict[int, int] = defaultdict(int)
        for items in plan.values():
            for item in items:
                self.lists[item] += 1
        self.bounds: dict[int, int] = {}


class Lists:
    """A row of the index: the lists of one partition's terms in one segment."""

    def __init__(self, row: dict, block: Block) -> None:
        self.part, self.seg, self.n_docs = row["part"], row["seg"], row["n_docs"]
        ends = np.cumsum(row["sizes"]).tolist()
        self.spans = {t: (a, b) for t, a, b in zip(row["terms"], [0, *ends], ends, strict=False)}
        self.rows = np.frombuffer(row["rows"], "<u4")
        tf = np.frombuffer(row["tfs"], "<u4").astype(np.int64)
        m = 25 + 75 * np.frombuffer(row["lens"], "<i8") * block.n // max(1, block.length)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.rows])
        self.row = row

    def scores(self, terms: list[tuple[bytes, int]]) -> np.ndarray | None:
        """Each document's sum of contributions of some (term, weight); None where the segment has none of them."""
        out = None
        for term, weight in terms:
            if (span := self.spans.get(term)) is not None:
                out = np.zeros(self.n_docs, np.int64) if out is None else out
                own = slice(*span)
                out[self.rows[own]] += weight * self.impact[own]  # a list has a document once
        return out

    def found(self, item: int, rows: np.ndarray, partial: np.ndarray) -> list[np.ndarray]:
        """Columns of FOUND but doc_id, and two for it: ids and whether they are null."""
        n = len(rows)
        ids, nulls = np.frombuffer(self.row["ids"], "<i8"), np.frombuffer(self.row["nulls"], np.uint8)
        return [np.full(n, item, np.int32), np.full(n, self.part, np.int32), np.full(n, self.seg, np.int64), rows.astype(np.int32), ids[rows], nulls[rows].astype(bool), partial]


def _batch(found: list[list[np.ndarray]]) -> pa.RecordBatch:
    item, part, seg, row, ids, nulls, partial = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(item), pa.array(part), pa.array(seg), pa.array(row), pa.array(ids, mask=nulls), pa.array(partial)], schema=_FOUND)


def _rows(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple[Lists, dict]]:
    """The rows of the index, one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            (row,) = batch.slice(i, 1).to_pylist()
            yield Lists(row, block), row


def _heads(index: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    """The k best documents of each item in each partition, by their partial sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        best: dict[tuple[int, int], list[np.ndarray]] = {}
        for lists, row in _rows(batches, block):
            first_copies = np.frombuffer(row["copies"], "<u4") < block.k
            for item, terms in block.plan.get(lists.part, {}).items():
                sums = lists.scores(terms)
                if sums is None:
                    continue
                at = np.flatnonzero((sums > 0) & first_copies)
                if len(at) > block.k:
                    at = at[np.argpartition(-sums[at], block.k - 1)[: block.k]]
                new = lists.found(item, at, sums[at])
                if (old := best.get((item, lists.part))) is not None:
                    new = [np.concatenate(c) for c in zip(old, new, strict=True)]
                    keep = np.argsort(-new[-1], kind="stable")[: block.k]
                    new = [c[keep] for c in new]
                best[item, lists.part] = new
        every = iter(best.values())
        while some := list(islice(every, 1000)):
            yield _batch(some)

    rank = F.row_number().over(Window.partitionBy("item", "part").orderBy(F.desc("partial")))
    return index.mapInArrow(run, FOUND).withColumn("_n", rank).where(F.col("_n") <= shared.value.k).drop("_n")


def _sent(index: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    """What each partition sends: the documents whose partial sum reaches the item's bound divided by its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        held, size = [], 0
        for lists, row in _rows(batches, block):
            first_copies = np.frombuffer(row["copies"], "<u4") < block.k
            for item, terms in block.plan.get(lists.part, {}).items():
                sums = lists.scores(terms)
                if sums is None:
                    continue
                at = np.flatnonzero((sums > 0) & (sums * block.lists[item] >= block.bounds.get(item, 0)) & first_copies)
                if len(at):
                    held.append(lists.found(item, at, sums[at]))
                    size += len(at)
                if size >= 100_000:
                    yield _batch(held)
                    held, size = [], 0
        if held:
            yield _batch(held)

    return index.mapInArrow(run, FOUND)


def _exact(index: DataFrame, wanted: DataFrame, shared) -> DataFrame:  # noqa: ANN001
    """(item, seg, row, doc_id, score) of the ``wanted`` (item, seg, row), looked up in all partitions' lists."""
    packed = wanted.select("item", "seg", "row").distinct().groupBy("seg").agg(F.collect_list(F.struct("item", "row")).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        for lists, row in _rows(batches, block):
            of_item, found = defaultdict(list), []
            for pair in row["pairs"]:
                of_item[pair["item"]].append(pair["row"])
            for item, rows in of_item.items():
                sums = lists.scores(block.plan.get(lists.part, {}).get(item, []))
                if sums is not None:
                    at = np.array(rows)
                    found.append(lists.found(item, at, sums[at]))
            if found:
                yield _batch(found)

    looked_up = index.join(packed, "seg").mapInArrow(run, FOUND)
    return looked_up.groupBy("item", "seg", "row").agg(F.first("doc_id").alias("doc_id"), F.sum("partial").alias("score"))


def _kth(rows: DataFrame, score: str, k: int) -> dict[int, int]:
    """The k-th best score of each item of a block; 0 where there are fewer."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(score)))
    return {r[0]: r[1] for r in rows.select("item", score).withColumn("_n", rank).where((F.col("_n") <= k)).where(F.col("_n") == k).select("item", score).collect()}


def search(spark: SparkSession, folder: str, items: DataFrame, k: int = K, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of the index in ``folder`` for each of ``items`` (item_id, text)."""
    index = spark.read.schema(INDEX).parquet(folder)
    lists = index.select("part", F.explode(F.arrays_zip("terms", "sizes")).alias("list"))
    df = lists.groupBy("part", F.col("list.terms").alias("term")).agg(F.sum("list.sizes").alias("df"))
    n, length = index.where("part = 0").agg(F.sum("n_held"), F.sum("n_terms")).first()
    n, length = n or 0, length or 0
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long") * F.col("qtf")
    weighed = materialize(terms_of(items).join(df, "term").select("item_id", "part", "term", weight.alias("weight")).where("weight > 0"), "search-weights")
    blocks = max(1, math.ceil(weighed.count() / block_pairs))
    out = None
    for b in range(blocks):
        own = weighed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # a block: bounded by block_pairs
        if own:
            found = _search_block(spark, index, own, n, length, k)
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def _search_block(spark: SparkSession, index: DataFrame, pairs: list, n: int, length: int, k: int) -> DataFrame:
    names = list(dict.fromkeys(p.item_id for p in pairs))
    number = {item: i for i, item in enumerate(names)}
    plan: dict[int, dict[int, list[tuple[bytes, int]]]] = defaultdict(lambda: defaultdict(list))
    for p in pairs:
        plan[p.part][number[p.item_id]].append((bytes(p.term), p.weight))
    block = Block({part: dict(own) for part, own in plan.items()}, n, length, k)
    share = spark.sparkContext.broadcast

    first = share(block)
    heads = materialize(_heads(index, first), "search-heads")
    block.bounds = _kth(materialize(_exact(index, heads, first), "search-bounds"), "score", k)
    second = share(block)
    sent = materialize(_sent(index, second), "search-sent")
    partial = sent.groupBy("item", "seg", "row").agg(F.sum("partial").alias("partial"), F.count("*").alias("seen"))
    higher = _kth(partial, "partial", k)
    known = [(i, block.lists[i], block.bounds.get(i, 0), max(higher.get(i, 0), block.bounds.get(i, 0))) for i in range(len(names))]
    bounds = spark.createDataFrame(known, "item int, lists long, bound long, higher long")
    may_have = F.col("partial") * F.col("lists") + (F.col("lists") - F.col("seen")) * F.col("bound")
    candidates = materialize(partial.join(F.broadcast(bounds), "item").where(may_have >= F.col("higher") * F.col("lists")).select("item", "seg", "row"), "search-candidates")
    scored = _exact(index, candidates, second).where("score > 0")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "seg", "row"))
    best = materialize(scored.withColumn("rank", rank).where(F.col("rank") <= k), "search-best")
    of_items = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")
    return best.join(F.broadcast(of_items), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text), by an index that is made for these items' terms."""
    spark, folder = docs.sparkSession, fresh_path(docs.sparkSession, "search-index")
    asked = terms_of(items).select("term").distinct()
    wanted = [bytes(r.term) for r in asked.limit(MAX_WANTED + 1).collect()]
    build_index(docs, folder, wanted if len(wanted) <= MAX_WANTED else None)
    return search(spark, folder, items, k)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP12_SQL = r"""
WITH doc_words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents
), item_terms AS (
    SELECT item_id, term, count(*) AS qtf FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
    GROUP BY ALL
), lengths AS (SELECT doc_id, count(*)::BIGINT AS n FROM doc_words GROUP BY ALL),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
postings AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM doc_words WHERE term IN (SELECT term FROM item_terms) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
    FROM postings, corpus GROUP BY term
), impacts AS (
    SELECT p.doc_id, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS c
    FROM postings p JOIN lengths USING (doc_id) JOIN weights w ON w.term = p.term, corpus
), scores AS (SELECT item_id, doc_id, sum(qtf * c)::BIGINT AS score FROM item_terms JOIN impacts USING (term) GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 10
"""
