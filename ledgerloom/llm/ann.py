"""Operator 3: nearest neighbours by score-aware (anisotropic) product quantisation.

Vectors are scaled to length one and split into subspaces of ``SUB`` components; each part
is replaced by one of 16 codewords, a four-bit code. What counts for the largest inner
products is the residual parallel to the vector, so codewords are chosen, and codebooks
fitted, under a loss that weighs the parallel residual ``eta`` times as much as the
orthogonal one. Codebooks are fitted on a bounded sample (``SAMPLE`` vectors); every row
is encoded. A query adds up 16-entry tables over the codes of all rows (two codes at a
time), keeps the ``RERANK`` best, and these are ranked by the exact cosine of the original
vectors in double precision.

That gives a fifth score to beat, not yet the nearest rows: codes can't tell near-copies
apart. Every row keeps the length of its residual along and across its vector. A row whose
cosine with a unit query is c has an approximate score of at least c (1 - along) -
across sqrt(1 - c^2), so a second scan takes every row that reaches this for the fifth score,
ranks these exactly where they lie, and sends on the best of each block. Queries whose last
candidate is below that bound for every row don't need it. So results are those of an exhaustive search.

Queries and rows are dealt into blocks of bounded size; a task scans one block of codes
for one block of queries, and codes are sent once for each block of queries (in the second
scan with their vectors, for larger blocks of queries).

Defined cases: vectors that are null, zero, or hold nulls or non-finite components take no
part, nor do rows of null vec_id or of another dimension than the most common one of the
sample; of rows of equal vec_id the one with the smallest vector counts; fewer rows than
neighbours give fewer results; an empty table gives an empty result; other columns are ignored. Equal
approximate scores are cut off in the first scan, and equal cosines ranked, by the smaller vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, uniform

SUB = 2
CODEWORDS = 16
#: Vectors on which codebooks are fitted, at most.
SAMPLE = 8192
ROUNDS = 4
#: Inner products above this share of the largest possible are those that count; it sets the weight of the parallel residual.
THRESHOLD = 0.2
#: Candidates of each query that are ranked exactly after the first scan.
RERANK = 100
NEIGHBOURS = 5
QUERY_EVERY = 50
#: Aims for the sizes of blocks: queries and rows.
QUERY_BLOCK, ROW_BLOCK = 1024, 32768
#: The same for the second scan: queries, and components of rows.
SECOND_QUERY_BLOCK, SECOND_ROW_VALUES = 8192, 1 << 21
SEED = 7


def parallel_weight(dim: int, threshold: float = THRESHOLD) -> float:
    """How much more a parallel residual weighs than an orthogonal one for inner products above the threshold."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def _parts(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, split into subspaces (the last filled with zeros)."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    fill = -x.shape[1] % SUB
    if fill:
        x = np.hstack([x, np.zeros((len(x), fill))])
    return np.ascontiguousarray(x.reshape(len(x), -1, SUB).astype(np.float32))


def assign(parts: np.ndarray, books: np.ndarray, eta: float, sweeps: int = 2) -> np.ndarray:
    """Codes of each row, by coordinate descent over subspaces on the anisotropic loss."""
    n, m, _ = parts.shape
    distance = np.empty((m, n, CODEWORDS), np.float32)
    along = np.empty((m, n, CODEWORDS), np.float32)
    for j in range(m):
        dots = parts[:, j] @ books[j].T
        own = (parts[:, j] ** 2).sum(1)[:, None]
        distance[j] = own - 2 * dots + (books[j] ** 2).sum(1)
        along[j] = own - dots
    codes = distance.argmin(2)
    rows = np.arange(n)
    total = sum(along[j, rows, codes[j]] for j in range(m))
    for _ in range(sweeps if eta > 1 else 0):
        for j in range(m):
            rest = (total - along[j, rows, codes[j]])[:, None]
            codes[j] = (distance[j] + (eta - 1) * (rest + along[j]) ** 2).argmin(1)
            total = rest[:, 0] + along[j, rows, codes[j]]
    return codes.T


def fit(sample: np.ndarray, rounds: int = ROUNDS, threshold: float = THRESHOLD, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Codebooks (subspace, codeword, component) and the weight of parallel residuals."""
    parts = _parts(sample)
    n, m, _ = parts.shape
    eta = parallel_weight(sample.shape[1], threshold)
    rng = np.random.default_rng(seed)
    books = np.stack([parts[rng.choice(n, CODEWORDS, replace=n < CODEWORDS), j] for j in range(m)])
    for r in range(rounds + 3):
        plain = r < 3  # a few rounds of ordinary k-means to begin with
        codes = assign(parts, books, 1.0 if plain else eta, 1)
        weight = 1.0 if plain else eta
        # The least-squares system over all codewords: counts on the diagonal, and the parallel part of every row.
        size = m * CODEWORDS
        gram, right = np.zeros((size * SUB, size * SUB)), np.zeros(size * SUB)
        place = (np.arange(m)[None, :] * CODEWORDS + codes)[:, :, None] * SUB + np.arange(SUB)
        flat, values = place.reshape(n, -1), parts.reshape(n, -1)
        np.add.at(right, flat, weight * values)
        counts = np.bincount(flat.ravel(), minlength=size * SUB)
        if weight > 1:
            for at in range(0, n, 2048):
                block = np.zeros((len(flat[at : at + 2048]), size * SUB), np.float32)
                np.put_along_axis(block, flat[at : at + 2048], values[at : at + 2048], 1)
                gram += (weight - 1) * (block.T @ block)
        gram[np.diag_indices_from(gram)] += counts + 1e-3
        right += 1e-3 * books.ravel()
        books = np.linalg.solve(gram, right).reshape(m, CODEWORDS, SUB).astype(np.float32)
    return books, eta


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.hstack([codes, np.zeros((len(codes), 1), codes.dtype)])
    return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)


def tables(query: np.ndarray, books: np.ndarray) -> np.ndarray:
    """For each byte of a code, the sum of its two codewords' inner products with the query, for all 256 values."""
    m = len(books)
    q = np.zeros(m * SUB, np.float32)
    q[: len(query)] = query
    each = np.einsum("jcs,js->jc", books, q.reshape(m, SUB))
    if m % 2:
        each = np.vstack([each, np.zeros((1, CODEWORDS), np.float32)])
    return (each[1::2, :, None] + each[::2, None, :]).reshape(-1, CODEWORDS * CODEWORDS)


def approximate(query: np.ndarray, columns: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The sums of the query's tables over the codes of all rows, given by column."""
    table = tables(query, books)
    score = table[0][columns[0]]
    for t, c in zip(table[1:], columns[1:], strict=True):
        score += t[c]
    return score


def residuals(parts: np.ndarray, codes: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The length of each row's residual along its vector (signed) and across it."""
    unit = parts.astype(np.float64)
    rest = unit - books[np.arange(len(books))[None, :], codes]
    along = (rest * unit).sum((1, 2))
    return along, np.sqrt(np.maximum((rest**2).sum((1, 2)) - along**2, 0))


def slack(books: np.ndarray) -> float:
    """More than what rounding to single precision can change in an approximate score."""
    return 1e-6 * (len(books) + 8)


def needed(score: float, along: np.ndarray, across: np.ndarray, rounding: float) -> np.ndarray:
    """The least approximate score of rows with these residuals whose cosine is ``score`` or more."""
    if score < 0:
        return score - np.hypot(along, across) - rounding
    return score * (1 - along) - across * math.sqrt(max(0.0, 1 - score**2)) - rounding


def scan_block(queries: np.ndarray, query_ids: np.ndarray, codes: np.ndarray, ids: np.ndarray, books: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best rows of a block (ids ascending) for each query, never its own; ties to smaller ids."""
    columns = np.ascontiguousarray(codes.T)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for query, own in zip(queries, query_ids, strict=True):
        score = approximate(query, columns, books)
        at = np.searchsorted(ids, own)
        if at < len(ids) and ids[at] == own:
            score[at] = -np.inf
        k = min(keep, len(ids))
        least = np.partition(score, len(score) - k)[len(score) - k]
        best = np.flatnonzero(score > least)
        best = np.concatenate([best, np.flatnonzero(score == least)[: k - len(best)]])
        best = best[score[best] > -np.inf]
        found.append((np.full(len(best), own), ids[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of columns of vectors (component first), added up in the order of ``_dot``."""
    out = np.zeros(x.shape[1])
    for a, b in zip(x, y, strict=True):
        out += a * b
    return out


def exact_block(queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, codes: np.ndarray, along: np.ndarray, across: np.ndarray, vectors: np.ndarray, ids: np.ndarray, books: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` rows of largest cosine of a block for each query, of those that can reach ``least``; never its own; ties to smaller ids."""
    columns, values = np.ascontiguousarray(codes.T), np.ascontiguousarray(vectors.T)
    lengths, rounding = np.sqrt(_dots(values, values)), slack(books)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for query, own, score in zip(queries, query_ids, least, strict=True):
        near = approximate((query / np.linalg.norm(query)).astype(np.float32), columns, books)
        at = np.flatnonzero((near >= needed(score, along, across, rounding)) & (ids != own))
        q = query[:, None]
        cosines = _dots(values[:, at], q) / (np.sqrt(_dots(q, q)) * lengths[at])
        best = np.lexsort((ids[at], -cosines))[:keep]
        found.append((np.full(len(best), own), ids[at[best]], cosines[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """One row (vec_id, embedding) for each vec_id whose vector can take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists(x, lambda v: v != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine & some).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def search(vectors: DataFrame, every: int = QUERY_EVERY, neighbours: int = NEIGHBOURS, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries: rows whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    rows = materialize(valid_vectors(vectors), "ann-valid")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], empty)
    chosen = rows.where(uniform(F.col("vec_id"), seed=SEED) < min(1.0, 1.2 * SAMPLE / n)).orderBy(uniform(F.col("vec_id"), seed=SEED)).limit(SAMPLE)
    sample = [r[0] for r in chosen.select("embedding").collect()]
    lengths = [len(x) for x in sample]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d))
    rows = rows.where(F.size("embedding") == dim)
    books, eta = fit(np.array([x for x in sample if len(x) == dim], np.float64))
    model = spark.sparkContext.broadcast((books, eta))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, eta = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim).astype(np.float64)
            packed, along, across = [], [], []
            for i in range(0, len(x), 2048):
                parts = _parts(x[i : i + 2048])
                codes = assign(parts, books, eta)
                packed += [c.tobytes() for c in pack_codes(codes)]
                for whole, own in zip((along, across), residuals(parts, codes, books), strict=True):
                    whole.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary()), pa.array(np.concatenate(along)), pa.array(np.concatenate(across))], names=["vec_id", "code", "along", "across"])

    codes = materialize(rows.select("vec_id", "embedding").mapInArrow(encode, "vec_id long, code binary, along double, across double"), "ann-codes")
    queries = rows.where(F.col("vec_id") % every == 0)
    n_queries = queries.count()
    if not n_queries:
        return spark.createDataFrame([], empty)
    q_blocks, r_blocks = math.ceil(n_queries / QUERY_BLOCK), math.ceil(n / ROW_BLOCK)
    block = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    every_block = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("embedding"), block(q_blocks).alias("qb"), every_block(r_blocks).alias("rb"))
    right = codes.select("vec_id", "code", block(r_blocks).alias("rb"), every_block(q_blocks).alias("qb"))

    def scan(own: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(block):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "near": pd.Series(dtype="float32")})
        block = block.sort_values("vec_id")
        packed = np.frombuffer(b"".join(block["code"]), np.uint8).reshape(len(block), -1)
        q = np.stack(own["embedding"].to_numpy())
        q, v, s = scan_block((q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32), own["vec_id"].to_numpy(), packed, block["vec_id"].to_numpy(), model.value[0], rerank)
        return pd.DataFrame({"query_id": q, "vec_id": v, "near": s})

    near = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(scan, "query_id long, vec_id long, near float")
    best = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    near = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= rerank).select("query_id", "vec_id", "near")
    exact = near.join(rows.select("vec_id", F.col("embedding").alias("_v")), "vec_id")
    exact = exact.join(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("_q")), "query_id")
    exact = exact.select("query_id", "vec_id", "near", cosine(F.col("_q"), F.col("_v")).alias("score"))
    order, whole = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"), Window.partitionBy("query_id")
    exact = exact.withColumn("rank", F.row_number().over(order)).withColumn("seen", F.count("*").over(whole)).withColumn("last", F.min("near").over(whole))
    first = materialize(exact.where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score", "seen", "last"), "ann-first")

    # Fewer candidates than ``rerank`` are all rows there are; else every row not seen must be below what the last score found needs.
    most = codes.agg(F.max("along"), F.max("across"), F.max(F.hypot("along", "across"))).first()
    least = F.when(F.count("*") == neighbours, F.min("score")).otherwise(F.lit(float("-inf")))
    found = first.groupBy("query_id").agg(F.max("seen").alias("seen"), F.max("last").alias("last"), least.alias("least"))
    s = F.col("least")
    need = F.when(s < 0, s - most[2]).otherwise(s * (1 - most[0]) - most[1] * F.sqrt(F.greatest(F.lit(0.0), 1 - s * s))) - slack(books)
    again = materialize(found.where((F.col("seen") >= rerank) & (F.col("last") >= need)).select("query_id", "least"), "ann-again")
    n_again = again.count()
    if not n_again:
        return first.select("query_id", "rank", "vec_id", "score")
    q_again, r_again = math.ceil(n_again / SECOND_QUERY_BLOCK), max(r_blocks, math.ceil(n * dim / SECOND_ROW_VALUES))
    left = again.join(queries, again["query_id"] == queries["vec_id"]).select("vec_id", F.col("embedding").alias("vector"), "least", block(q_again).alias("qb"), every_block(r_again).alias("rb"))
    right = codes.join(rows, "vec_id").select("vec_id", "code", "along", "across", F.col("embedding").alias("vector"), block(r_again).alias("rb"), every_block(q_again).alias("qb"))

    def scan_exactly(own: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(block):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        packed = np.frombuffer(b"".join(block["code"]), np.uint8).reshape(len(block), -1)
        q, x = (np.stack(side["vector"].to_numpy()).astype(np.float64) for side in (own, block))
        given = [side[c].to_numpy() for side, c in ((own, "vec_id"), (own, "least"), (block, "along"), (block, "across"), (block, "vec_id"))]
        q, v, s = exact_block(q, given[0], given[1], packed, given[2], given[3], x, given[4], model.value[0], neighbours)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    second = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(scan_exactly, "query_id long, vec_id long, score double")
    second = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= neighbours).select("query_id", "rank", "vec_id", "score")
    return first.join(again, "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(second)


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
