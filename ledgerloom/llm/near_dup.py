"""Operator 2: near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles. A shingle weighs its count times the sum of
its words' inverse document frequencies, 1 + ln((N + 1) / (df + 1)), undamped. (With the frequency of the
shingle itself, the copies in a large group lose the weight of what they share: the group's size is its
shingles' document frequency.) Frequencies are exact: texts are dealt into groups, and a group sends
each of its words with its count to the task that adds up this word, and hears the sum.

Shingles go the same way, to learn which of them a second text holds. That proves most texts to be near no other:
the similarity to any text is at most the share of weight in shingles that a second text holds, so a
text below the threshold there is done. A shingle takes part in this by some 31 bits of its hash beside its
task's number; where two shingles agree in these, a text is looked at for nothing, and no link is lost.

Improved consistent weighted sampling (Gamma(2, 1) draws r and c and a uniform draw b for
each shingle and place; t = floor(ln w / r + b); the shingle of least ln c - r (t - b + 1) is
the sample, with its t) gives the remaining texts signatures that agree in each place with the probability of
the weighted Jaccard similarity. ``BANDS`` bands of ``ROWS`` places are buckets; a pair at 0.8 misses all of them with
probability 0.003, one at 0.85 with 0.00005. Within a bucket two steps settle every pair, at any size:

1. each text is compared with the bucket's pivot, the text that meets most others in its buckets;
2. of the classes that this leaves in a bucket, the texts outside the most frequent one are compared with all texts of other
   classes, except where a bound rules the pair out: two texts share at most the sum of the lesser weights of
   their shared shingles over ``PARTS`` parts of the hashes.

Comparisons are exact weighted Jaccard similarities. Pairs inside one class are skipped, so nothing is paired up within a group of copies.
Classes are connected components, found by spreading the smallest text along links; everything is joined and grouped by Spark.

Defined cases: texts of fewer than five words are one shingle; texts without words are near
nothing but equal texts; a null text is an empty one; rows of null doc_id take no part
(class_id null, kept); rows of equal doc_id are compared by their texts, each by itself, and equal rows are copies; an
empty table gives an empty result; other columns pass through ``keep_one``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import RANGE_BYTES, batch_of, documents, grouped, materialize

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 8
#: Parts of the bound on what two texts share.
PARTS = 64
SEED = 20240229
#: Elements of a block of draws: keeps the arrays in the processor's cache.
BLOCK = 1 << 15
#: Words whose hashes a worker remembers.
REMEMBERED = 200_000
#: What groups send and hear about shingles and words, and what is known of a text that may have links.
SENT = "p int, q int, shingles binary, words binary, counts binary"
SIGNED = "doc long, t long, total double, shared double, keys array<long>, parts array<float>, vec binary"
#: Stands for the missing words of a text that has fewer than five.
NO_WORD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = WordHashes()
_rng = np.random.default_rng(SEED)
_odd = _rng.integers(0, 2**63, SHINGLE, np.uint64) | np.uint64(1)
_place = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64) | np.uint64(1)
_row = _rng.integers(0, 2**63, ROWS, np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes of a text's words (between ASCII white space), in order."""
    words = (text or "").encode("utf-8").split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray, idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct five-word shingles, ascending, and their weights (counts, where words have no ``idf``)."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    short = max(0, SHINGLE - len(words))
    h = np.concatenate([words, np.full(short, NO_WORD)])
    last = len(h) - SHINGLE + 1
    out = h[:last] * _odd[0]
    for j in range(1, SHINGLE):
        out += h[j : j + last] * _odd[j]
    out = _mixed(out)
    order = np.argsort(out, kind="stable")
    out = out[order]
    first = np.flatnonzero(np.append(True, out[1:] != out[:-1]))
    count = np.diff(first, append=last).astype(np.float32)
    if idf is None:
        return out[first], count
    idf = np.concatenate([idf.astype(np.float32), np.zeros(short, np.float32)])
    total = idf[:last].copy()
    for j in range(1, SHINGLE):
        total += idf[j : j + last]
    return out[first], total[order][first] * count


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log((n + 1) / (df.astype(np.float64) + 1))).astype(np.float32)


#: Draws of (r, 1 / r, ln c - r), looked up by 16 bits of a hash of shingle and place; b is another 32 bits of it.
DRAWS = 16
_draws = np.random.default_rng(SEED + 1)
_r = -np.log(_draws.random(1 << DRAWS) * _draws.random(1 << DRAWS)).astype(np.float32)
_inverse_r = (1 / _r).astype(np.float32)
_c_less_r = np.log(-np.log(_draws.random(1 << DRAWS) * _draws.random(1 << DRAWS))).astype(np.float32) - _r


def samples(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sample of each place: a 64-bit hash of the sampled (shingle, t)."""
    places = len(_place)
    best, sample = np.full(places, np.inf, np.float32), np.zeros(places, np.uint64)
    log_w, step, every = np.log(weights).astype(np.float32), max(1, BLOCK // places), np.arange(places)
    for at in range(0, len(hashes), step):
        own = hashes[at : at + step]
        x = own[:, None] * _place[None, :]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        i = (x >> np.uint64(64 - DRAWS)).astype(np.intp)
        b = x.view("<u4")[:, ::2].astype(np.float32)
        b *= np.float32(2.0**-32)
        t = _inverse_r.take(i)
        t *= log_w[at : at + step, None]
        t += b
        np.floor(t, out=t)
        b -= t
        b *= _r.take(i)
        b += _c_less_r.take(i)
        low_at = b.argmin(0)
        low = b[low_at, every]
        better = low < best
        if better.any():
            best = np.where(better, low, best)
            sample = np.where(better, _mixed(own[low_at] + t[low_at, every].astype(np.int64).astype(np.uint64) * NO_WORD), sample)
    return sample


def band_keys(sample: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ``ROWS`` samples; keys of different bands differ."""
    folded = (sample.reshape(BANDS, ROWS) * _row).sum(1, dtype=np.uint64)
    return _mixed(folded + _mixed(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (ascending hashes, weights)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = b[0][at] == a[0]
    least = float(np.minimum(a[1][both], b[1][at[both]]).sum(dtype=np.float64))
    return least / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - least)


def _packed(hashes: np.ndarray, weights: np.ndarray) -> bytes:
    return hashes.tobytes() + weights.astype("<f4").tobytes()


def _unpacked(vec: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(vec) // 12
    return np.frombuffer(vec, "<u8", n), np.frombuffer(vec, "<f4", n, 8 * n)


def _first(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def hashed_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, text) of the rows that take part."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("doc_id IS NOT NULL")
    return docs.select("doc_id", *_text_hashes(F.col("text")), "text")


def _text_hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")


def candidates(rows: DataFrame, n_texts: int, parts: int, threshold: float) -> DataFrame:
    """(node, total, shared, keys, parts, vec) of those different texts ``rows`` (node, text, q: one of ``parts`` groups) whose shared shingles weigh enough for a link."""
    least, top = threshold * (1 - 1e-6), np.uint64(33)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_group: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for q, text in zip(batch.column("q").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = word_hashes(text)
                own = of_group.setdefault(q, ([], []))
                own[0].append(shingles(words)[0])
                own[1].append(np.unique(words))
        for q in list(of_group):
            found, words = of_group.pop(q)
            s = np.concatenate(found)
            del found
            s.sort()
            first = _first(s)
            twice = np.diff(first, append=len(s)) > 1
            s = s[first]
            w, counts = np.unique(np.concatenate(words), return_counts=True)
            of_part = dict(grouped((w % np.uint64(parts)).astype(np.int64)))
            none, out = np.zeros(0, np.int64), []
            for p, own in grouped((s % np.uint64(parts)).astype(np.int64)):
                # 31 bits of the hash, and one that says whether a second text of this group has it.
                key = (s[own] >> top << np.uint64(1) | twice[own]).astype("<u4")
                mine = of_part.pop(p, none)
                out.append((p, q, key.tobytes(), w[mine].tobytes(), counts[mine].astype("<u4").tobytes()))
            out += [(p, q, b"", w[mine].tobytes(), counts[mine].astype("<u4").tobytes()) for p, mine in of_part.items()]
            yield batch_of(SENT, out)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words, counts, at_key, at_word = [], [], [], [], []
        p = None
        for batch in batches:
            for r in batch.to_pylist():
                p = r["p"]
                keys.append(np.frombuffer(r["shingles"], "<u4"))
                words.append(np.frombuffer(r["words"], "<u8"))
                counts.append(np.frombuffer(r["counts"], "<u4"))
                at_key.append(np.full(len(keys[-1]), r["q"], np.int32))
                at_word.append(np.full(len(words[-1]), r["q"], np.int32))
        if p is None:
            return
        key, group = np.concatenate(keys), np.concatenate(at_key)
        order = np.argsort(key, kind="stable")
        key, group = key[order], group[order]
        first = _first(key >> np.uint32(1))
        size = np.diff(first, append=len(key))
        several = np.repeat((size > 1) | (np.maximum.reduceat(key & np.uint32(1), first) > 0 if len(first) else size > 1), size)
        key, group = (key >> np.uint32(1))[several], group[several]
        word, count, home = np.concatenate(words), np.concatenate(counts), np.concatenate(at_word)
        order = np.argsort(word, kind="stable")
        word, count, home = word[order], count[order], home[order]
        first = _first(word)
        total = np.repeat(np.add.reduceat(count, first, dtype=np.int64), np.diff(first, append=len(word))) if len(first) else count.astype(np.int64)
        hit = total > 1
        word, total, home = word[hit], np.minimum(total[hit], 2**32 - 1).astype("<u4"), home[hit]
        known, inverse = np.unique(np.concatenate([group, home]), return_inverse=True)
        by_key, by_word = dict(grouped(inverse[: len(group)])), dict(grouped(inverse[len(group) :]))
        none, out = np.zeros(0, np.int64), []
        for g, q in enumerate(known.tolist()):
            own, mine = by_key.get(g, none), by_word.get(g, none)
            out.append((p, q, np.sort(key[own]).tobytes(), word[mine].tobytes(), total[mine].tobytes()))
        yield batch_of(SENT, out)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known = [], None
        for batch in batches:
            out = []
            for doc, t, p, blob, words, counts, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "t", "p", "shingles", "words", "counts", "text")), strict=True):
                if p is not None:
                    found.append((p, blob, words, counts))
                    continue
                if known is None:
                    shared = np.concatenate([np.uint64(p) << np.uint64(31) | np.frombuffer(s, "<u4").astype(np.uint64) for p, s, _, _ in sorted(found)] or [np.zeros(0, np.uint64)])
                    word, count = np.frombuffer(b"".join(w for _, _, w, _ in found), "<u8"), np.frombuffer(b"".join(c for _, _, _, c in found), "<u4")
                    order = np.argsort(word)
                    known = shared, word[order], count[order]
                    found.clear()
                shared, word, count = known
                h = word_hashes(text)
                hashes, weights = shingles(h, inverse_frequency(_looked_up(word, count, h), n_texts))
                if not len(hashes) or not len(shared):
                    continue
                key = hashes % np.uint64(parts) << np.uint64(31) | hashes >> top
                at = np.searchsorted(shared, key)
                at[at == len(shared)] = 0
                hit = shared[at] == key
                total, both = float(weights.sum(dtype=np.float64)), float(weights[hit].sum(dtype=np.float64))
                if both < least * total:
                    continue
                # A little more than the weights, so that the bound stays one.
                split = np.bincount((hashes[hit] >> np.uint64(58)).astype(np.int64), weights[hit].astype(np.float64) * (1 + 1e-6), PARTS).astype(np.float32)
                out.append((doc, t, total, both, band_keys(samples(hashes, weights)), split, _packed(hashes, weights)))
            if out:
                yield batch_of(SIGNED, out)

    rows = rows.select("q", F.col("node.doc").alias("doc"), F.col("node.t").alias("t"), "text")
    sent = rows.select("q", "text").mapInArrow(send, SENT)
    frequencies = materialize(sent.repartitionById(parts, F.col("p")).mapInArrow(add, SENT), "near-frequencies")
    null = lambda kind: F.lit(None).cast(kind)
    blobs = frequencies.select("q", null("long").alias("doc"), null("long").alias("t"), "p", "shingles", "words", "counts", null("string").alias("text"))
    texts = rows.select("q", "doc", "t", null("int").alias("p"), null("binary").alias("shingles"), null("binary").alias("words"), null("binary").alias("counts"), "text")
    both = blobs.unionByName(texts).repartitionById(parts, F.col("q")).sortWithinPartitions(F.col("p").asc_nulls_last())
    signed = both.select("doc", "t", "p", "shingles", "words", "counts", "text").mapInArrow(sign, SIGNED)
    return materialize(signed.select(F.struct("doc", "t").alias("node"), "total", "shared", "keys", "parts", "vec"), "near-candidates")


def _looked_up(hashes: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values of some of ``wanted``, by ascending hashes; 1 for all others."""
    if not len(hashes):
        return np.ones(len(wanted), np.uint32)
    at = np.searchsorted(hashes, wanted)
    at[at == len(hashes)] = 0
    return np.where(hashes[at] == wanted, values[at], np.uint32(1))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b): the smallest node of each one's component."""
    edges = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "near-labels")
    while True:
        around = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(around, labels["node"] == around["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        moved = materialize(lower.join(jump, "low").select("node", "old", F.least("low", "far").alias("root")), "near-labels")
        labels = moved.select("node", "root")
        if not moved.where(F.col("root") != F.col("old")).take(1):
            return labels


def _linked(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose weighted Jaccard similarity reaches the threshold."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, tuple[np.ndarray, np.ndarray]] | None = None
        for batch in batches:
            keep = []
            for one, other in zip(batch.column("one").to_pylist(), batch.column("other").to_pylist(), strict=True):
                if last is None or last[0] != other:
                    last = (other, _unpacked(other))
                keep.append(weighted_jaccard(_unpacked(one), last[1]) >= threshold)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda end, vec: vectors.select(F.col("node").alias(end), F.col("vec").alias(vec))
    node = "struct<doc: bigint, t: bigint>"
    return materialize(pairs.join(side("a", "one"), "a").join(side("b", "other"), "b").select("a", "b", "one", "other").mapInArrow(verify, f"a {node}, b {node}"), "near-links")


def links_of(texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(links (a, b), classes (node, root)) of ``texts`` as ``candidates`` gives them; a node without links has no class."""
    # No pair can reach the threshold whose lesser shared weight is less than this share of both weights.
    enough = lambda shared, total: (1 + threshold) * shared >= threshold * (1 - 1e-6) * total
    bands = materialize(texts.select(F.explode("keys").alias("key"), "node", "total", "shared").distinct(), "near-bands")
    sizes = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialize(bands.join(sizes, "key"), "near-shared")
    central = buckets.groupBy("node").agg(F.sum("n").alias("central"))
    buckets = materialize(buckets.drop("n").join(central, "node"), "near-buckets")

    best = F.max_by(F.struct("node", "total", "shared"), F.struct("central", F.bitwise_not("node.doc"), F.bitwise_not("node.t")))
    pivots = buckets.groupBy("key").agg(best.alias("pivot"))
    met = buckets.join(pivots, "key").where((F.col("node") != F.col("pivot.node")) & enough(F.least("shared", "pivot.shared"), F.col("total") + F.col("pivot.total")))
    pairs = materialize(met.select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b")).distinct(), "near-pairs")
    vectors = texts.select("node", "vec")
    links = _linked(pairs, vectors, threshold)
    roots = components(links)

    rooted = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("total").alias("least_total"), F.max("shared").alias("most_shared")).where("lo <> hi")
    rest = materialize(rooted.join(mixed.drop("lo", "hi"), "key").drop("central"), "near-rest")
    main = rest.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    rest = materialize(rest.join(main, "key").join(texts.select("node", "parts"), "node"), "near-rest")
    few = rest.where((F.col("root") != F.col("main")) & enough(F.least("shared", "most_shared"), F.col("total") + F.col("least_total")))
    few = few.select("key", F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("total").alias("a_total"), F.col("shared").alias("a_shared"), F.col("parts").alias("a_parts"))
    common = F.aggregate(F.zip_with("a_parts", "parts", lambda x, y: F.least(x, y).cast("double")), F.lit(0.0), lambda x, y: x + y)
    open_ = (F.col("root") != F.col("a_root")) & ((F.col("root") == F.col("main")) | (F.col("a") < F.col("node")))
    open_ &= enough(F.least("shared", "a_shared"), F.col("total") + F.col("a_total")) & enough(common, F.col("total") + F.col("a_total"))
    further = materialize(few.hint("merge").join(rest, "key").where(open_).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct(), "near-pairs")
    more = _linked(further, vectors, threshold)
    # Only few classes meet in the second step: join these, and carry the result over.
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    between = more.join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = components(between.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    both = roots.unionByName(joined.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    higher = joined.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    classes = both.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return links.unionByName(more), materialize(classes, "near-classes")


def classes_of(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, h1, h2, node, root, n_links) for each row of ``docs`` with a doc_id; node and root are the first rows of the text and of its class."""
    rows = hashed_rows(docs)
    hashed = materialize(rows.select("doc_id", "h1", "h2", F.octet_length("text").alias("size")), "near-hashed")
    texts = materialize(hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.first("size").alias("size")), "near-texts")
    n_texts, n_bytes = texts.agg(F.count("*"), F.sum("size")).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((n_bytes or 0) / RANGE_BYTES))
    first = texts.select("h1", "h2", F.col("doc").alias("doc_id"))
    # doc_id is part of the key, so that the rows of one text are not all joined in one task.
    key = ["h1", "h2", "doc_id"]
    one = rows.repartition(parts, *key).join(first.repartition(parts, *key).hint("merge"), key, "left_semi").dropDuplicates(key)
    # A group is what one task writes, so that a later task reads whole groups without moving texts again.
    distinct = one.select(F.struct(F.col("doc_id").alias("doc"), F.col("h1").alias("t")).alias("node"), "text", F.pmod(F.hash(*key), F.lit(parts)).alias("q"))
    links, classes = links_of(candidates(materialize(distinct, "near-distinct"), n_texts, parts, threshold), threshold)
    ends = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    texts = texts.select("h1", "h2", F.struct("doc", F.col("h1").alias("t")).alias("node"))
    texts = texts.join(classes, "node", "left").join(ends, "node", "left")
    texts = texts.select("h1", "h2", "node", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return hashed.select("doc_id", "h1", "h2").join(materialize(texts, "near-texts"), ["h1", "h2"])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of ``docs`` (doc_id, text).

    class_id: the smallest doc_id of its class of near-duplicates; n_links: the different texts that the row's text
    was compared with and linked to (pairs that are in one class already are not compared).
    """
    found = classes_of(docs, threshold).select("doc_id", F.col("root.doc").alias("class_id"), "n_links")
    alone = docs.where("doc_id IS NULL").select(*[F.lit(None).cast("long").alias(c) for c in ("doc_id", "class_id")], F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(alone)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: the one of smallest doc_id. Null doc_ids stay."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    rows = rows.withColumn("_id", F.col("_row.doc_id").cast("long"))
    h1, h2 = _text_hashes(F.coalesce(F.col("_row.text"), F.lit("")))
    known = rows.where("_id IS NOT NULL").select("_row", "_id", h1.alias("_h1"), h2.alias("_h2"))
    stay = classes_of(docs.select("doc_id", "text"), threshold).where("node = root AND doc_id = node.doc").select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
    first = Window.partitionBy("_id", "_h1", "_h2").orderBy(F.xxhash64("_row"))
    known = known.join(stay.hint("merge"), ["_id", "_h1", "_h2"], "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return known.select("_row").unionByName(rows.where("_id IS NULL").select("_row")).select("_row.*")


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
