"""Operator 13: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by adaptive multi-match prefixes.

Two sets of n and m shingles that reach the threshold share at least t = ceil(0.8 max(n, m)) of them. Under any order of all
shingles, their first n - t + l and m - t + l shingles then share at least l: the l-prefixes of multi-match filtering. With
l = 1 that is the usual prefix filter; a longer prefix demands more matches before a pair is verified.

1. Sets. Words are lower-cased and hashed, shingles are 64-bit hashes. Documents with equal sets are one class and go on as one set, so copies are
   never paired.
2. Screen. In order of their hashes, each set's prefix with l = 1 + n / 10 is counted. A set can have a partner only if as
   many of its prefix's shingles as the smallest partner's l are in another set's prefix. Few sets are left.
3. Order. For these, all shingles are counted exactly; from here on the order is by number of sets, then hash: rare ones first. A set with less than t
   shingles that a second set holds has no partner.
4. Adaptive prefixes. The lists that a set's prefix meets are known: lengthening it to l costs the lists of l - 1 more shingles and saves
   verifications, as a candidate has to be met l times. Each set takes the l (1, 2, 4, ...) of the least estimated cost.
5. Candidates are sets that meet in a shingle of their shortest prefixes, of fitting sizes. A pair is verified if its two
   prefixes share at least the lesser of their two l, and then exactly, by the whole sets. In each list all sets are first compared with one (the one that meets
   most others); of the classes that this leaves in a list, the sets outside the largest are compared with those of other classes, except where
   counts of shared shingles in ``PARTS`` parts rule the pair out. Pairs within one component are never needed again.
6. Components are found by spreading the smallest number along links.

Everything is counted, joined and grouped by Spark; hot shingles are pre-aggregated or split by skew joins between written tables.

Defined cases: fewer than five words are one shingle; texts without words (and null ones) have no shingles, are linked with nothing and
are their own component; rows of null doc_id take no part (component_id null); rows of equal doc_id are documents of their own
by their sets; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_dup import _words, components, shingles
from .shared import documents, materialize

PERCENT = 80
#: The screen's l is 1 + n / SCREEN.
SCREEN = 10
PARTS = 64
#: Cost of one shingle of a verification against that of an entry of a list.
VERIFY_COST = 0.1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SETS = "doc_id long, n long, s1 long, s2 long, tokens array<long>"
_SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("tokens", pa.list_(pa.int64()))])
PREFIXES = "v long, n long, shared long, l long, keys array<long>, prefix array<long>, parts array<int>"
_PREFIXES = pa.schema([("v", pa.int64()), ("n", pa.int64()), ("shared", pa.int64()), ("l", pa.int64()), ("keys", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("parts", pa.list_(pa.int32()))])


def shingle_set(text: str | None) -> np.ndarray:
    """The hashes of a text's shingles, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return shingles(np.fromiter(map(_words.__getitem__, words), np.uint64, len(words)))[0]


def least_overlap(n: int, percent: int) -> int:
    """What a set of n shingles shares with any partner, at least."""
    return -(-percent * n // 100)


def screen_length(n: int, percent: int) -> int:
    return min(n, n - least_overlap(n, percent) + 1 + n // SCREEN)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def sets_of(docs: DataFrame, percent: int, whole: bool) -> DataFrame:
    """(doc_id, n, s1, s2, tokens) of each row; tokens: the whole set, or the screen's prefix. s1 and s2 tell sets apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, tokens, size, at = [], [], [], 0, 0
            ids = batch.column("doc_id")

            def made(end: int) -> pa.RecordBatch:
                h = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
                return pa.RecordBatch.from_arrays([ids.slice(at, end - at), pa.array(n, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), _lists(tokens, pa.int64())], schema=_SETS)

            for i, text in enumerate(batch.column("text")):
                own = shingle_set(text.as_py())
                n.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                tokens.append((own if whole else own[: screen_length(len(own), percent)]).view(np.int64))
                size += len(tokens[-1])
                if size >= 1 << 20:
                    yield made(i + 1)
                    n, keys, tokens, size, at = [], [], [], 0, i + 1
            if n:
                yield made(batch.num_rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SETS)


def _counted(tokens: DataFrame, name: str) -> DataFrame:
    """(token, df) of the tokens that two rows or more have, as a table."""
    return materialize(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), name)


def screened(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The ``classes`` (s1, s2, doc, n) that may have a partner, by the prefixes in ``sets``.

    Rows of one class count each; so a class of copies may be kept for nothing, and none is lost.
    """
    tokens = sets.select("s1", F.explode("tokens").alias("token"))
    several = tokens.groupBy("token").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo <> hi").select("token")
    met = tokens.join(materialize(several, "join-screen"), "token").groupBy("s1").agg(F.count("*").alias("met"))
    # A partner has at least percent of n shingles, so its l is no less than this.
    least = 1 + F.floor(F.ceil(F.col("n") * percent / 100) / SCREEN)
    return materialize(classes.join(met, "s1").where(F.col("met") >= least).drop("met"), "join-screened")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(v, n, shared, l, keys, prefix, parts) of those of ``sets`` (v, n, tokens) that may have a partner, under the order by frequency.

    keys: the shortest prefix's shingles that another set holds; prefix: those of the l-prefix; parts: how many shared shingles fall in each part of the hashes.
    """
    tokens = sets.select("v", "n", F.explode("tokens").alias("token"))
    shared = tokens.join(_counted(tokens.select("token"), "join-frequencies"), "token")
    of_set = shared.groupBy("v", "n").agg(F.collect_list("token").alias("tokens"), F.collect_list("df").alias("dfs"))  # no more than the set's shingles
    of_set = of_set.where(F.size("tokens") * 100 >= F.col("n") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v, n, tokens, dfs in zip(batch.column("v").to_pylist(), batch.column("n").to_pylist(), batch.column("tokens"), batch.column("dfs"), strict=True):
                token, df = tokens.values.to_numpy(), dfs.values.to_numpy()
                order = np.lexsort((token, df))
                token, df = token[order], df[order]
                # Shingles that no other set has come first in the order; they fill a part of every prefix.
                shortest = n - least_overlap(n, percent) + 1 - (n - len(token))
                l = chosen_matches(df, n, shortest)  # noqa: E741
                out.append((v, n, len(token), l, token[:shortest], token[: shortest + l - 1], np.bincount(token.view(np.uint64) >> np.uint64(58), minlength=PARTS)))
            if out:
                v, n, held, l, keys, prefix, parts = zip(*out, strict=True)  # noqa: E741
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (v, n, held, l)] + [_lists(list(keys), pa.int64()), _lists(list(prefix), pa.int64()), _lists(list(parts), pa.int32())], schema=_PREFIXES)

    return materialize(of_set.mapInArrow(run, PREFIXES), "join-adaptive")


def chosen_matches(df: np.ndarray, n: int, shortest: int) -> int:
    """The l of least estimated cost: entries of the lists of the l-prefix, and verifications of sets that are met l times.

    ``df``: in how many sets each of a set's shared shingles is, rarest first.
    """
    entries = np.cumsum(df - 1)
    best, cost, l = 1, np.inf, 1  # noqa: E741
    while shortest + l - 1 <= len(df):
        met = float(entries[shortest + l - 2])
        now = met + met / l * n * VERIFY_COST
        if now < cost:
            best, cost = l, now
        l *= 2  # noqa: E741
    return best


def _linked(pairs: DataFrame, sets: DataFrame, prefixed: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that share enough of their prefixes, and reach the threshold."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = [batch.column(c) for c in ("a_l", "b_l", "a_prefix", "b_prefix", "a_tokens", "b_tokens")]
            for i in range(batch.num_rows):
                need = min(columns[0][i].as_py(), columns[1][i].as_py())
                few, many, one, other = (c[i].values.to_numpy().view(np.uint64) for c in columns[2:])
                if len(np.intersect1d(few, many, assume_unique=True)) < need:
                    keep.append(False)
                    continue
                at = np.searchsorted(other, one)
                at[at == len(other)] = 0
                both = int((other[at] == one).sum())
                keep.append(100 * both >= percent * (len(one) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    known = prefixed.select("v", "l", "prefix").join(sets.select("v", "tokens"), "v")
    side = lambda end: known.select(F.col("v").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("l", "prefix", "tokens")])
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return materialize(joined.mapInArrow(verify, "a long, b long"), "join-links")


def _pairs(one: str, other: str) -> list:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def links(sets: DataFrame, prefixed: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between sets that connect whatever all links would connect."""
    entries = materialize(prefixed.select("v", "n", "shared", F.explode("keys").alias("key")), "join-entries")
    sizes = materialize(entries.groupBy("key").agg(F.count("*").alias("met")).where("met > 1"), "join-sizes")
    lists = materialize(entries.join(sizes, "key"), "join-lists")
    central = lists.groupBy("v").agg(F.sum("met").alias("central"))
    pivots = lists.join(central, "v").groupBy("key").agg(F.max_by(F.struct("v", "n", "shared"), F.struct("central", "v")).alias("p"))

    def fits(n: str, m: str, shared: str, other: str):  # noqa: ANN202
        both = F.least(F.col(shared), F.col(other))
        sized = (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)
        return sized & (both * (100 + percent) >= (F.col(n) + F.col(m)) * percent)

    near = lists.join(materialize(pivots, "join-pivots"), "key").where((F.col("v") != F.col("p.v")) & fits("n", "p.n", "shared", "p.shared"))
    first = _linked(materialize(near.select(*_pairs("v", "p.v")).distinct(), "join-pairs"), sets, prefixed, percent)

    rooted = lists.select("key", "v", "n", "shared").join(components(first).select(F.col("node").alias("v"), "root"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    # Sizes in bands of the threshold's ratio: partners are in one band or in neighbouring ones.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)))
    rest = rooted.join(materialize(mixed, "join-mixed"), "key").join(prefixed.select("v", "parts"), "v").withColumn("band", band)
    rest = materialize(rest, "join-rest")
    most = rest.groupBy("key", "root").agg(F.count("*").alias("members")).groupBy("key").agg(F.max_by("root", F.struct("members", "root")).alias("main"))
    few = rest.join(materialize(most, "join-main"), "key").where(F.col("root") != F.col("main"))
    few = few.select("key", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "main", *[F.col(c).alias(f"x_{c}") for c in ("v", "n", "shared", "root", "parts")])
    common = F.aggregate(F.zip_with("x_parts", "parts", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    open_ = (F.col("root") != F.col("x_root")) & ((F.col("root") == F.col("main")) | (F.col("x_v") < F.col("v"))) & fits("n", "x_n", "shared", "x_shared")
    open_ &= common * (100 + percent) >= (F.col("n") + F.col("x_n")) * percent
    further = materialize(few.hint("merge").join(rest, ["key", "band"]).where(open_).select(*_pairs("v", "x_v")).distinct(), "join-pairs")
    return first.unionByName(_linked(further, sets, prefixed, percent))


def joined(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    sets = materialize(sets_of(docs, percent, False), "join-sets")
    known = sets.where("doc_id IS NOT NULL AND n > 0")
    classes = materialize(known.groupBy("s1", "s2").agg(F.min("doc_id").alias("doc"), F.min("n").alias("n")), "join-classes")
    left = screened(known, classes, percent)
    # The texts of what is left are read again, instead of keeping the whole sets of all documents.
    wanted = left.select(F.col("doc").alias("doc_id")).distinct().hint("merge")  # it grows with the table: never sent to every task
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    whole = sets_of(texts, percent, True).join(left.select("s1", "s2", F.col("doc").alias("doc_id")), ["s1", "s2", "doc_id"], "left_semi").dropDuplicates(["s1", "s2"])
    whole = materialize(whole.withColumn("v", F.monotonically_increasing_id()).withColumnRenamed("doc_id", "doc"), "join-whole")
    numbered = whole.select("v", "n", "tokens")
    classes_of = components(links(numbered, prefixes(numbered, percent), percent))
    members = whole.select("s1", "s2", "doc", "v").join(classes_of.select(F.col("node").alias("v"), "root"), "v")
    least = members.groupBy("root").agg(F.min("doc").alias("component"))
    found = members.join(least, "root").select("s1", "s2", "component")
    all_classes = classes.select("s1", "s2", "doc").join(found, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("component", "doc").alias("component_id"))
    rows = known.select("doc_id", F.col("n").alias("n_shingles"), "s1", "s2").join(materialize(all_classes, "join-components"), ["s1", "s2"])
    alone = sets.where("doc_id IS NULL OR n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.select("doc_id", "n_shingles", "component_id").unionByName(alone)


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(documents(spark, sf_dir).select("doc_id", "text"))


OP13_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (
        SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM grams GROUP BY doc_id),
edges AS MATERIALIZED (
    SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
    JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
    WHERE 100 * n_both >= 80 * (s.n + t.n - n_both)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
