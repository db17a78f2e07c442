"""Operator 9: removal of repeated 50-byte strings by a sparse suffix order, range-partitioned by sampled splitters.

Whether a 50-byte string also starts in a document of smaller doc_id is decided by sorting
suffixes. Only suffixes at anchors are sorted: an anchor of a string is the place, among its
first ``WINDOWS``, whose ``GRAM`` bytes have the least hash (the leftmost of these). Equal
strings have equal anchors, so nothing is lost, and there are some 14 times fewer suffixes
than bytes (all of them, with 50 bytes each, would be 50 times the input).

1. Suffixes are ordered by their leading ``GRAM`` bytes, as ``WORDS`` tokens of eight bytes each, and dealt into ranges of this
   order by splitters taken from a bounded sample. A range's task sorts by multikey quicksort: by the first token, then, of those that tie,
   by the next. Neighbours are compared to find the prefixes that at least two rows hold. Ranges end between different prefixes, so a prefix's
   suffixes never lie on two sides of a boundary, and where one first token holds very many suffixes,
   the splitters cut by the tokens after it. A batch of documents sends each
   of its prefixes once, so a passage that very many documents hold is not one task's load.
2. For those prefixes only, the bytes around the anchor (all strings that have this anchor) follow
   the same way, again once per batch and distinct context, with the smallest document
   that has it. Within a range they are sorted in suffix order, then by context. Of equal contexts all but the
   smallest document's are repeats as a whole; where a prefix has several contexts, their
   50-byte strings are sorted, by multikey quicksort over their bytes, and neighbours are compared. One task handles a prefix's distinct
   contexts, so its memory grows with their number.
3. Removed intervals go back to their documents, and what is left is put together.

Texts are moved by a hash of the row, twice; nothing else of their size is moved. A step of the local sorts is numpy's sort of
8-byte tokens, as compiled code and in bounded memory.

Strings are compared byte by byte; equal contexts are told by 128 bits of hash, and rows (doc_id and text) by 64. Defined cases: a null text is empty; texts of
fewer than 50 bytes lose nothing; null doc_ids are one document after all others, and rows
of equal doc_id one document, of which each row is cleaned by itself; an empty table gives an
empty result; columns other than doc_id and text are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LAST_ID, RANGE_BYTES, documents, grouped, materialize, uniform

#: Length of the strings, of an anchor's gram, and how many grams begin in a string.
LENGTH, GRAM = 50, 24
WINDOWS = LENGTH - GRAM + 1
#: Tokens of eight bytes of a suffix's leading bytes.
WORDS = GRAM // 8
#: Documents whose suffix keys give the splitters, at most, and keys of each.
SAMPLE_DOCS, SAMPLE_KEYS = 2000, 64
SEED = 50
#: Bytes of pairs or spans that a task gathers before it passes them on.
GATHERED = 8 << 20

_rng = np.random.default_rng(SEED)
_byte = _rng.integers(0, 2**63, (2, 256), np.uint64)
_mul = [int(x) * 2 + 1 for x in _rng.integers(2**61, 2**62, 2)]
_inv = [pow(m, -1, 2**64) for m in _mul]
_odd = np.uint64(0xD6E8FEB86659FD93)
_token_odd = _rng.integers(0, 2**63, WORDS, np.uint64) | np.uint64(1)

#: What is sent of a context: its row's place in the batch's list, first string's start, number of strings, the anchor's place in it.
SENT = np.dtype([("row", "<u4"), ("start", "<u4"), ("windows", "u1"), ("anchor", "u1")])
CONTEXT = np.dtype([("c1", "<u8"), ("c2", "<u8"), ("doc", "<i8"), ("rid", "<i8"), ("start", "<u4"), ("windows", "<u4"), ("anchor", "<u4")])
SPAN = np.dtype([("rid", "<i8"), ("start", "<u4"), ("end", "<u4")])
PAIR = np.dtype([("rid", "<i8"), ("key", "<u8")])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(32)
    x *= _odd
    x ^= x >> np.uint64(29)
    x *= _odd
    return x ^ x >> np.uint64(32)


_known_powers = np.ones((4, 1), np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers of the multipliers and their inverses, at least n; a worker keeps the longest list."""
    global _known_powers
    if _known_powers.shape[1] < n:
        out = np.empty((4, max(1 << 16, 1 << n.bit_length())), np.uint64)
        for row, m in zip(out, [*_mul, *_inv], strict=True):
            row[0] = 1
            row[1:] = np.uint64(m)
            np.multiply.accumulate(row, out=row)
        _known_powers = out
    return _known_powers


class Hashes:
    """Hashes of any substring of some bytes, in two versions."""

    def __init__(self, data: np.ndarray, versions: int = 1) -> None:
        n = len(data)
        self.powers = _powers(n + 1)
        self.sums = []
        for v in range(versions):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(_byte[v][data] * self.powers[v, :n], out=s[1:])
            self.sums.append(s)

    def of(self, start: np.ndarray, end: np.ndarray, version: int = 0) -> np.ndarray:
        s = self.sums[version]
        return _mixed((s[end] - s[start]) * self.powers[2 + version][start])


def tokens_at(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n tokens of eight bytes that begin at each place, as numbers in the bytes' order."""
    bytes_at = np.lib.stride_tricks.sliding_window_view(data, 8 * n)[at] if len(at) else np.zeros((0, 8 * n), np.uint8)
    return np.ascontiguousarray(bytes_at).view(">u8").astype("<u8")


def multikey_order(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of rows of tokens: sorted by the first, of the rows that tie by the next, and so on; equal rows are one group."""
    order = np.argsort(tokens[:, 0], kind="stable")
    group = np.cumsum(_first_of_runs(tokens[order, 0])) - 1
    for j in range(1, tokens.shape[1]):
        tied = np.flatnonzero((np.bincount(group) > 1)[group]) if len(group) else group
        if not len(tied):
            break
        rows = order[tied]
        order[tied] = rows[np.lexsort((tokens[rows, j], group[tied]))]
        group = np.cumsum(_first_of_runs(group, tokens[order, j])) - 1
    return order, group


def prefix_keys(tokens: np.ndarray) -> np.ndarray:
    """A hash of each row's leading bytes, by which rows are told what they share."""
    out = np.zeros(len(tokens), np.uint64)
    for j, m in enumerate(_token_odd):
        out += tokens[:, j] * m
    return _mixed(out)


def _as_bytes(tokens: np.ndarray) -> np.ndarray:
    """Rows of tokens as strings that compare alike."""
    return np.frombuffer(tokens.astype(">u8").tobytes(), f"S{8 * tokens.shape[1]}")


def ranges_of(tokens: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The range of each row, of rows in order."""
    starts = np.searchsorted(_as_bytes(tokens), _as_bytes(splitters), "left")
    return np.searchsorted(starts, np.arange(len(tokens)), "right")


def _sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """f over each window of ``width`` items."""
    have = 1
    while have * 2 <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def context_hashes(hashes: Hashes, first: np.ndarray, end: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the bytes from first to end and of the anchor's place in them."""
    return hashes.of(first, end) ^ _mixed(anchor.astype(np.uint64) + np.uint64(1)), hashes.of(first, end, 1) + (end - first).astype(np.uint64)


class Anchors:
    """The anchors of one text's 50-byte strings."""

    def __init__(self, data: np.ndarray, versions: int = 1) -> None:
        n = len(data)
        self.hashes = Hashes(data, versions)
        at = np.arange(n - GRAM + 1)
        self.gram = self.hashes.of(at, at + GRAM)
        self.least = _sliding(self.gram, WINDOWS, np.minimum)
        none = np.zeros(WINDOWS - 1, np.uint64)
        widest = _sliding(np.concatenate([none, self.least, none]), WINDOWS, np.maximum)
        self.at = np.flatnonzero(widest == self.gram)
        self.tokens = tokens_at(data, self.at, WORDS)
        self.keys = prefix_keys(self.tokens)

    def ranges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors (their indexes) that own strings, with the first and the last start of these."""
        starts = np.arange(len(self.least))
        owner = np.searchsorted(self.at, starts)
        while len(wrong := np.flatnonzero(self.gram[self.at[owner]] != self.least)):
            owner[wrong] += 1
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        last = np.append(first[1:], len(owner)) - 1
        return owner[first], first, last


def _data(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8"), np.uint8)


def _first_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _batch(names: list[str], rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(rows of documents with rid, doc and q; removed spans packed by q; number of q) for ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"))
    rows = rows.withColumn("rid", F.xxhash64("doc", "text"))
    n_docs, n_bytes = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((n_bytes or 0) / RANGE_BYTES))
    rows = rows.withColumn("q", F.pmod("rid", F.lit(parts)).cast("int"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [Anchors(d).tokens for t in batch.column("text").to_pylist() if len(d := _data(t)) >= LENGTH]
            yield pa.RecordBatch.from_arrays([pa.array([k[:: max(1, len(k) // SAMPLE_KEYS)][:SAMPLE_KEYS].tobytes() for k in keys], pa.binary())], names=["keys"])

    chosen = rows.where(uniform(F.col("rid"), seed=SEED) < min(1.0, SAMPLE_DOCS / max(n_docs, 1))).select("text").limit(2 * SAMPLE_DOCS)
    found = np.frombuffer(b"".join(bytes(r[0]) for r in chosen.mapInArrow(sample, "keys binary").collect()), "<u8").reshape(-1, WORDS)
    found = found[multikey_order(found)[0]]
    splitters = found[np.arange(1, parts) * len(found) // parts] if len(found) else np.zeros((parts - 1, WORDS), np.uint64)

    def anchor_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_tokens, all_docs = [], []
            rids = batch.column("rid").to_numpy()
            for i, text in enumerate(batch.column("text").to_pylist()):
                if len(d := _data(text)) >= LENGTH:
                    own = Anchors(d).tokens
                    all_tokens.append(own)
                    all_docs.append(np.full(len(own), i, np.uint32))
            if not all_tokens:
                continue
            tokens, idx = np.concatenate(all_tokens), np.concatenate(all_docs)
            order, run = multikey_order(tokens)
            tokens, idx = tokens[order], idx[order]
            once = _first_of_runs(run, idx)  # a row's equal prefixes follow each other
            tokens, idx, run = tokens[once], idx[once], run[once]
            first = np.flatnonzero(_first_of_runs(run))
            # By row, not by document: every row of a document must hear of a copy that another batch has.
            rids_here = rids[idx]
            several = np.minimum.reduceat(rids_here, first) < np.maximum.reduceat(rids_here, first)
            local = several[run]
            pairs = np.zeros(int(local.sum()), PAIR)
            pairs["rid"], pairs["key"] = rids_here[local], prefix_keys(tokens[local])
            part = ranges_of(tokens, splitters)
            known = dict(grouped(part[local]))
            out = []
            for p, own in grouped(part[first]):
                who, index = np.unique(rids_here[first[own]], return_inverse=True)
                out.append((p, tokens[first[own]].tobytes(), who.tobytes(), index.astype("<u2" if len(who) < 1 << 16 else "<u4").tobytes(), several[own].tobytes(), pairs[known[p]].tobytes() if p in known else b""))
            yield _batch(["p", "keys", "who", "index", "several", "local"], out, [pa.int32(), *[pa.binary()] * 5])

    def by_row(pairs: np.ndarray, column: str) -> pa.RecordBatch:
        out = [(q, pairs[own].tobytes()) for q, own in grouped(pairs["rid"] % parts)]
        return _batch(["q", column], out, [pa.int32(), pa.binary()])

    def gathered(blobs: list[bytes], kind: np.dtype, column: str, least: int = 0) -> Iterator[pa.RecordBatch]:
        """Passes on what ``blobs`` have, and empties the list, once they have ``least`` bytes."""
        if blobs and sum(map(len, blobs)) >= least:
            out = by_row(np.frombuffer(b"".join(blobs), kind), column)
            blobs.clear()
            yield out

    def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rids, several, known = [], [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                k, who = np.frombuffer(r["keys"], "<u8").reshape(-1, WORDS), np.frombuffer(r["who"], "<i8")
                index = np.frombuffer(r["index"], "<u2" if len(who) < 1 << 16 else "<u4")
                keys.append(k)
                rids.append(who[index])
                several.append(np.frombuffer(r["several"], bool))
                if r["local"]:
                    known.append(r["local"])
            yield from gathered(known, PAIR, "pairs", GATHERED)
        if not keys:
            yield from gathered(known, PAIR, "pairs")
            return
        tokens, rid, many = np.concatenate(keys), np.concatenate(rids), np.concatenate(several)
        keys.clear()
        order, run = multikey_order(tokens)
        hit = order[(np.bincount(run)[run] > 1) & ~many[order]]
        pairs = np.zeros(len(hit), PAIR)
        pairs["rid"], pairs["key"] = rid[hit], prefix_keys(tokens[hit])
        yield from gathered([*known, pairs.tobytes()], PAIR, "pairs")

    sent = rows.select("rid", "text").mapInArrow(anchor_keys, "p int, keys binary, who binary, index binary, several binary, local binary")
    shared = materialize(sent.repartitionById(parts, F.col("p")).mapInArrow(shared_keys, "q int, pairs binary"), "suffix-keys")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, pairs = [], None
        for batch in batches:
            records, regions, kept, leads = [], [], [], []
            for blob, rid, doc, text in zip(*(batch.column(c).to_pylist() for c in ("blob", "rid", "doc", "text")), strict=True):
                if blob is not None:
                    found.append(np.frombuffer(blob, PAIR))
                    continue
                if pairs is None:
                    pairs = np.concatenate([np.zeros(0, PAIR), *found])
                    pairs = pairs[np.argsort(pairs["rid"], kind="stable")]
                a, b = np.searchsorted(pairs["rid"], rid), np.searchsorted(pairs["rid"], rid, "right")
                if a == b or len(data := _data(text)) < LENGTH:
                    continue
                anchors = Anchors(data, 2)
                owner, first, last = anchors.ranges()
                hit = np.isin(anchors.keys[owner], pairs["key"][a:b])
                owner, first, last = owner[hit], first[hit], last[hit]
                own = np.zeros(len(owner), CONTEXT)
                own["doc"], own["rid"], own["start"], own["windows"], own["anchor"] = doc, rid, first, last - first + 1, anchors.at[owner] - first
                own["c1"], own["c2"] = context_hashes(anchors.hashes, first, last + LENGTH, own["anchor"])
                records.append(own)
                kept.append(data)
                leads.append(anchors.tokens[owner])
                regions.append(np.full(len(own), len(kept) - 1))
            if not records:
                continue
            own, text_of, tokens = np.concatenate(records), np.concatenate(regions), np.concatenate(leads)
            order, prefix = multikey_order(tokens)
            own, text_of, tokens = own[order], text_of[order], tokens[order]
            order = np.lexsort((own["start"], own["rid"], own["doc"], own["c2"], own["c1"], prefix))
            own, text_of = own[order], text_of[order]  # tokens and prefixes stay as they are
            new = _first_of_runs(prefix, own["c1"], own["c2"])
            least = own["doc"][np.flatnonzero(new)[np.cumsum(new) - 1]]
            gone = own["doc"] > least
            # Of a document's own equal contexts, each must hear of a repeat elsewhere, so all stay that aren't decided yet.
            own_p, done = ranges_of(tokens, splitters), np.zeros(int(gone.sum()), SPAN)
            done["rid"], done["start"], done["end"] = own["rid"][gone], own["start"][gone], own["start"][gone] + own["windows"][gone] + LENGTH - 1
            done_p = dict(grouped(own_p[gone]))
            stay = np.flatnonzero(~gone)
            out = []
            for p, at in grouped(own_p[stay]):
                at = stay[at]
                raw = b"".join(kept[t][s : s + w + LENGTH - 1].tobytes() for t, s, w in zip(text_of[at], own["start"][at], own["windows"][at], strict=True))
                _, one, row = np.unique(own["rid"][at], return_index=True, return_inverse=True)
                sent = np.zeros(len(at), SENT)
                sent["row"] = row
                for name in ("start", "windows", "anchor"):
                    sent[name] = own[name][at]
                who = own[at][one][["doc", "rid"]]
                out.append((p, sent.tobytes(), np.stack([who["doc"], who["rid"]]).tobytes(), raw, done[done_p[p]].tobytes() if p in done_p else b""))
            yield _batch(["p", "sent", "who", "raw", "done"], out, [pa.int32(), *[pa.binary()] * 4])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, raws, leads, known = [], [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                sent, raw = np.frombuffer(r["sent"], SENT), np.frombuffer(r["raw"], np.uint8)
                docs_of, rids_of = np.frombuffer(r["who"], "<i8").reshape(2, -1)
                own = np.zeros(len(sent), CONTEXT)
                for name in ("start", "windows", "anchor"):
                    own[name] = sent[name]
                own["doc"], own["rid"] = docs_of[sent["row"]], rids_of[sent["row"]]
                end = np.cumsum(own["windows"].astype(np.int64) + LENGTH - 1)
                own["c1"], own["c2"] = context_hashes(Hashes(raw, 2), np.append(0, end[:-1]), end, own["anchor"])
                leads.append(tokens_at(raw, np.append(0, end[:-1]) + own["anchor"], WORDS))
                records.append(own)
                raws.append(raw)
                if r["done"]:
                    known.append(r["done"])
            yield from gathered(known, SPAN, "spans", GATHERED)
        if not records:
            yield from gathered(known, SPAN, "spans")
            return
        own, raw = np.concatenate(records), np.concatenate(raws)
        size = own["windows"].astype(np.int64) + LENGTH - 1
        place = np.cumsum(size) - size
        order, group = multikey_order(np.concatenate(leads))
        leads.clear()
        own, place = own[order], place[order]
        order = np.lexsort((own["doc"], own["c2"], own["c1"], group))
        own, place = own[order], place[order]
        new = _first_of_runs(group, own["c1"], own["c2"])
        least = own["doc"][np.flatnonzero(new)[np.cumsum(new) - 1]]
        gone = own["doc"] > least
        spans = np.zeros(int(gone.sum()), SPAN)
        spans["rid"], spans["start"], spans["end"] = own["rid"][gone], own["start"][gone], own["start"][gone] + own["windows"][gone] + LENGTH - 1
        known.append(spans.tobytes())
        yield from gathered(known, SPAN, "spans", GATHERED)
        several = np.bincount(group, weights=new)[group] > 1
        open_ = np.flatnonzero(~gone & several)
        # In blocks of whole keys, so that the strings' arrays stay small.
        weight = np.cumsum(own["windows"][open_].astype(np.int64))
        cuts = [0]
        while cuts[-1] < len(open_):
            base = weight[cuts[-1] - 1] if cuts[-1] else 0
            end = int(np.searchsorted(weight, base + (1 << 18), "right"))
            end = max(end, cuts[-1] + 1)
            while end < len(open_) and group[open_[end]] == group[open_[end - 1]]:
                end += 1
            cuts.append(end)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = open_[a:b]
            n = own["windows"][at].astype(np.int64)
            which = np.repeat(at, n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            # The last token ends with the string, so it has some bytes of the one before.
            begin = np.repeat(place[at], n) + within
            strings = np.concatenate([tokens_at(raw, begin, LENGTH // 8), tokens_at(raw, begin + LENGTH - 8, 1)], axis=1)
            order, equal = multikey_order(strings)
            which, within = which[order], within[order]
            order = np.lexsort((own["doc"][which], equal))
            which, within = which[order], within[order]
            new = _first_of_runs(equal)
            docs_of = own["doc"][which]
            hit = docs_of > docs_of[np.flatnonzero(new)[np.cumsum(new) - 1]]
            spans = np.zeros(int(hit.sum()), SPAN)
            spans["rid"], spans["start"] = own["rid"][which[hit]], own["start"][which[hit]] + within[hit]
            spans["end"] = spans["start"] + LENGTH
            known.append(spans.tobytes())
            yield from gathered(known, SPAN, "spans", GATHERED)
        yield from gathered(known, SPAN, "spans")

    null = lambda kind: F.lit(None).cast(kind)
    texts = rows.select("q", F.lit(1).alias("kind"), null("binary").alias("blob"), "rid", "doc", "text")
    blobs = shared.select("q", F.lit(0).alias("kind"), F.col("pairs").alias("blob"), null("long").alias("rid"), null("long").alias("doc"), null("string").alias("text"))
    both = blobs.unionByName(texts).repartitionById(parts, F.col("q")).sortWithinPartitions("kind").select("blob", "rid", "doc", "text")
    sent = both.mapInArrow(contexts, "p int, sent binary, who binary, raw binary, done binary")
    spans = materialize(sent.repartitionById(parts, F.col("p")).mapInArrow(compared, "q int, spans binary"), "suffix-spans")
    return rows, spans, parts


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``kept`` is the rest of the text as bytes."""
    rows, spans, parts = repeated_spans(docs)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, spans = [], None
        for batch in batches:
            out = []
            for blob, rid, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("blob", "rid", "doc_id", "text")), strict=True):
                if blob is not None:
                    found.append(np.frombuffer(blob, SPAN))
                    continue
                if spans is None:
                    spans = np.concatenate([np.zeros(0, SPAN), *found])
                    spans = spans[np.argsort(spans["rid"], kind="stable")]
                data = _data(text)
                own = spans[np.searchsorted(spans["rid"], rid) : np.searchsorted(spans["rid"], rid, "right")]
                depth = np.zeros(len(data) + 1, np.int32)
                np.add.at(depth, own["start"], 1)
                np.add.at(depth, own["end"], -1)
                gone = np.cumsum(depth[:-1]) > 0
                runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                out.append((doc_id, len(data), int(gone.sum()), runs, data[~gone].tobytes()))
            if out:
                yield _batch(["doc_id", "n_bytes", "n_removed", "n_spans", "kept"], out, [*[pa.int64()] * 4, pa.binary()])

    null = lambda kind: F.lit(None).cast(kind)
    texts = rows.select("q", F.lit(1).alias("kind"), null("binary").alias("blob"), "rid", F.col("doc_id").cast("long").alias("doc_id"), "text")
    blobs = spans.select("q", F.lit(0).alias("kind"), F.col("spans").alias("blob"), null("long").alias("rid"), null("long").alias("doc_id"), null("string").alias("text"))
    both = blobs.unionByName(texts).repartitionById(parts, F.col("q")).sortWithinPartitions("kind").select("blob", "rid", "doc_id", "text")
    return both.mapInArrow(removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
