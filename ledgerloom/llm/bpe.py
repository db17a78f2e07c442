"""Operator 1: byte-level BPE encoding and decoding with a memory-mapped transducer lexicon.

The frequent words (pre-tokens) of the corpus are counted over all documents and encoded
once. They are compiled into a minimal acyclic automaton: equal right languages are one
state, so suffixes are shared, and every transition carries the number of words it skips,
so that the sum along a word's path is the word's number, which addresses its ids. The
automaton is one file of at most ``LEXICON_WORDS`` words; Spark hands it to the executors
(``SparkContext.addFile``), whose Python workers map it into memory and share its pages.
A task looks a word up in the automaton and else merges it exactly, by rank (by a compiled
merger, where the vocabulary is one for which it gives the same); either way it
remembers the result, in a table of bounded size. Encoding and decoding in one step (``round_trip``) take one
Python worker for each task, not two.

Texts are split by the public pattern. What is a letter or a number there follows the tokenizers library, whose Unicode tables are not
those of the regex package: the characters that the two class differently are asked of the library once,
on the driver, and taken out of the classes. Texts without characters beyond the 65,536th are split
by the re package, which takes half the time, with the same classes as lists of ranges.

Defined cases: a null text is empty and has no ids; a text may hold special tokens, which
become their own ids; rows of null or repeated doc_id are encoded each by itself; empty
tables give empty results; other columns pass through ``encode``, and columns named like
its results are replaced. Texts are encoded whole; a word of any length is merged exactly.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import documents, fresh_path, materialize

#: The public pre-tokenisation pattern of byte-level BPE (a fixed value), with its classes of letters and numbers left open.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?<L>+| ?<N>+| ?[^\s<L><N>]+|\s+(?!\S)|\s+"""
#: At most so many frequent words are compiled; words seen fewer times than the second number never are.
LEXICON_WORDS, LEAST_COUNT = 65536, 8
#: A worker remembers two generations of words of so many bytes each, counting so many for a word besides its own and its ids'.
REMEMBERED, ENTRY = 48 << 20, 200
#: Bytes of a word whose path in the automaton a worker remembers, and how many such beginnings.
BEGINNING, BEGINNINGS = 5, 1 << 15
#: Rows that a task handles at a time, so that a batch's texts and ids are not all unpacked at once.
ROWS = 512
#: Words longer than this many bytes are merged by a heap instead of by scanning.
SCAN_UP_TO = 128
MAGIC = b"MATLEX01"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The public byte-to-letter rule: printable bytes stand for themselves, others for letters from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _ranges(codes: list[int]) -> str:
    """A character class's inside for ascending code points."""
    out, start = [], None
    for n, c in enumerate(codes):
        start = c if start is None else start
        if n + 1 == len(codes) or codes[n + 1] != c + 1:
            out.append(f"\\U{start:08x}-\\U{c:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def classes() -> tuple[str, str, int]:
    """Ranges of the characters that are no letter, and no number, to the tokenizers library though they are to the regex package; the first of them."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    every = "".join(chr(c) for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000)

    def others(kind: str, beside: str) -> list[int]:
        asked = regex.findall(kind, every)
        # Each between two of its kind and line ends: it is of that kind if all three are one piece.
        pieces = {at for _, at in split("".join(f"{beside}{c}{beside}\n" for c in asked))}
        return [ord(c) for i, c in enumerate(asked) if (4 * i, 4 * i + 3) not in pieces]

    letters, numbers = others(r"\p{L}", "a"), others(r"\p{N}", "1")
    return _ranges(letters), _ranges(numbers), min([*letters, *numbers, 0x110000])


def _kinds(known: tuple[str, str, int] | None) -> list[str]:
    """The classes of letters and numbers in the regex package, without the characters that ``known`` lists."""
    return [rf"[\p{{{k}}}--[{x}]]" if x else rf"\p{{{k}}}" for k, x in zip("LN", known or ("", ""), strict=False)]


def pattern(known: tuple[str, str, int] | None) -> str:
    """The pattern, with the classes of the regex package where ``known`` is None."""
    letters, numbers = _kinds(known)
    return ("" if known is None else "(?V1)") + PATTERN.replace("<L>", letters).replace("<N>", numbers)


def listed_pattern(known: tuple[str, str, int]) -> str:
    """The pattern for the re package and texts of characters below 0x10000: each class is a list of ranges."""
    every = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)
    space, letters, numbers = (_ranges([ord(c) for c in regex.findall("(?V1)" + kind, every)]) for kind in (r"\s", *_kinds(known)))
    other = f"[^{space}{letters}{numbers}]"
    return PATTERN.replace(r"[^\s<L><N>]", other).replace("<L>", f"[{letters}]").replace("<N>", f"[{numbers}]").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]")


@lru_cache(maxsize=4)
def splitter(known: tuple[str, str, int]) -> Callable[[str], list[str]]:
    """A function from a text to its pre-tokens."""
    listed, beyond = re.compile(listed_pattern(known)).findall, re.compile(f"[{chr(0x10000)}-{chr(0x10FFFF)}]").search
    exact = regex.compile(pattern(known)).findall
    return lambda text: listed(text) if text.isascii() or not beyond(text) else exact(text)


class Vocabulary:
    """A byte-level BPE vocabulary: ids of bytes, ranked merges of ids, bytes of ids, special tokens."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocab: dict[str, int] = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.table = pa.array(self.pieces, pa.large_binary())
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        #: Rank of a pair (first id in the higher bits), and the id that a rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(data["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left] << 32 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token: always the lowest-ranked pair, leftmost first, is merged."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > SCAN_UP_TO:
            return self._merge_long(ids)
        rank, made, never = self.ranks.get, self.made, 1 << 60
        ranks = [rank(a << 32 | b, never) for a, b in pairwise(ids)]
        best = min(ranks, default=never)
        while best != never:
            i = ranks.index(best)
            ids[i] = new = made[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | new, never)
            if i < len(ranks):
                ranks[i] = rank(new << 32 | ids[i + 1], never)
            best = min(ranks, default=never)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(self.ranks[p], i, a, b) for i, (a, b) in enumerate(pairwise(ids)) if (p := a << 32 | b) in self.ranks]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[best], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (p := ids[left] << 32 | ids[right]) in self.ranks:
                    heapq.heappush(heap, (self.ranks[p], left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]


@lru_cache(maxsize=4)
def vocabulary(spec: str) -> Vocabulary:
    return Vocabulary(spec)


def compiled_encoding(vocab: Vocabulary) -> tiktoken.Encoding:
    """A compiled merger over the vocabulary's ranks; for a ``regular`` vocabulary it gives what ``Vocabulary.merge`` gives, several times faster."""
    special = set(vocab.special.values())
    ranks = {p: i for i, p in enumerate(vocab.pieces) if i not in special}
    return tiktoken.Encoding("file", pat_str=pattern(None), mergeable_ranks=ranks, special_tokens=vocab.special)


@lru_cache(maxsize=4)
def regular(spec: str) -> bool:
    """Whether the compiled merger, which joins any neighbours whose bytes are a piece, least id first, merges every word as ``Vocabulary.merge`` does.

    It does if merges make ids in ascending order and each piece's bytes alone are merged to
    that piece: where two neighbours' bytes are a piece, no merge has crossed the ends of
    these bytes, so they were merged as they are alone, and alone it is this pair that is merged last.
    """
    vocab = vocabulary(spec)
    special = set(vocab.special.values())
    return special.isdisjoint(vocab.made) and all(a < b for a, b in pairwise(vocab.made)) and all(vocab.merge(p) == [i] for i, p in enumerate(vocab.pieces) if i not in special)


def word_merger(spec: str, compiled: bool) -> Callable[[bytes], list[int]]:
    """A function from a word to its ids; ``compiled``: the vocabulary is ``regular``."""
    vocab = vocabulary(spec)
    return compiled_encoding(vocab)._core_bpe.encode_single_piece if compiled else vocab.merge


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic automaton of ``words`` with their ids, as the bytes of a file.

    Words are added in order; states that a later word can't change are replaced by equal
    ones that exist (so that suffixes are shared). Layout after the magic: counts of
    states, transitions, words and ids; then first transition by state, final flag by
    state, label, target and skipped words by transition, first id by word, ids.
    """
    registered: dict[tuple, int] = {}
    done: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    open_states: list[list] = [[False, []]]
    ordered = sorted(words)

    def close(depth: int) -> None:
        while len(open_states) > depth + 1:
            final, edges = open_states.pop()
            key = (final, tuple(edges))
            if key not in registered:
                registered[key] = len(done)
                done.append(key)
            parent = open_states[-1][1]
            parent[-1] = (parent[-1][0], registered[key])

    last = b""
    for word in ordered:
        shared = 0
        for x, y in zip(last, word, strict=False):
            if x != y:
                break
            shared += 1
        close(shared)
        for b in word[shared:]:
            open_states[-1][1].append((b, -1))
            open_states.append([False, []])
        open_states[-1][0] = True
        last = word
    close(0)
    root = len(done)
    done.append((open_states[0][0], tuple(open_states[0][1])))
    count = np.zeros(len(done), np.int64)
    for s, (final, edges) in enumerate(done):  # targets come before their sources
        count[s] = final + sum(int(count[t]) for _, t in edges)
    first, labels, targets, skips = [0], bytearray(), [], []
    for final, edges in done:
        skipped = int(final)
        for b, t in edges:
            labels.append(b)
            targets.append(t)
            skips.append(skipped)
            skipped += int(count[t])
        first.append(len(targets))
    starts = np.cumsum([0, *(len(words[w]) for w in ordered)])
    ids = [i for w in ordered for i in words[w]]
    u32 = lambda x: np.asarray(x, "<u4").tobytes()
    head = MAGIC + struct.pack("<5I", len(done), len(targets), len(ordered), len(ids), root)
    return head + u32(first) + u32(targets) + u32(skips) + u32(starts) + u32(ids) + bytes(f for f, _ in done) + bytes(labels)


_BYTES = [bytes([b]) for b in range(256)]


class Lexicon:
    """A compiled lexicon, read where it lies: nothing is unpacked."""

    def __init__(self, data: mmap.mmap | bytes) -> None:
        states, edges, words, ids, self.root = struct.unpack_from("<5I", data, len(MAGIC))
        view, at = memoryview(data), len(MAGIC) + 20
        if bytes(view[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a compiled lexicon")
        parts = []
        for n in (states + 1, edges, edges, words + 1, ids):
            parts.append(view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.first, self.targets, self.skips, self.starts, self.ids = parts
        self.final, self.data, self.labels = view[at : at + states], data, at + states
        self.begun: dict[bytes, tuple[int, int] | None] = {}

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def _walk(self, part: bytes, state: int, number: int) -> tuple[int, int] | None:
        """Where some bytes lead from a state, and how many words are passed by then."""
        find, labels, first, skips, targets = self.data.find, self.labels, self.first, self.skips, self.targets
        for byte in part:
            at = find(_BYTES[byte], labels + first[state], labels + first[state + 1]) - labels
            if at < 0:
                return None
            number += skips[at]
            state = targets[at]
        return state, number

    def get(self, word: bytes) -> bytes | None:
        """The word's ids, packed as 32-bit little-endian numbers, or None."""
        begin = word[:BEGINNING]
        if begin in self.begun:
            known = self.begun[begin]
        else:
            known = self._walk(begin, self.root, 0)
            if len(self.begun) >= BEGINNINGS:
                self.begun.clear()
            self.begun[begin] = known
        if known and len(word) > BEGINNING:
            known = self._walk(word[BEGINNING:], *known)
        if not known:
            return None
        state, number = known
        if not self.final[state]:
            return None
        return self.ids[self.starts[number] : self.starts[number + 1]].tobytes()


@lru_cache(maxsize=4)
def opened(name: str) -> Lexicon:
    return Lexicon.open(SparkFiles.get(name))


class Remembered(dict):
    """Packed ids by pre-token: from the lexicon, else merged. Of two generations, words that are met again go over to the newer."""

    def __init__(self, merge: Callable[[bytes], list[int]], lexicon: Lexicon | None) -> None:
        super().__init__()
        self.lexicon, self.merge, self.size, self.older = lexicon, merge, 0, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.pop(word, None)
        if packed is None:
            raw = word.encode("utf-8")
            packed = self.lexicon.get(raw) if self.lexicon else None
            if packed is None:
                packed = struct.pack(f"<{len(ids := self.merge(raw))}I", *ids)
        self.size += ENTRY + len(word) + len(packed)
        if self.size > REMEMBERED:
            self.older, self.size = dict(self), 0
            self.clear()
        self[word] = packed
        return packed


@lru_cache(maxsize=4)
def encoder(spec: str, known: tuple[str, str, int], lexicon: str | None, compiled: bool = False) -> Callable[[str], bytes]:
    """A function from a text to its packed ids; one for each worker process."""
    vocab = vocabulary(spec)
    ids_of = Remembered(word_merger(spec, compiled), opened(lexicon) if lexicon else None).__getitem__
    words, special = splitter(known), vocab.special

    def encode(text: str) -> bytes:
        if special and any(t in text for t in special):
            return b"".join(struct.pack("<I", special[part]) if part in special else b"".join(map(ids_of, words(part))) for part in vocab.split_special.split(text))
        return b"".join(map(ids_of, words(text)))

    return encode


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each word (run of letters between spaces) of the corpus occurs, for those that occur ``LEAST_COUNT`` times."""
    words = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("word"))
    return words.groupBy("word").count().where((F.col("count") >= LEAST_COUNT) & F.col("word").rlike(r"^\p{L}+$"))


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent pre-tokens, at most ``most``: a space and a word with a count above what a histogram of counts gives."""
    counts = materialize(word_counts(docs).withColumn("bin", F.floor(F.log2("count") * 16).cast("int")), "bpe-words")
    taken, least = 0, None
    for b, n in sorted(((r[0], r[1]) for r in counts.groupBy("bin").count().collect()), reverse=True):
        if taken + n > most:
            break
        taken, least = taken + n, b
    if least is None:
        return []
    words = (" " + r[0] for r in counts.where(F.col("bin") >= least).select("word").collect())
    return sorted(w for w in words if regex.fullmatch(r" \p{L}+", w))


def share_lexicon(spark: SparkSession, data: bytes) -> str:
    """Put a lexicon into the shared folder and among the files that Spark gives to executors; its name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(fresh_path(spark, "lexicon"))
    name = path.getName()  # an application's file names must differ
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def build_lexicon(docs: DataFrame, spec: str, most: int = LEXICON_WORDS) -> str:
    merge = word_merger(spec, regular(spec))
    return share_lexicon(docs.sparkSession, compile_lexicon({w: merge(w) for w in (x.encode("utf-8") for x in frequent_words(docs, most))}))


def specification(path: str | None = None) -> str:
    with open(path or tokenizer_path(), encoding="utf-8") as f:
        return f.read()


def _texts(table: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The text of each run of ids, which lie between ``offsets``: the bytes of their pieces in ``table``, one after another."""
    if not len(ids):
        return pa.array([""] * (len(offsets) - 1), pa.string())
    _, ends, data = table.take(pa.array(ids)).buffers()
    ends = np.frombuffer(ends, np.int64, len(ids) + 1)[offsets]
    if ends[-1] < 1 << 31:
        try:
            texts = pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), data])
            texts.validate(full=True)
            return texts
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            pass
    return pa.array([bytes(memoryview(data)[a:b]).decode("utf-8", "replace") for a, b in pairwise(ends.tolist())], pa.string())


def _with(docs: DataFrame, more: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([*docs.schema.fields, *[T.StructField(name, kind) for name, kind in more.items()]])


def _extended(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


IDS = T.ArrayType(T.IntegerType(), False)


def encode(docs: DataFrame, path: str | None = None, lexicon: str | None = None) -> DataFrame:
    """``docs`` with ids: array<int>. ``path``: the tokenizer's JSON file. ``lexicon``: of an earlier call."""
    return _coded(docs, path, lexicon, False)


def round_trip(docs: DataFrame, path: str | None = None, lexicon: str | None = None) -> DataFrame:
    """``docs`` with ids, and with decoded: the text that ``decode`` makes of them."""
    return _coded(docs, path, lexicon, True)


def _coded(docs: DataFrame, path: str | None, lexicon: str | None, back: bool) -> DataFrame:
    spec = specification(path)
    docs = docs.drop("ids", *["decoded"] * back)
    lexicon = lexicon or build_lexicon(docs.select("text"), spec)
    shared = docs.sparkSession.sparkContext.broadcast((spec, classes(), lexicon, regular(spec)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, table = encoder(*shared.value), vocabulary(shared.value[0]).table
        for batch in sliced(batches):
            packed = [of(t) if t else b"" for t in batch.column("text").to_pylist()]
            offsets = np.zeros(len(packed) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
            flat = np.frombuffer(b"".join(packed), "<i4")
            out = {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}
            if back:
                out["decoded"] = _texts(table, flat, offsets)
            yield _extended(batch, **out)

    return docs.mapInArrow(run, _with(docs, {"ids": IDS} | ({"decoded": T.StringType()} if back else {})))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (with ids) with decoded: the text; bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(specification(path))
    encoded = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(shared.value).table
        for batch in sliced(batches):
            ids = batch.column("ids")
            flat, at = ids.values.to_numpy(), ids.offsets.to_numpy()
            yield _extended(batch, decoded=_texts(table, flat[at[0] : at[-1]], at - at[0]))

    return encoded.mapInArrow(run, _with(encoded, {"decoded": T.StringType()}))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_trip(documents(spark, sf_dir).select("doc_id", "text"))
    ids = F.sha2(F.encode(F.array_join("ids", ","), "UTF-8"), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
