"""Operator 5: token counts under a unigram model, by trie-shared dynamic programming.

A pre-token's best segmentation into vocabulary pieces is the path of highest total score;
its forward scores (the best score of each prefix, with the number of pieces on that path)
depend on the prefix only. So a task inserts the distinct pre-tokens of its rows into a
trie and computes forward scores once for each node, that is, once for each shared prefix;
the count at a pre-token's last node is its number of tokens. Documents then add up the
counts of their pre-tokens. Only counts of distinct pre-tokens are shuffled, and the trie is bounded: it starts
anew when it has too many nodes.

The model is trained on the same documents: all of them are split into pre-tokens, each distinct pre-token is merged once by
the vocabulary's own rules (by tiktoken's compiled merger), and a piece's probability is the share of its count, one added to each
(the vocabulary itself is given; no tokenizer is trained). Only one count for each piece of the vocabulary reaches the driver.
Equal scores: the path with fewer pieces wins.

Defined cases: a null or empty text has 0 tokens; rows of null or repeated doc_id count by
themselves; an empty table gives an empty result; other columns pass through, and columns
named like results are replaced. All single bytes are pieces, so every text has a path.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import classes, compiled_encoding, specification, splitter, vocabulary
from .shared import batch_of, documents, materialize

#: A trie with more nodes than this is dropped, and a new one begun.
MAX_NODES = 1_000_000
#: A task passes its counts on when it has so many distinct pre-tokens.
GATHERED = 200_000


class Trie:
    """Nodes by (parent, byte); each has the best score of its prefix and the pieces on that path.

    ``ends``: every end of a piece, with its score where it is a piece itself. The pieces that end at a node are found backwards, up to
    the first bytes that are no end of any piece.
    """

    def __init__(self, scores: dict[bytes, float]) -> None:
        self.ends: dict[bytes, float | None] = dict.fromkeys((p[i:] for p in scores for i in range(len(p))), None) | scores
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.score, self.count = [0.0], [0]

    def terminal(self, word: bytes) -> int:
        """Insert a pre-token; the number of pieces of its best segmentation."""
        path, node, children, ends = [0], 0, self.children, self.ends
        for depth, byte in enumerate(word, 1):
            key = node << 8 | byte
            child = children.get(key)
            if child is None:
                child = len(self.score)
                children[key] = child
                best, pieces = -math.inf, 0
                for start in range(depth - 1, -1, -1):
                    score = ends.get(word[start:depth], ends)
                    if score is ends:
                        break
                    if score is not None:
                        total, n = self.score[path[start]] + score, self.count[path[start]] + 1
                        if total > best or (total == best and n < pieces):
                            best, pieces = total, n
                self.score.append(best)
                self.count.append(pieces)
            node = child
            path.append(node)
        return self.count[node]


class Counts(dict):
    """Tokens by pre-token: terminal counts of the trie."""

    def __init__(self, trie: Trie) -> None:
        super().__init__()
        self.trie = trie

    def __missing__(self, word: str) -> int:
        if len(self.trie.score) > MAX_NODES:
            self.trie.clear()
            self.clear()
        self[word] = n = self.trie.terminal(word.encode("utf-8"))
        return n


def pretoken_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each distinct pre-token occurs in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(classes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = splitter(shared.value), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    found.update(words(text))
                    if len(found) > GATHERED:
                        yield batch_of("word string, n long", list(found.items()))
                        found.clear()
        if found:
            yield batch_of("word string, n long", list(found.items()))

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def piece_counts(words: DataFrame, spec: str) -> np.ndarray:
    """How often each piece of the vocabulary occurs in all of ``words`` (word, n), merged by its rules."""
    shared = words.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        merge = compiled_encoding(vocab)._core_bpe.encode_single_piece  # the compiled merger, for one pre-token
        count = np.zeros(len(vocab.pieces), np.int64)
        for batch in batches:
            ids, times = [], []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                ids.append(merge(word.encode("utf-8")))
                times.append(n)
            every = np.fromiter(chain.from_iterable(ids), np.int64)
            count += np.bincount(every, np.repeat(np.array(times, np.float64), [len(x) for x in ids]), len(count)).astype(np.int64)
        some = np.flatnonzero(count)
        yield batch_of("id int, n long", list(zip(some.tolist(), count[some].tolist(), strict=True)))

    total = np.zeros(len(vocabulary(spec).pieces), np.int64)
    for i, n in words.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n")).collect():  # at most one row for each piece
        total[i] = n
    return total


def unigram_scores(docs: DataFrame, spec: str) -> np.ndarray:
    """The log-probability of each piece in ``docs``."""
    words = materialize(pretoken_counts(docs), "unigram-words")
    count = piece_counts(words, spec) + 1
    return np.log(count / count.sum())


def by_piece(spec: str, scores: np.ndarray) -> dict[bytes, float]:
    vocab = vocabulary(spec)
    special = set(vocab.special.values())
    return {p: float(scores[i]) for i, p in enumerate(vocab.pieces) if p and i not in special}


@lru_cache(maxsize=1)  # a trie of an earlier model would stay in the worker's memory
def counts(spec: str, scores: bytes) -> Counts:
    return Counts(Trie(by_piece(spec, np.frombuffer(scores))))


def count_tokens(docs: DataFrame, path: str | None = None, scores: np.ndarray | None = None) -> DataFrame:
    """``docs`` with n_pretokens and n_tokens. ``scores``: of each piece, from ``unigram_scores`` of other documents."""
    spec = specification(path)
    if scores is None:
        scores = unigram_scores(docs, spec)
    shared = docs.sparkSession.sparkContext.broadcast((spec, scores.tobytes(), classes()))
    docs = docs.drop("n_pretokens", "n_tokens")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, scores, known = shared.value
        of, words = counts(spec, scores), splitter(known)
        for batch in batches:
            pretokens, tokens = [], []
            for text in batch.column("text").to_pylist():
                found = words(text) if text else []
                pretokens.append(len(found))
                tokens.append(sum([of[w] for w in found]))
            columns = [*batch.columns, pa.array(pretokens, pa.int64()), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "n_pretokens", "n_tokens"])

    return docs.mapInArrow(run, schema)


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_pretokens", "n_tokens")
