"""Operator 13 against all pairs in plain Python, and against SQL."""

from __future__ import annotations

import random
import re
import time

import duckdb
import numpy as np
import pytest
from conftest import SF
from test_text_operators import SCHEMA, TEXTS

from ledgerloom.llm import ngram_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows: list[tuple]) -> list[tuple]:
    """Sorted (doc_id, n_shingles, component_id), None as -1."""
    sets = [(i, shingles(t)) for i, t in rows]
    known = [(i, s) for i, s in sets if i is not None and s]
    root = list(range(len(known)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(known)):
        for y in range(x):
            a, b = known[x][1], known[y][1]
            if min(len(a), len(b)) * 100 >= max(len(a), len(b)) * 80 and 100 * len(a & b) >= 80 * len(a | b):
                root[find(x)] = find(y)
    least: dict[int, int] = {}
    for x, (i, _) in enumerate(known):
        least[find(x)] = min(least.get(find(x), i), i)
    out = [(i, len(s), least[find(x)]) for x, (i, s) in enumerate(known)]
    return sorted(out + [(-1 if i is None else i, len(s), -1 if i is None else i) for i, s in sets if i is None or not s])


def rows_of(df) -> list[tuple]:  # noqa: ANN001
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def edited(rnd: random.Random, words: list[str], n: int) -> list[str]:
    out = list(words)
    for _ in range(n):
        out[rnd.randrange(len(out))] = f"edit{rnd.randrange(10**6)}"
    return out


def test_odd_documents(spark) -> None:  # noqa: ANN001
    rows = TEXTS + [(30, "one two three", "a"), (31, "ONE two\tTHREE", "a"), (32, "one two three four", "a"), (40, " ".join(LOWER_WORDS), "b"), (41, " ".join([*LOWER_WORDS, "tail"]), "b")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "extra", "extra", "extra", "extra") for i, t, s in rows], SCHEMA).repartition(3)
    assert rows_of(ngram_join.joined(docs)) == brute([(i, t) for i, t, _ in rows])


LOWER_WORDS = [f"v{i}" for i in range(60)]


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_groups_templates_and_the_exact_threshold(spark, seed: int) -> None:  # noqa: ANN001
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(3000)}"
    texts: list[str] = []
    for size in (2, 3, 10, 120):  # near copies of one text, some of them at or near the threshold
        base = [word() for _ in range(rnd.randint(40, 200))]
        texts += [" ".join(edited(rnd, base, rnd.randint(0, 7))) for _ in range(size)]
    texts += [texts[5]] * 60  # copies
    chain = [word() for _ in range(150)]
    for _ in range(12):  # each near the one before, the ends are far from each other
        texts.append(" ".join(chain))
        chain = edited(rnd, chain, 2)
    shared = [word() for _ in range(85)]
    texts += [" ".join(shared + [word() for _ in range(rnd.randint(10, 30))]) for _ in range(80)]  # one passage, and own words
    parts = [[word() for _ in range(30)] for _ in range(6)]
    texts += [" ".join(w for p in rnd.sample(parts, 4) for w in p) for _ in range(80)]  # put together from common parts
    # Of 25 shingles two texts share 20 to 24.
    base = [f"t{i}" for i in range(29)]
    texts += [" ".join(base[:-k] + [f"u{k}x{i}" for i in range(k)]) for k in range(1, 6)]
    texts += [" ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(100)]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(ngram_join.joined(docs)) == brute(rows)


def test_many_different_texts_with_one_passage(spark) -> None:  # noqa: ANN001
    """Texts that share four fifths with each other, and just miss the threshold: none is lost, none linked, none takes long."""
    rnd = random.Random(3)
    passage = [f"p{i}" for i in range(84)]
    rows = [(i, " ".join(passage + [f"x{i}y{j}" for j in range(12 + i % 3)])) for i in range(1500)]
    rows += [(5000 + i, " ".join([*passage, *(f"x{i}y{j}" for j in range(11 + i % 3))])) for i in range(5)]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    got = dict((d, c) for d, _, c in rows_of(ngram_join.joined(docs)))
    assert time.time() - began < 240
    sample = [r for r in rows if r[0] < 40 or r[0] >= 5000]
    assert {d: c for d, _, c in brute(sample)} == {d: got[d] for d, _ in sample}


def test_empty_table(spark) -> None:  # noqa: ANN001
    assert rows_of(ngram_join.joined(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_prefixes_hold_what_the_lemma_says() -> None:
    """Sets that reach the threshold share l of their l-prefixes, whatever each one's l."""
    rnd = random.Random(9)
    for _ in range(2000):
        n = rnd.randint(1, 60)
        a = set(rnd.sample(range(200), n))
        b = set(a)
        for x in rnd.sample(sorted(a), rnd.randint(0, max(0, n // 8))):
            b.discard(x)
            if rnd.random() < 0.5:
                b.add(rnd.randrange(200, 400))
        if not b or 100 * len(a & b) < 80 * len(a | b):
            continue
        l, m = rnd.randint(1, 5), rnd.randint(1, 5)  # noqa: E741
        prefix = lambda s, k: set(sorted(s)[: len(s) - ngram_join.least_overlap(len(s), 80) + k])
        assert len(prefix(a, l) & prefix(b, m)) >= min(l, m, len(a & b))


def test_costly_lists_lengthen_the_prefix() -> None:
    rare, common = np.full(80, 2), np.concatenate([np.full(10, 2), np.full(70, 10_000)])
    assert ngram_join.chosen_matches(rare, 100, 21) > 1
    assert ngram_join.chosen_matches(common, 100, 5) == 4  # more would meet the long lists
    assert ngram_join.chosen_matches(np.array([2]), 1, 1) == 1


def test_query_equals_sql(spark) -> None:  # noqa: ANN001
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows_of(ngram_join.op13_ngram_join(spark, SF)) == sorted(con.execute(ngram_join.OP13_SQL).fetchall())
