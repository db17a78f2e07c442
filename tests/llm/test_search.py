"""Operator 12 against scoring every document in plain Python, and against SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from conftest import SF
from test_text_operators import SCHEMA, TEXTS

from ledgerloom.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [(1, "the lazy DOG and a passage, word for word"), (2, "word1 word2 word3 word1 same"), (2, "日本語 same"), (3, None), (4, "... ---"), (5, "zzz not there"), (None, "ümläut short ß"), (6, "one")]


def brute(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    """Sorted (item_id, rank, doc_id, score), None as -1."""
    terms = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, c) for i, c in terms if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    of_item: dict = {}
    for i, t in items:
        of_item.setdefault(i, Counter()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, query in of_item.items():
        weights = {t: q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t, q in query.items() if df[t]}
        scores = []
        for d, c in held:
            m = 100 - 75 + 75 * sum(c.values()) * n // length
            score = sum(w * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weights.items() if c[t])
            if score > 0:
                scores.append((-score, d is None, d if d is not None else -1))
        out += [(item if item is not None else -1, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def rows_of(df) -> list[tuple]:  # noqa: ANN001
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "extra", "extra", "extra", "extra") for i, t, s in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def items(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(i, t, 0, 0) for i, t in ITEMS], "item_id long, text string, part int, score int")


@pytest.mark.parametrize("k", [1, 3, 10])
def test_odd_documents_and_items(docs, items, k: int) -> None:  # noqa: ANN001
    assert rows_of(search.ranked_search(docs, items, k)) == brute([(i, t) for i, t, _ in TEXTS], ITEMS, k)


def test_small_segments_blocks_of_items_and_groups_of_copies(spark) -> None:  # noqa: ANN001
    rnd = random.Random(5)
    words = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(400)]
    texts = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 60)))) for i in range(500)]
    texts += [(1000 + i, texts[7][1]) for i in range(200)] + [(2000 + i, texts[8][1] + f" more{i % 3}") for i in range(100)]
    rnd.shuffle(texts)
    asked = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 30)))) for i in range(40)] + [(100, texts[3][1]), (101, "w1"), (102, texts[4][1])]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    items = spark.createDataFrame(asked, "item_id long, text string")
    folder = search.fresh_path(spark, "test-index")
    search.build_index(docs, folder, postings=500)  # all terms
    want = brute(texts, asked)
    assert rows_of(search.search(spark, folder, items)) == want
    assert rows_of(search.search(spark, folder, items, block_pairs=100)) == want
    assert rows_of(search.ranked_search(docs, items)) == want


def test_segments_hold_a_part_of_the_documents() -> None:
    """Rows of one segment: every list is whole, copies are numbered by doc_id."""
    segment = search.Segment(7, None)
    for doc, text in ((3, "a b a"), (1, "A, b! a"), (None, "c"), (2, "")):
        segment.add(doc, text)
    rows = [r for batch in segment.rows() for r in batch.to_pylist()]
    assert rows[0]["part"] == 0 and (rows[0]["n_held"], rows[0]["n_terms"]) == (3, 7)
    assert {t: s for r in rows for t, s in zip(r["terms"], r["sizes"], strict=True)} == {b"a": 2, b"b": 2, b"c": 1}


def test_empty_tables(spark, docs, items) -> None:  # noqa: ANN001
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(search.ranked_search(none, items)) == []
    assert rows_of(search.ranked_search(docs, spark.createDataFrame([], "item_id long, text string"))) == []


def test_texts_are_split_in_pieces_at_separators(monkeypatch) -> None:
    monkeypatch.setattr(search, "PIECE", 5)
    text = search.folded("abc, DEF-ghijklmnop 日本語 q" * 3)
    assert [t for p in search.pieces(text) for t in p] == text.split()


def test_query_equals_sql(spark) -> None:  # noqa: ANN001
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows_of(search.op12_search(spark, SF)) == sorted(con.execute(search.OP12_SQL).fetchall())
