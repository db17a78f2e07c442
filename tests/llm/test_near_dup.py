"""Operator 2 against all pairs by plain Python, with its own words, weights and classes."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_text_operators import SCHEMA, TEXTS

from ledgerloom.llm import near_dup


@pytest.fixture(scope="module")
def docs(spark):  # noqa: ANN001, ANN201
    rows = [(i, t, "en", s, len(t or ""), "extra", "extra", "extra", "extra") for i, t, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def weights_of(texts: list[str]) -> dict[str, Counter]:
    """The weight of each five-word shingle of each text: its count times its words' summed inverse frequencies."""
    words = {t: t.encode().split() for t in texts}
    held = Counter(w for own in words.values() for w in set(own))
    idf = {w: 1 + math.log((len(texts) + 1) / (n + 1)) for w, n in held.items()}
    out = {}
    for t, own in words.items():
        grams = [tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))] if own else []
        out[t] = Counter()
        for g in grams:
            out[t][g] += sum(idf[w] for w in g)
    return out


def brute(rows: list[tuple], threshold: float = 0.8) -> list[tuple]:
    """Sorted (doc_id, class_id) by all pairs."""
    known = [(i, t or "") for i, t, *_ in rows if i is not None]
    first = {}
    for i, t in known:
        first[t] = min(first.get(t, i), i)
    texts = sorted(first, key=first.get)
    weights, root = weights_of(texts), {t: t for t in texts}

    def find(t: str) -> str:
        while root[t] != t:
            t = root[t]
        return t

    for n, a in enumerate(texts):
        for b in texts[:n]:
            x, y = weights[a], weights[b]
            least = sum(min(w, y[g]) for g, w in x.items() if g in y)
            if least and least >= threshold * (sum(x.values()) + sum(y.values()) - least):
                p, q = sorted((find(a), find(b)), key=first.get)
                root[q] = p
    return sorted((i, first[find(t)]) for i, t in known)


def classes(df) -> list[tuple]:  # noqa: ANN001
    return sorted((r.doc_id, r.class_id) for r in near_dup.near_duplicates(df).where("doc_id IS NOT NULL").collect())


def copies(n: int) -> list[tuple]:
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    rows = [(0, " ".join(base))]
    for i in range(1, n):
        own = list(base)
        own[int(rng.integers(0, 120))] = f"new{i}"
        rows.append((i, " ".join(own)))
    return rows + [(1000 + i, " ".join(f"v{x}" for x in rng.integers(0, 5000, 60))) for i in range(40)]


def test_odd_cases(spark, docs) -> None:  # noqa: ANN001
    assert classes(docs) == brute(TEXTS)
    alone = near_dup.near_duplicates(docs).where("doc_id IS NULL").collect()
    assert [(r.class_id, r.n_links) for r in alone] == [(None, 0)] * sum(i is None for i, _, _ in TEXTS)
    none = docs.where("false")
    assert near_dup.near_duplicates(none).count() == 0 and near_dup.keep_one(none).columns == docs.columns and near_dup.keep_one(none).count() == 0


def test_one_row_of_each_class_stays(spark, docs) -> None:  # noqa: ANN001
    odd = docs.select("*", F.lit(1).alias("_row"), F.lit(2).alias("_h1"), F.lit(3).alias("node"))
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c in brute(TEXTS)}) and kept.where("doc_id IS NULL").count() == 2
    # Rows of one doc_id with different texts are told apart.
    rows = [(1, "an early text of more than five words"), (2, "another text, of just as many words"), (2, "an early text of more than five words"), (2, "a third text that shares nothing with them")]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == [rows[0], rows[3], rows[1]]


def test_near_copies_and_chains(spark) -> None:  # noqa: ANN001
    rows, words = copies(60), [f"c{i}" for i in range(100)]
    for step in range(12):  # a chain: neighbours are near, the ends are not
        rows.append((2000 + step, " ".join(words[step * 4 : step * 4 + 60])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert classes(df) == brute(rows)
    links = {r.doc_id: r.n_links for r in near_dup.near_duplicates(df).collect()}
    assert links[0] == 59 and links[1000] == 0 and sum(links.values()) % 2 == 0


def test_texts_with_a_passage_in_common(spark) -> None:  # noqa: ANN001
    rng, passage = np.random.default_rng(5), [f"p{i}" for i in range(60)]
    rows = []
    for i in range(90):
        own = [f"o{x}" for x in rng.integers(0, 10**6, 45)]
        rows.append((i, " ".join(passage + own)))
        if i % 9 == 0:
            rows.append((1000 + i, " ".join([*passage, *own[:-1], "other"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = classes(df)
    assert got == brute(rows) and len({c for _, c in got}) == 90


def test_copies_that_differ_in_several_places(spark) -> None:  # noqa: ANN001
    # Some are near the original, some only near each other, and some near none; all meet in buckets.
    rng = np.random.default_rng(8)
    base = [f"b{x}" for x in rng.integers(0, 900, 150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 150):
        own = list(base)
        for at in rng.integers(0, 150, 1 + i % 5):
            own[int(at)] = f"e{int(rng.integers(0, 40))}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert classes(df) == brute(rows)


def test_near_duplicates_of_the_small_table(spark) -> None:  # noqa: ANN001
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.class_id) for r in near_dup.op2_near_dup(spark, SF).collect())
    assert got == brute(real)


def test_samples_agree_as_often_as_sets_are_alike() -> None:
    rng, agree = np.random.default_rng(1), []
    for _ in range(60):
        h = np.unique(rng.integers(0, 2**63, 120, np.uint64))
        w = (1 + 9 * rng.random(len(h))).astype(np.float32)
        truth = near_dup.weighted_jaccard((h[:90], w[:90]), (h[30:], w[30:]))
        agree.append((near_dup.samples(h[:90], w[:90]) == near_dup.samples(h[30:], w[30:])).mean() - truth)
    assert abs(np.mean(agree)) < 0.01


def test_bands_find_pairs_at_the_threshold() -> None:
    rng, met = np.random.default_rng(2), 0
    for _ in range(200):
        h = np.unique(rng.integers(0, 2**63, 100, np.uint64))
        w = np.ones(len(h), np.float32)
        met += bool(set(near_dup.band_keys(near_dup.samples(h[:90], w[:90]))) & set(near_dup.band_keys(near_dup.samples(h[10:], w[10:]))))
    assert met >= 197  # 80 of 100: a similarity of 0.8
