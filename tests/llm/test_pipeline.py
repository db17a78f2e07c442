"""The corpus pipeline against five stages in plain Python, and on odd tables."""

from __future__ import annotations

import math
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_near_dup import brute as near_classes
from test_text_operators import SCHEMA, TEXTS, _clean_brute, _lines_brute, _quality_brute
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from ledgerloom.llm import bpe
from ledgerloom.llm.shared import WHITE

WORD = r"[^\x20\x09-\x0D]+"


def _first_stages(rows: list[tuple]) -> list[tuple]:
    """(doc_id, source, text) after quality rules, line dedup and near-duplicates."""
    count = lambda t: sum(c not in WHITE for c in t)
    clean = [(i, s, _clean_brute(t)) for i, s, t in rows if not _quality_brute(t)[-1] and 2 * count(_clean_brute(t)) >= count(t)]
    lines = [(i, s, t) for (i, s, _), (_, _, _, t) in zip(clean, _lines_brute([(i, t) for i, _, t in clean]), strict=True)]
    keep = {c for _, c in near_classes([(i, t) for i, _, t in lines])}
    return [r for r in lines if r[0] in keep]


def _targets(sizes: dict[str, int]) -> dict[str, float]:
    weights, capped = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sorted(sizes))}, set()
    while True:
        rest, free = sum(sizes.values()) - sum(3 * sizes[s] for s in capped), sum(w for s, w in weights.items() if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else rest * weights[s] / free for s in sizes}
        more = {s for s in sizes if target[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not more:
            return target
        capped |= more


def test_run_against_plain_python(spark) -> None:  # noqa: ANN001
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kept = _first_stages([(r.doc_id, r.source, r.text) for r in docs.values()])
    texts, words = {i: t for i, _, t in kept}, {i: re.findall(WORD, t) for i, _, t in kept}
    sizes: dict[str, int] = {}
    for i, s, _ in kept:
        sizes[s] = sizes.get(s, 0) + len(words[i])
    rate = {s: t / sizes[s] for s, t in _targets(sizes).items()}
    library, got = Tokenizer.from_file(bpe.tokenizer_path()), {}
    for r in entry.queries()["pipeline"](spark, SF).collect():
        assert list(r.ids) == library.encode(r.text, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert (r.lang, r.source) == (docs[r.doc_id].lang, docs[r.doc_id].source)
        got.setdefault(r.doc_id, []).append(r.text)
    for i, s, _ in kept:
        n, own = len(words[i]), got.pop(i, [])
        if not n:  # emptied by line dedup: nothing to take
            assert not own
            continue
        whole, parts = own.count(texts[i]), [t for t in own if t != texts[i]]
        taken = whole * n + sum(len(re.findall(WORD, t)) for t in parts)
        # Whole repetitions, then a run of words as long as the fraction says, rounded up or down.
        assert whole in (math.floor(rate[s]), math.floor(rate[s]) + 1) and len(parts) <= 1 and abs(taken - rate[s] * n) <= 1
        assert all(t in texts[i] for t in parts)
    assert not got


@pytest.mark.parametrize("empty", [False, True])
def test_odd_tables(spark, empty: bool) -> None:  # noqa: ANN001
    long = " ".join(f"Word{i} goes{i * 7} before{i * 3} after{i}." for i in range(12))
    more = [(20, long, "a"), (None, long + " Once more.", "b"), (20, long, "a"), (20, "Another text of the same number. " + long[::-1] + ".", "b")]
    rows = [] if empty else [(i, t, "en", s, len(t or ""), "extra", "extra", "extra", "extra") for i, t, s in [*TEXTS, *more]]
    docs = spark.createDataFrame(rows, SCHEMA)
    # Names of the operators' results and helpers.
    clash = ["size", "target", "source_size", "n_lines", "n_dropped", "clean_text", "_text", "_doc", "_row", "_rest", "_words", "node"]
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        found = docs.collect()
        assert bool(found) != empty, name
        assert {tuple(r[c] for c in clash) for r in found} <= {tuple(range(len(clash)))}, name
        if name != "bpe_encoding":
            assert docs.columns == columns and all(r.taken == "extra" for r in found), name
            assert all(r.n_chars == len(r.text or "") for r in found), name
        if name == "near_duplicates" and not empty:
            assert [r.doc_id for r in before.collect()].count(20) == 3 and [r.doc_id for r in found].count(20) == 2
            assert [r.doc_id for r in found].count(None) == before.where("doc_id IS NULL").count()
