"""Operator 11 against cuts by plain string slices."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import SF
from test_text_operators import SCHEMA, TEXTS

from ledgerloom.llm import fim

MORE = [(20, "a <P> in the text", "e"), (21, "almost <P and <S and M> and <<", "e"), (22, "日本語𝒳é" * 3000, "e"), (23, "日本語𝒳é" * 3000, "e"), (24, "x", "e"), (24, "another text of the same id", "e")]


def cut(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def digested(rows: list[tuple]) -> list[tuple]:
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return sorted(((*r[:5], sha(r[5]), sha(t or "")) for r, t in rows), key=repr)


@pytest.fixture(scope="module")
def docs(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "extra", "extra", "extra", "extra") for i, t, s in TEXTS + MORE], SCHEMA).repartition(3)


@pytest.mark.parametrize("chunk", [1, 3, 64, fim.CHUNK])
def test_cuts(docs, chunk: int) -> None:  # noqa: ANN001
    got = fim.fill_in_middle(docs, chunk=chunk).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", *fim.RESULTS)) for r in got), key=repr) == sorted((cut(i, t) for i, t, _ in TEXTS + MORE), key=repr)
    # Other columns pass through; clashing ones are replaced.
    assert {r.lang for r in got} == {"en"} and {r.n_tokens for r in got} == {"extra"}
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_query_on_the_table(spark) -> None:  # noqa: ANN001
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = digested([(cut(r.doc_id, r.text), r.text) for r in rows])
    got = fim.op11_fim(spark, SF)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_restore_gives_every_text_back(docs) -> None:  # noqa: ANN001
    out = fim.fill_in_middle(docs, plain_percent=0, spm_percent=50)
    back = out.select("text", fim.restore(out["output"], out["form"]).alias("back")).collect()
    assert all((r.text or "") == r.back for r in back)


def test_empty_table_and_clashing_names(spark) -> None:  # noqa: ANN001
    none = spark.createDataFrame([], SCHEMA)
    assert fim.fill_in_middle(none).collect() == []
    clash = spark.createDataFrame([(1, "some text", 7, "old", "_h0", "_rest")], "doc_id int, text string, n int, output string, _h0 string, _rest string")
    (row,) = fim.fill_in_middle(clash).collect()
    assert (row.n, row._h0, row._rest) == (9, "_h0", "_rest")


@pytest.mark.parametrize("unit, pattern", [("code_point", r"(?s)."), ("line", r"[^\n]*\n|[^\n]+$"), ("word", r"^[\s]+(?=\S)|\S+\s*|^\s+$")])
def test_units_and_places_at_any_chunk_size(unit: str, pattern: str) -> None:
    rnd = random.Random(unit)
    for chunk in (1, 2, 5, 4096):
        texts = ["".join(rnd.choice("aé日𝒳 \nb") for _ in range(rnd.choice([0, 1, 5, 200]))) for _ in range(6)]
        raw = [t.encode() for t in texts]
        at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        found = fim.Boundaries(np.frombuffer(b"".join(raw), np.uint8), at, unit, chunk)
        for i, t in enumerate(texts):
            begins = [len(t[: m.start()].encode()) for m in re.finditer(pattern, t) if m.end() > m.start()]
            assert found.n[i] == len(begins)
            ranks = np.arange(len(begins) + 1)
            assert found.places(np.full(len(ranks), i), ranks).tolist() == [int(at[i]) + b for b in [*begins, len(raw[i])]]
