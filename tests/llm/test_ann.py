"""Nearest neighbours: recall against brute force, and odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from ledgerloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def _brute(rows: list[tuple], neighbours: int = 5, every: int = 50) -> dict:
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        others = np.flatnonzero(ids != ids[i])
        order = others[np.lexsort((ids[others], -np.round(s[others], 12)))][:neighbours]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall(spark) -> None:  # noqa: ANN001
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = _brute(rows), {}
    for r in ann.op3_ann(spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want)
    hits = sum(v in {x for x, _ in got[q].values()} for q, near in want.items() for v, _ in near)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for near in got.values():
        assert sorted(near) == list(range(1, len(near) + 1)) and all(near[i][1] >= near[i + 1][1] - 1e-15 for i in range(1, len(near)))


def test_odd_vectors_and_ties(spark) -> None:  # noqa: ANN001
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=9).tolist(), 0, "x", "x") for i in range(120)]
    same = rng.normal(size=9).tolist()
    rows += [(200 + i, same, 0, "x", "x") for i in range(150)]
    fine = list(rows)
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, 0, "x", "x"), (401, [0.0] * 9, 0, "x", "x"), (450, [nan] + [1.0] * 8, 0, "x", "x"), (500, [inf] + [1.0] * 8, 0, "x", "x"), (550, [None] + [1.0] * 8, 0, "x", "x"), (None, same, 0, "x", "x"), (600, [1.0, 2.0], 0, "x", "x"), (250, same, 1, "x", "x")]
    out = ann.search(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    got: dict = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = _brute([(i, e) for i, e, *_ in fine])
    assert set(got) == {0, 50, 100, 200, 250, 300} and all(len(v) == 5 for v in got.values())
    for q in (200, 250, 300):  # equal vectors: the smallest ids, without the query itself
        assert got[q] == [v for v, _ in want[q]]


@pytest.mark.parametrize("noise", [0.02, 0.3])
def test_near_copies_of_a_third_of_the_rows(spark, monkeypatch, noise: float) -> None:  # noqa: ANN001
    monkeypatch.setattr(ann, "ROW_BLOCK", 700)
    monkeypatch.setattr(ann, "SECOND_QUERY_BLOCK", 20)
    rng = np.random.default_rng(9)
    one = rng.normal(size=32)
    x = [one + noise * rng.normal(size=32) if i % 3 == 0 else rng.normal(size=32) for i in range(2400)]
    rows = [(i, [float(v) for v in np.float32(e)], 0, "x", "x") for i, e in enumerate(x)]
    got: dict = {}
    for r in sorted(ann.search(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = _brute([(i, e) for i, e, *_ in rows])
    assert {q: [v for v, _ in near] for q, near in got.items()} == {q: [v for v, _ in near] for q, near in want.items()}
    assert all(abs(s - t) < 1e-12 for q in want for (_, s), (_, t) in zip(got[q], want[q], strict=True))


def test_no_row_is_below_its_bound() -> None:
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 24))
    x[::3] = x[0] + 0.05 * rng.normal(size=(len(x[::3]), 24))
    parts = ann._parts(x)
    books, eta = ann.fit(x)
    codes = ann.assign(parts, books, eta)
    along, across = ann.residuals(parts, codes, books)
    unit, columns = x / np.linalg.norm(x, axis=1, keepdims=True), ann.pack_codes(codes).T
    for q in unit[:60]:
        near = ann.approximate(q.astype(np.float32), columns, books)
        for row, c in enumerate(unit @ q):
            assert near[row] >= ann.needed(float(c), along[row], across[row], ann.slack(books))


def test_few_rows_and_none(spark) -> None:  # noqa: ANN001
    few = spark.createDataFrame([(0, [1.0, 0.0, 0.0], 0, "", ""), (1, [1.0, 0.1, 0.0], 0, "", "")], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.search(few).collect()] == [(0, 1, 1)]
    assert ann.search(few.where("vec_id = 1")).count() == 0
    assert ann.search(few.where(F.lit(False))).count() == 0


def test_anisotropic_codebooks_lose_less_along_the_vector() -> None:
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    parts = ann._parts(x)

    def along(threshold: float) -> float:
        books, eta = ann.fit(x, threshold=threshold)
        codes = ann.assign(parts, books, eta)
        rest = parts - books[np.arange(parts.shape[1])[None, :], codes]
        return float(((rest * parts).sum((1, 2)) ** 2).mean())

    assert along(0.6) < along(0.0)


@pytest.mark.parametrize("dim", [1, 2, 3, 7])
def test_tables_add_up(dim: int) -> None:
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(50, dim))
    books, eta = ann.fit(x)
    codes = ann.assign(ann._parts(x), books, eta)
    packed, q = ann.pack_codes(codes), rng.normal(size=dim).astype(np.float32)
    table = ann.tables(q, books)
    sums = sum(table[i][packed[:, i]] for i in range(packed.shape[1]))
    full = np.zeros(len(books) * ann.SUB, np.float32)
    full[:dim] = q
    want = (books[np.arange(len(books))[None, :], codes].reshape(50, -1) * full).sum(1)
    assert np.allclose(sums, want, atol=1e-4)
