"""Recall where norms differ or dimensions are many, and ids that many rows repeat."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.llm import ann


def _recall(spark, ids, vectors, k=20):
    rows = list(zip(ids.tolist(), vectors.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    names, at = np.unique(ids, return_inverse=True)
    hits = total = 0
    for q in names[names % 50 == 0]:
        scores = np.full(len(names), -np.inf)
        np.maximum.at(scores, at, (vectors[ids == q] @ vectors.T).max(axis=0))
        scores[names == q] = -np.inf
        best = names[np.argsort(-scores, kind="stable")[:k]]
        assert len(got[q]) == len(set(got[q])) == k
        hits += len(set(best) & set(got[q]))
        total += k
    return hits / total


def _unit(rng, n, dim):
    v = rng.normal(size=(n, dim))
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


@pytest.mark.parametrize("kind", ["one of 2", "fifteen of 10", "gaussian", "384"])
def test_recall_on_uneven_norms_and_dimensions(spark, kind):
    rng = np.random.default_rng(11)
    vectors = _unit(rng, 3000, 384 if kind == "384" else 64)
    if kind == "one of 2":
        vectors[17] *= 2
    if kind == "fifteen of 10":
        vectors[100:115] *= 10
    if kind == "gaussian":
        vectors = rng.normal(size=vectors.shape)
    assert _recall(spark, np.arange(3000), vectors) >= 0.9


def test_recall_stays_where_buckets_are_probed(spark):
    """Clustered vectors of 128 dimensions in two norm bands."""
    rng = np.random.default_rng(12)
    vectors = _unit(rng, 100, 128).repeat(60, axis=0) + 0.03 * rng.normal(size=(6000, 128))
    vectors[::2] *= 3
    calls = []
    plan = ann._plan

    def spy(*args):
        calls.append(plan(*args))
        return calls[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ann, "_plan", spy)
        assert _recall(spark, np.arange(6000), vectors) >= 0.9
    assert calls[0]


def test_repeated_rows_and_a_hot_id(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 200)
    rng = np.random.default_rng(13)
    vectors, ids = _unit(rng, 1500, 64), np.arange(1500)
    twice = np.repeat(vectors, 2, axis=0)
    assert _recall(spark, np.repeat(ids, 2), twice) >= 0.9
    copies = np.concatenate([vectors, np.repeat(vectors[7:8], 25, axis=0)])
    assert _recall(spark, np.append(ids, np.full(25, 7)), copies) >= 0.9
    ids[::3] = 1
    assert _recall(spark, ids, vectors) >= 0.9


def test_best_ids_of_a_block():
    rng = np.random.default_rng(14)
    vectors = rng.normal(size=(40, 8))
    ids = np.where(np.arange(40) < 25, 7, np.arange(40))
    vectors[:25] = 5 * vectors[39]
    row, found, _, _ = ann.top_of_block(vectors[39:], np.array([100]), vectors, ids, 10)
    assert len(found) == 10 and found[0] == 7 and len(set(found.tolist())) == 10


def _share(spark, vectors, k=20):
    """Rows scored per query over all rows, each once per table that probes it, under the measured plan."""
    n = len(vectors)
    rows = [(i, v, i % 50 == 0) for i, v in enumerate(vectors.tolist())]
    df = spark.createDataFrame(rows, "id long, vector array<double>, asks boolean").cache()
    lsh = ann.CrossPolytope(64, 4, 20, *ann.layout(n, 64))
    plan = ann._plan(df, df.where("asks"), lsh, n, k)
    least = plan.least[ann.bands_of(vectors, plan.longest)]
    queries = vectors[50 * np.random.default_rng(3).choice(n // 50, 64, replace=False)]
    return sum((lsh.values(queries, vectors, t) >= least).mean() for t in range(plan.tables))


@pytest.mark.parametrize("kind", ["even", "clusters"])
def test_share_of_rows_scored_falls(spark, kind):
    """Eight times the rows: hashing scores a smaller share of them, and fewer than a scan at either size."""
    rng = np.random.default_rng(15)
    shares = []
    for n in (5000, 40000):
        vectors = _unit(rng, n, 64)
        if kind == "clusters":
            vectors = _unit(rng, n // 50, 64).repeat(50, axis=0) + 0.05 * vectors * 8
        shares.append(_share(spark, vectors))
    print(kind, shares)
    assert shares[0] < 0.8
    assert shares[1] <= 0.75 * shares[0]


def test_values_cells_and_buckets_agree():
    """The rows that a cell's blocks offer a query are those whose bucket's value reaches the threshold."""
    rng = np.random.default_rng(16)
    vectors, queries = _unit(rng, 4000, 16), _unit(rng, 20, 16)
    lsh = ann.CrossPolytope(16, 1, 20, [4, 2], [16, 4])
    cell, axes = lsh.places(vectors, 0)
    want = lsh.values(queries, vectors, 0) >= 0.9
    asked, named = lsh.cells_of(queries, 0, np.full(20, 0.9))
    got = np.zeros_like(want)
    for c in np.unique(named).tolist():
        at, of = np.flatnonzero(cell == c), asked[named == c]
        if len(at):
            scores = ann.bucket_scores(lsh, 0, c, 0.9, queries[of], vectors[at], axes[at])
            got[of[:, None], at[None, :]] = scores > -np.inf
    assert want.any() and not want.all()
    assert (got == want).all()


def test_unit_vectors_are_one_band():
    vectors = _unit(np.random.default_rng(17), 1000, 64).astype(np.float32).astype(np.float64)
    assert set(ann.bands_of(vectors, ann.norms_of(vectors).max()).tolist()) == {0}
    assert ann.bands_of(np.array([[1e-300, 0.0], [1e300, 0.0]]), 1e300).tolist() == [ann.BANDS - 1, 0]
