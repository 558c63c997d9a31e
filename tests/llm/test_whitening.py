"""Whitening against dense linear algebra and exact integers."""

from __future__ import annotations

import numpy as np
import pytest

from quillsift.llm import qd_svd, whitening

COLUMNS = "vec_id long, embedding array<double>, id int, vector string, n int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 0) for i, v in rows], COLUMNS)


def triangles():
    rng = np.random.default_rng(3)
    ring = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    return {
        "random": np.linalg.qr(rng.normal(size=(300, 40)), mode="r"),
        "graded": np.linalg.qr(rng.normal(size=(300, 12)) * 10.0 ** -np.arange(12), mode="r"),
        "copied": np.linalg.qr(np.repeat(rng.normal(size=(90, 6)), 2, axis=1), mode="r"),
        "repeated": ring @ np.diag([5.0] * 10 + [1.0] * 10 + [1e-3] * 10),
        "close": np.diag(np.ones(21)) + np.diag(np.abs(np.arange(20) - 10.0), 1),
        "same": np.eye(9) * 3,
        "few": np.vstack([rng.normal(size=(4, 11)), np.zeros((7, 11))]),
        "one": np.array([[2.0]]),
        "none": np.zeros((4, 4)),
    }


@pytest.mark.parametrize("name", list(triangles()))
def test_singular_values_and_vectors(name):
    matrix = triangles()[name]
    values, vectors = qd_svd.right_singular(matrix, 32)
    expected = np.linalg.svd(matrix)[1]
    assert np.allclose(np.sqrt(values), expected, atol=1e-13 * max(expected[0], 1))
    rank = int((expected > 1e-11 * expected[0]).sum())
    assert vectors.shape[1] == min(32, rank)
    kept = values[: vectors.shape[1]]
    assert np.allclose(np.sqrt(kept), expected[: len(kept)], rtol=1e-9)
    assert np.abs(vectors.T @ vectors - np.eye(len(kept))).max(initial=0) < 1e-10
    off = matrix.T @ (matrix @ vectors) - vectors * kept
    assert np.abs(off).max(initial=0) <= 1e-11 * max(expected[0], 1) ** 2


def expected_rows(rows, components=32):
    whole = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    count = len(whole)
    off = whole * count - whole.sum(axis=0)
    centred = off.astype(float) / count
    variances, vectors = np.linalg.eigh(centred.T @ centred / count)
    variances, vectors = variances[::-1], vectors[:, ::-1]
    kept = [k for k in range(min(components, len(variances))) if variances[k] > 1e-18 * variances[0]]
    return count, (off * off).sum(axis=1), centred, variances, vectors[:, kept]


@pytest.mark.parametrize("dims", [5, 40])
def test_whitening_is_dense_algebra(spark, dims):
    rng = np.random.default_rng(dims)
    good = [(n, (rng.normal(size=dims) * (1 + np.arange(dims))).tolist()) for n in range(200)]
    good += [(7, good[7][1]), (7, good[3][1]), (None, good[9][1])]
    bad = [(900, None), (901, []), (902, [None] * dims), (903, [float("nan")] * dims), (904, [float("inf")] + [0.0] * (dims - 1)),
           (905, [1.0, 2.0]), (906, [1e300] * dims)]
    found = whitening.whiten(table_of(spark, good + bad).repartition(5)).collect()
    count, deviations, centred, variances, vectors = expected_rows(good)
    assert len(found) == count * min(dims, 32)
    assert {r["n"] for r in found} == {count}
    assert max(r["identity_error"] for r in found) < 1e-9
    got = {}
    for r in found:
        assert abs(r["explained"] / (variances[r["component"] - 1] / variances.sum()) - 1) < 1e-9
        got.setdefault((r["id"], int(r["deviation"])), {})[r["component"]] = r["whitened"]
    assert set(got) == {(i, d) for (i, _), d in zip(good, deviations, strict=True)}
    projected = centred @ vectors / np.sqrt(variances[: vectors.shape[1]])
    signs = {}
    for (key, _), deviation, line in zip(good, deviations, projected, strict=True):
        own = got[key, deviation]
        for k, value in enumerate(line):
            if abs(value) > 1e-3:
                sign = signs.setdefault(k, np.sign(value) * np.sign(own[k + 1]))
                assert abs(own[k + 1] - sign * value) < 1e-8 * max(1, abs(value))


def test_whitening_of_dependent_dimensions(spark):
    rng = np.random.default_rng(1)
    rows = [(n, [*v, v[0], 3.0]) for n, v in enumerate(rng.normal(size=(50, 3)).tolist())]
    found = whitening.whiten(table_of(spark, rows)).collect()
    assert {r["component"] for r in found} == {1, 2, 3}
    assert found[0]["identity_error"] < 1e-10


def test_whitening_beyond_long(spark):
    rows = [(0, [1.6e10, 0.0]), (1, [-1.6e10, 1.0]), (2, [0.5, 1.0])]
    found = whitening.whiten(table_of(spark, rows)).collect()
    _, deviations, *_ = expected_rows(rows)
    assert {(r["id"], int(r["deviation"])) for r in found} == {(i, d) for (i, _), d in zip(rows, deviations, strict=True)}
    assert max(deviations) > 2**63


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_whitening_without_variance_has_no_rows(spark, rows):
    assert whitening.whiten(table_of(spark, rows)).collect() == []
