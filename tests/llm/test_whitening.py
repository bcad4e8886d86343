import math
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import registry, whitening
from tidemark.llm.whitening import ORIGIN, Moments, symmetric_qr

SCHEMA = "vec_id long, embedding array<float>, label int"


def x_of(vector):
    return [math.floor(64 * float(np.float32(c))) + ORIGIN for c in vector]


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def by_hand(rows):
    """Exact sums, deviations and covariance in whole numbers; the eigenvectors by numpy."""
    kept = [(r[0], x_of(r[1])) for r in rows if usable(r[1])]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    apart = [[n * c - s for c, s in zip(x, sums, strict=True)] for x in fit]
    cov = np.array([[float(Fraction(sum(a[i] * a[j] for a in apart), n**3)) for j in range(len(sums))] for i in range(len(sums))])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for i, x in kept}
    centred = {i: np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)]) for i, x in kept}
    return n, deviation, centred, values, vectors


def rows_of(seed, n, width=6, offset=0.0):
    random = np.random.default_rng(seed)
    spread = random.normal(size=(width, width))
    return [(i, [float(np.float32(c)) for c in v], 0) for i, v in enumerate(random.normal(size=(n, width)) @ spread + offset)]


@pytest.mark.parametrize("offset", [0.0, 3000.0])
def test_rows_are_those_of_an_exact_covariance(spark, offset):
    rows = rows_of(1, 300, offset=offset)
    rows += [(1000 + k, rows[7][1], 1) for k in range(400)] + [(None, rows[3][1], 2)]
    rows += [(2000, None, 0), (2001, [1.0] * 5 + [None], 0), (2002, [1.0] * 5 + [float("nan")], 0), (2003, [1.0] * 5 + [float("inf")], 0), (2004, [1.0], 0), (2005, [], 0)]
    n, deviation, centred, values, vectors = by_hand([r for r in rows if r[0] is None or r[0] < 2000])
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert len(got) == 701 and {r.vec_id for r in got} == {r[0] for r in rows if r[0] is None or r[0] < 2000}
    signs = None
    for r in sorted(got, key=lambda r: (r.vec_id is None, r.vec_id)):
        want = centred[r.vec_id] @ vectors / np.sqrt(values)
        signs = np.sign(np.array(r.whitened) * want) if signs is None else signs
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert np.allclose(np.array(r.whitened) * signs, want, rtol=1e-9, atol=1e-9)
        assert np.allclose(r.explained, values / values.sum(), rtol=1e-12) and r.identity_error < 1e-9


def test_many_partitions_meet_by_some_at_a_time(spark):
    rows = rows_of(2, 400, 4)
    x = spark.createDataFrame([([int(c) for c in x_of(v)],) for _, v, _ in rows], "x array<long>").repartition(100)
    some = whitening.moments(x, 4, lambda block: (block - ORIGIN).astype(float))
    every = np.array([x_of(v) for _, v, _ in rows])
    assert some.n == 400 and some.total.tolist() == every.sum(axis=0).tolist()
    assert np.allclose(some.scatter / 400, np.cov(every.T, bias=True))


def test_updates_and_merges_give_one_covariance():
    x = np.random.default_rng(3).normal(size=(90, 5)) + 1e4
    parts = []
    for rows in (x[:1], x[1:30], x[30:30], x[30:]):
        parts.append(Moments(5))
        for row in rows:
            parts[-1].add(row)
    joined = Moments(5)
    for p in parts:
        joined.merge(p.n, p.total, p.mean, p.scatter)
    assert joined.n == 90 and np.allclose(joined.mean, x.mean(axis=0)) and np.allclose(joined.scatter / 90, np.cov(x.T, bias=True))


@pytest.mark.parametrize("size", [1, 2, 3, 9, 40])
def test_eigenvectors_of_symmetric_matrices(size):
    random = np.random.default_rng(size)
    full = random.normal(size=(size, size))
    for a in (full @ full.T, full + full.T, np.zeros((size, size)), np.eye(size), np.ones((size, size)), np.diag(np.arange(size) % 3.0), np.diag(np.ones(size - 1), 1) + np.diag(np.ones(size - 1), -1)):
        values, vectors = symmetric_qr(a)
        scale = max(1, np.abs(a).max())
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * size * scale)
        assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * size * scale
        assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-13 * size


def test_no_rows_one_row_and_constant_entries(spark):
    none = spark.createDataFrame([(1, None, 1), (2, [], 1)], SCHEMA)
    assert whitening.whiten(none).collect() == [] and whitening.whiten(none.limit(0)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, [0.0, 0.0], [0.0, 0.0], 1.0)] * 2
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 5.0, 1e30], 1) for i in range(4)], SCHEMA)).collect()
    assert all(r.explained == [1.0, 0.0, 0.0] and r.whitened[1:] == [0.0, 0.0] for r in flat)


def test_a_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(2**30 * i), float(i)], 1) for i in range(4)]
    assert all(r.deviation is None and np.isfinite(r.whitened).all() for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect())


def test_columns_of_other_names_and_the_query(spark, sf):
    rows = spark.createDataFrame([(i, [float(i), float(i * i)], "x", i) for i in range(5)], "vec_id int, embedding array<double>, n string, part int")
    assert whitening.whiten(rows).columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"] and whitening.whiten(rows).count() == 5
    table = registry.op11_whitening(spark, sf)
    assert table.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = table.collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    n, deviation, centred, values, vectors = by_hand(rows)
    assert len(got) == 16 * len(centred) and {r.n for r in got} == {n} and all(r.deviation == deviation[r.vec_id] for r in got)
    for r in got:
        k = r.component - 1
        assert abs(abs(r.whitened) - abs(centred[r.vec_id] @ vectors[:, k]) / math.sqrt(values[k])) < 1e-6 and abs(r.explained / (values[k] / values.sum()) - 1) < 1e-9
