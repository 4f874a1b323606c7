import math
import random

import numpy as np
import pytest

from trafficbrick.llm.whitening import op13_whitening, whiten

SCHEMA = "component string, vec_id long, embedding array<double>, n long"


def brute(vectors, components=8, scale=1024, shift=100_000):
    """Everything from the covariance matrix of exactly centred rows."""
    d = max(map(len, vectors))
    x = np.array([[math.floor(scale * c) + shift for c in v] + [shift] * (d - len(v)) for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = np.array([[float(v) for v in r] for r in n * x - s]) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    some = int((values[:components] > 1e-12 * values.sum()).sum())
    return y, values, axes[:, :some], [sum(int(v) ** 2 for v in r) for r in n * x - s]


def check(got, vectors, ids, components=8, unique=True):
    y, values, axes, deviation = brute(vectors, components)
    k = axes.shape[1]
    assert len(got) == k * len(vectors)
    rows = {}
    for r in got:
        rows.setdefault(r.vec_id, {})[r.component] = r
    assert set(rows) == set(ids) and all(set(r) == set(range(1, k + 1)) for r in rows.values())
    for i, key in enumerate(ids):
        assert {r.deviation for r in rows[key].values()} == {deviation[i]}
        assert {r.n for r in rows[key].values()} == {len(vectors)}
    z = np.array([[rows[key][c + 1].whitened for c in range(k)] for key in ids])
    assert np.abs(z.T @ z / len(z) - np.eye(k)).max() < 1e-9
    assert np.allclose([rows[ids[0]][c + 1].explained for c in range(k)], values[:k] / values.sum(), rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 <= got[0].identity_error < 1e-9
    if unique:
        want = y @ axes / np.sqrt(values[:k])
        sign = np.sign((want * z).sum(axis=0))
        assert np.abs(z * sign - want).max() < 1e-6
    return z, y


@pytest.mark.parametrize("n,d", [(400, 12), (30, 40), (3, 5), (50, 1)])
def test_matches_the_covariance(table, n, d):
    rnd = random.Random(n)
    spread = [3.0 ** -k + 0.01 for k in range(d)]
    vectors = [[rnd.gauss(k % 5, s) for k, s in enumerate(spread)] for _ in range(n)]
    got = whiten(table([("x", i, v, 3) for i, v in enumerate(vectors)], SCHEMA)).collect()
    check(got, vectors, list(range(n)))


def test_repeated_and_missing_variances(table):
    """Two equal variances, a third one, and dimensions without any."""
    signs = [(a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]
    vectors = [[2.0 * a, 2.0 * b, 0.5 * c, 7.0, 0.0] for a, b, c in signs]
    got = whiten(table([("x", i, v, 3) for i, v in enumerate(vectors)], SCHEMA)).collect()
    z, y = check(got, vectors, list(range(8)), unique=False)
    assert z.shape == (8, 3)
    # the first two components span the first two dimensions
    assert np.abs(np.linalg.lstsq(y[:, :2], z[:, :2], rcond=None)[0].T @ np.linalg.lstsq(y[:, :2], z[:, :2], rcond=None)[0]
                  - np.eye(2) / (2048.0 ** 2)).max() < 1e-12


def test_odd_rows(table):
    rnd = random.Random(5)
    nan, inf = float("nan"), float("inf")
    good = [[rnd.gauss(0, 1), rnd.gauss(0, 2)] for _ in range(20)] + [[1.0], []]
    bad = [None, [None, 1.0], [nan, 1.0], [1.0, -inf], [1e300, 0.0]]
    rows = [("x", i, v, 3) for i, v in enumerate(good)] + [("x", 100 + i, v, 3) for i, v in enumerate(bad)]
    check(whiten(table(rows, SCHEMA)).collect(), good, list(range(22)))
    again = whiten(table(rows + [("x", None, good[0], 3), ("x", 0, good[0], 3)], SCHEMA), components=1).collect()
    assert len(again) == 24 and sum(r.vec_id is None for r in again) == 1 and sum(r.vec_id == 0 for r in again) == 2


def test_far_entries_are_exact(table):
    vectors = [[float(1 << 40), 1.0], [-float(1 << 40), 2.0], [3.0, 4.0]]
    got = whiten(table([("x", i, v, 3) for i, v in enumerate(vectors)], SCHEMA)).collect()
    assert {r.deviation for r in got} == {None} | ({brute(vectors)[3][2]} if brute(vectors)[3][2] < 1 << 63 else set())


def test_without_variance(spark, table):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(table([("x", 1, [1.0, 2.0], 3)], SCHEMA)).count() == 0
    assert whiten(table([("x", i, [1.0, 2.0], 3) for i in range(9)], SCHEMA)).count() == 0
    assert whiten(table([("x", 1, None, 3)], SCHEMA)).columns == \
        ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_query_on_the_table(spark, sf_small):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()}
    fine = {k: list(v) for k, v in rows.items() if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    ids = sorted(fine)
    out = op13_whitening(spark, sf_small)
    check(out.collect(), [fine[k] for k in ids], ids)
