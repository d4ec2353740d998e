"""Whitening by spectrum slicing against numpy's eigenvectors and exact sums."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestline.llm import whitening
from harvestline.llm.support import Scratch

SF = "/root/testdata/sf0.01"
DDL = "vec_id long, embedding array<double>"


def slow(rows, components=16):
    """{id: [(deviation, whitened by component)]}, n, explained, by numpy over all rows at once."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, sums = len(fit), [sum(col) for col in fit.T]
    centred = np.array([[float(Fraction(int(x) * n - s, n)) for x, s in zip(row, sums)] for row in fit])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    out = defaultdict(list)
    for i, x in kept:
        off = [xi * n - s for xi, s in zip(x, sums)]
        out[i].append((sum(o * o for o in off), np.array([o / n for o in off]) @ u / np.sqrt(e)))
    return out, n, e / np.trace(cov)


def compare(got, rows, components=16, close=1e-9):
    want, n, explained = slow(rows, components)
    by_id = defaultdict(dict)
    for r in got:
        by_id[r.vec_id].setdefault(r.component, []).append(r)
    assert set(by_id) == set(want)
    k = len(explained)
    signs = None
    for i, copies in want.items():
        assert sorted(by_id[i]) == list(range(1, k + 1))
        for c, found in by_id[i].items():
            assert len(found) == len(copies)
            assert sorted(r.deviation for r in found) == sorted(d for d, _ in copies)
            assert all(r.n == n and abs(r.explained / explained[c - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in found)
    for c in range(1, k + 1):
        mine = np.array([sorted(r.whitened for r in by_id[i][c]) for i in want if len(want[i]) == 1]).ravel()
        theirs = np.array([v[c - 1] for i in want if len(want[i]) == 1 for _, v in want[i]])
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < close
    return signs


def test_given_table_equals_numpy(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = whitening.whiten(frame, Scratch(spark, "w")).collect()
    compare(got, [(r.vec_id, r.embedding) for r in frame.collect()])


def random_symmetric(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    m = (q * np.array(values, float)) @ q.T
    return (m + m.T) / 2


SPECTRA = {
    "spread": np.geomspace(1e8, 1e-4, 40), "equal": [3.0] * 12, "groups": [7.0] * 5 + [2.0] * 6 + [0.0] * 9,
    "pairs": [5, 5 - 1e-9, 4, 4 - 1e-13, 3, 1, 1, 0.5], "one": [2.0], "negative": [4, 1, -1, -3, -3], "zero": [0.0] * 4,
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading_values_and_vectors(name):
    values = np.array(SPECTRA[name], float)
    for matrix in (random_symmetric(values, 1), np.diag(values)):
        found, vectors = whitening.leading(matrix, 16)
        want = np.sort(np.linalg.eigvalsh(matrix))[::-1][:16]
        top = np.abs(values).max() + 1e-300
        assert len(found) == min(16, len(values)) and np.abs(found - want).max() <= 1e-13 * top
        assert np.abs(matrix @ vectors - vectors * found).max() <= 1e-12 * top
        assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() <= 1e-11


def test_inertia_counts_values_below_a_shift():
    rng = np.random.default_rng(2)
    for _ in range(300):
        size = rng.integers(1, 12)
        m = rng.integers(-2, 3, (size, size)).astype(float)
        m, shift = m + m.T, float(rng.integers(-40, 40)) / 7 + 0.013
        assert whitening.inertia(m, shift) == (np.linalg.eigvalsh(m) < shift).sum()


def odd_rows():
    rng = np.random.default_rng(4)
    rows = [(k, (rng.standard_normal(5) * [5, 3, 2, 1, 0.5]).tolist()) for k in range(80)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (3, rows[7][1]), (None, rows[9][1])]
    rows += [(300, None), (301, [1.0, None, 2.0, 3.0, 4.0]), (302, [float("nan")] * 5), (303, [float("inf"), 1.0, 1.0, 1.0, 1.0])]
    return rows


def test_nulls_repeats_and_clashing_names(spark):
    rows = odd_rows() + [(400, [1.0, 2.0]), (401, []), (402, [1e300] * 5)]
    frame = spark.createDataFrame(rows, DDL).repartition(5)
    wide = frame.selectExpr("*", *[f"'c' AS {c}" for c in ("id", "x", "entry", "total", "n", "component", "deviation", "whitened", "at", "v")])
    got = whitening.whiten(wide, Scratch(spark, "w")).collect()
    compare(got, odd_rows())
    assert {r.component for r in got} == {1, 2, 3, 4, 5}


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(k, (rng.standard_normal(3) * [3e5, 2e5, 1e5]).tolist()) for k in range(50)]
    compare(whitening.whiten(spark.createDataFrame(rows, DDL), Scratch(spark, "w")).collect(), rows, close=1e-7)
    # deviations beyond a long are null, everything else stays
    rows = [(k, (rng.standard_normal(3) * [3e12, 2e12, 1e12]).tolist()) for k in range(20)]
    found = whitening.whiten(spark.createDataFrame(rows, DDL), Scratch(spark, "w")).collect()
    want, n, explained = slow(rows)
    assert {r.vec_id for r in found} == set(range(20)) and all(r.deviation is None for r in found)
    assert all(abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9 for r in found)


def test_tables_without_components(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]):
        result = whitening.whiten(spark.createDataFrame(rows, DDL), Scratch(spark, "w"))
        assert result.collect() == [] and result.columns[:3] == ["vec_id", "component", "n"]
    # rank one: a single component
    got = whitening.whiten(spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(4)], DDL), Scratch(spark, "w")).collect()
    assert {r.component for r in got} == {1} and len(got) == 4


def test_partial_products_are_added_in_a_tree(spark):
    parts = spark.range(100, numPartitions=50).select(F.lit(np.ones((2, 2)).tobytes()).alias("total"))
    assert whitening._tree_sum(parts, Scratch(spark, "w"), "t", 2).tolist() == [[100, 100], [100, 100]]
