import math
from fractions import Fraction

import numpy as np
import pytest

from tidewater.llm import whitening as W


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a") for i, v in rows], "vec_id long, embedding array<double>, x int, n string")


def data(seed, n=400, d=20):
    rng = np.random.Generator(np.random.PCG64(seed))
    return (rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 0.4 + rng.normal(size=d) * 100).tolist()


def by_component(rows):
    out = {}
    for r in rows:
        out.setdefault(r["vec_id"], {})[r["component"]] = r
    return out


def test_by_plain_arithmetic(spark):
    found = data(1)
    rows = list(enumerate(found)) + [(9000 + i, found[0]) for i in range(100)]
    got = by_component(W.component_rows(vectors(spark, rows).repartition(7)).collect())
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    assert len(got) == len(rows)
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(v, sums, strict=True)] for v in fit])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    all_centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(v, sums, strict=True)] for v in x])
    want = all_centred @ basis[:, :16] / np.sqrt(values[:16])
    have = np.array([[got[i][k + 1]["whitened"] for k in range(16)] for i, _ in rows])
    signs = np.sign((want * have).sum(axis=0))
    assert np.abs(have - want * signs).max() < 1e-8
    for (i, _), v in zip(rows, x, strict=True):
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        assert all(r["deviation"] == deviation and r["n"] == n and r["identity_error"] < 1e-9 for r in got[i].values())
    assert all(abs(got[0][k + 1]["explained"] - values[k] / values.sum()) < 1e-10 for k in range(16))


def test_merging_keeps_a_small_spread_beside_a_large_offset():
    rng = np.random.Generator(np.random.PCG64(2))
    x = rng.integers(-3, 4, (5000, 6)) + 10**12
    whole = W.Moments.of(x)
    parts = [W.Moments.of(p) for p in np.array_split(x, 37)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.merged(p)
    true = np.cov((x - 10**12).T, bias=True)
    assert merged.n == whole.n == 5000 and merged.sums == whole.sums == tuple(x.sum(axis=0).tolist())
    assert np.abs(merged.scatter / 5000 - true).max() < 1e-6 and np.abs(whole.scatter / 5000 - true).max() < 1e-9


def test_fewer_directions_than_components(spark):
    line = [(i, [float(i % 9), 2.0 * (i % 9), 5.0]) for i in range(30)]
    got = W.component_rows(vectors(spark, line)).collect()
    assert len(got) == 30 and {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-12 and r["n"] == 9 for r in got)
    assert W.component_rows(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_odd_rows(spark):
    good = [(i, v) for i, v in enumerate(data(3, 40, 5))]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [1.0, math.nan, 0.0, 0.0, 0.0]), (104, [math.inf, 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [-math.inf] * 5)]
    repeated = [(None, good[0][1]), (7, good[7][1]), (7, good[7][1])]
    frame = vectors(spark, good + bad + repeated)
    got = W.component_rows(frame).collect()
    assert len(got) == (len(good) + len(repeated)) * 5 and {r["vec_id"] for r in got} == {*range(40), None}
    plain = {(r["vec_id"], r["component"]): r["deviation"] for r in W.component_rows(vectors(spark, good)).collect()}
    assert all(r["deviation"] == plain[0 if r["vec_id"] is None else r["vec_id"], r["component"]] for r in got)
    assert W.component_rows(frame.limit(0)).columns == W.component_rows(frame).columns and W.component_rows(frame.limit(0)).count() == 0
    floats = spark.createDataFrame([(i, v) for i, v in good], "vec_id string, embedding array<float>")
    assert W.component_rows(floats).count() == 200


@pytest.mark.parametrize("far", [1e30, -1e30])
def test_huge_entries(spark, far):
    rows = [(i, [float(i), far if i == 3 else 0.0]) for i in range(8)]
    got = W.component_rows(vectors(spark, rows)).collect()
    assert all(r["deviation"] is None or r["deviation"] >= 0 for r in got) and len(got) >= 8
