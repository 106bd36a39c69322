"""Linear models of many targets or features, stratified folds, and weights of many models."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.operators import linear, signal, stacking


def test_blocks_of_targets_equal_the_fit_of_all(spark):
    r = np.random.default_rng(5)
    n, f, t = 500, 6, 7
    x, g = r.normal(size=(n, f)) + 3, r.integers(0, 4, n)
    y = x @ r.normal(size=(f, t)) + 3 * r.normal(size=(n, t))
    df = spark.createDataFrame([(int(g[i]), x[i].tolist(), y[i].tolist()) for i in range(n)] + [(None, x[0].tolist(), y[0].tolist()), (1, None, y[0].tolist())], "g int, x array<double>, y array<double>").repartition(3)
    alphas = [2.0**k for k in range(-4, 10, 2)]
    factors = linear.group_factors(df, "g")
    assert all(v.shape == (2 + f, 1 + f + t) for v in factors.r.values())
    whole = linear.nested_ridge_cv(factors, alphas)
    got = {(v.outer_fold, v.target): v for v in linear.nested_ridge_blocks(df, "g", alphas=alphas, block=3).collect()}
    assert len(got) == 4 * t
    for (k, j), v in got.items():
        m = whole.models[k]
        assert v.alpha == m.best_alphas[j] and v.r == pytest.approx(whole.r[k][j]) and v.intercept == pytest.approx(m.intercept[j]) and np.allclose(v.coef, m.coef[:, j])
        tr = g != k
        mx, my = x[tr].mean(0), y[tr, j].mean()
        w = np.linalg.solve((x[tr] - mx).T @ (x[tr] - mx) + v.alpha * np.eye(f), (x[tr] - mx).T @ (y[tr, j] - my))
        assert np.allclose(v.coef, w) and v.r == pytest.approx(np.corrcoef(x[g == k] @ w, y[g == k, j])[0, 1])
    with pytest.raises(Exception, match="NaN"):
        linear.nested_ridge_blocks(df.withColumn("y", F.array(F.lit(float("nan")))), "g").collect()


def test_twenty_thousand_targets_stay_in_blocks(spark):
    t = 20_000
    x = F.array(*(F.hash(F.col("id"), F.lit(k)) / 2.0**31 for k in range(3)))
    y = F.transform(F.sequence(F.lit(1), F.lit(t)), lambda v: F.element_at(x, 1) * v + F.sin(v * F.col("id")))
    df = spark.range(60).select((F.col("id") % 3).cast("int").alias("g"), x.alias("x"), y.alias("y")).repartition(2)
    rows = linear.nested_ridge_blocks(df, "g", alphas=[0.1, 10.0]).where("target in (0, 7777, 19999)").collect()
    few = df.withColumn("y", F.array(*(F.get("y", F.lit(k)) for k in (0, 7777, 19999))))
    want = linear.nested_ridge_cv(linear.group_factors(few, "g"), [0.1, 10.0])
    assert len(rows) == 9
    for v in rows:
        assert v.r == pytest.approx(want.r[v.outer_fold][[0, 7777, 19999].index(v.target)])


def test_few_rows_and_factors_of_fewer_rows_than_columns():
    r = np.random.default_rng(1)
    a = np.column_stack([np.ones(40), r.normal(size=(40, 3)), r.normal(size=(40, 2))])
    parts = [a[:1], a[1:3], a[3:20], a[20:]]
    held = linear.stack_factors(parts, 4)
    tree = linear.stack_factors([linear.stack_factors(parts[:2], 4), linear.stack_factors(parts[2:], 4)], 4)
    assert np.allclose(held, tree) and np.allclose(held[:, :4].T @ held, a[:, :4].T @ a) and np.allclose((held[:, 4:] ** 2).sum(0), (a[:, 4:] ** 2).sum(0))


def test_stratified_cells_and_losses(spark):
    r = np.random.default_rng(2)
    n = 240
    label, x = r.choice(list("aab"), n), r.normal(size=(n, 2))
    y = x @ np.array([[1.0], [-2.0]]) + r.normal(size=(n, 1))
    df = spark.createDataFrame([(i, str(label[i]), x[i].tolist(), y[i].tolist()) for i in range(n)], "i long, label string, x array<double>, y array<double>").repartition(3)
    cells = linear.stratified_cells(df, "label", "i", 3, 4, seed=9).select("i", "label", "outer", "inner", "cell").toPandas()
    assert sorted(cells["cell"].unique()) == list(range(12))
    for _, part in cells.groupby("label"):
        assert np.ptp(part["outer"].value_counts()) <= 1
        assert all(np.ptp(p["inner"].value_counts()) <= 1 for _, p in part.groupby("outer"))
    alphas = [0.1, 30.0, 900.0]
    got = linear.stratified_cv(df, "label", "i", linear.Ridge(alphas, scoring="mse"), 3, 4, seed=9)
    at = cells.set_index("i")

    def fit(rows, alpha):
        a = np.column_stack([x[rows], np.ones(rows.sum())])
        return np.linalg.solve(a.T @ a + alpha * np.eye(3), a.T @ y[rows, 0])

    def loss(rows, w):
        return ((np.column_stack([x[rows], np.ones(rows.sum())]) @ w - y[rows, 0]) ** 2).mean()

    outer, inner = at["outer"].reindex(range(n)).to_numpy(), at["inner"].reindex(range(n)).to_numpy()
    for k in (1, 2, 3):
        mean = [np.mean([loss((outer != k) & (inner == j), fit((outer != k) & (inner != j), a)) for j in range(1, 5)]) for a in alphas]
        assert got[k][0] == pytest.approx(loss(outer == k, fit(outer != k, alphas[int(np.argmin(mean))])))


def test_components_of_many_features(spark):
    r = np.random.default_rng(3)
    n, f = 200, 400
    x = r.normal(size=(n, 5)) * np.array([30, 20, 12, 8, 5]) @ r.normal(size=(5, f)) + 0.3 * r.normal(size=(n, f)) + 5
    x[:, 7] = 2.0  # a constant feature
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)] + [(-1, None)], "i long, x array<double>").repartition(3)
    scored, d = linear.wide_pca(df, 3)
    spread = x.std(0)
    z = (x - x.mean(0)) / np.where(spread < 1e-12, 1, spread)
    _, s, v = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(d.s, s[:3], rtol=1e-6) and np.allclose(np.abs((d.vt * v[:3]).sum(1)), 1, atol=1e-6)
    rows = {q.i: q.scores for q in scored.collect()}
    assert rows[-1] is None and np.allclose([rows[i] for i in range(n)], z @ d.vt.T)


def simplex_by_supports(p):
    k, best, least = len(p), None, np.inf
    for size in range(1, k + 1):
        for s in map(list, combinations(range(k), size)):
            w = np.linalg.solve(p[np.ix_(s, s)], np.ones(size))
            w /= w.sum()
            if (w >= -1e-12).all() and (value := w @ p[np.ix_(s, s)] @ w) < least - 1e-15:
                best, least = np.zeros(k), value
                best[s] = np.maximum(w, 0)
    return best


def test_active_set_equals_all_supports_and_takes_forty_models():
    r = np.random.default_rng(0)
    for k in (1, 2, 3, 5, 8, 12):
        for _ in range(3):
            e = r.normal(size=(60, k)) * r.uniform(0.1, 3, size=k) + r.normal(size=k)
            assert np.allclose(stacking.simplex_weights(e.T @ e / 60), simplex_by_supports(e.T @ e / 60), atol=1e-6)
    e = r.normal(size=(500, 40)) + r.normal(size=(500, 1))
    p = e.T @ e / 500
    w = stacking.simplex_weights(p)
    slope = p @ w
    assert (w >= 0).all() and w.sum() == pytest.approx(1) and np.allclose(slope[w > 0], w @ slope) and (slope >= w @ slope - 1e-9).all()
    twice = stacking.simplex_weights(np.ones((13, 13)))  # all models the same
    assert twice.sum() == pytest.approx(1) and (twice >= 0).all()


@pytest.mark.parametrize("block", [3, 1 << 12])
def test_frames_of_waveforms_in_rows_equal_the_whole(spark, block):
    r = np.random.default_rng(6)
    waves = {"a": r.normal(size=1000), "b": r.normal(size=333), "short": r.normal(size=9)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in waves.items() for i, v in enumerate(x)], "k string, t long, x double").repartition(3)
    for normalise in (False, True):
        got = {(v.k, v.frame): v.spectrum for v in signal.spectrogram_rows(df, ["k"], ["t"], "x", 1600, normalise=normalise, block=block).collect()}
        want = {(k, i): row for k in "ab" for i, row in enumerate(signal.spectrogram(waves[k], 1600, normalise=normalise))}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)


def test_a_pure_tone_has_its_spectrum_in_closed_form(spark):
    """A Hamming-windowed cosine on bin 5 of 32: 0.54 on the bin and 0.23 on both sides, times half the frame."""
    df = spark.range(400).select(F.lit("t").alias("k"), F.col("id").alias("t"), F.cos(2 * np.pi * 5 * F.col("id") / 32).alias("x"))
    rows = [v.spectrum for v in signal.spectrogram_rows(df, ["k"], ["t"], "x", 1600).orderBy("frame").collect()][2:-2]
    want = np.zeros(17)
    want[[4, 5, 6]] = np.log1p(np.array([0.23, 0.54, 0.23]) * 16)
    assert len(rows) > 10 and np.allclose(rows, want, atol=1e-9)
