"""Golden values and properties of the library's operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattix.functions import lookups, scalar
from lattix.operators import folds, intervals, linear, lookup, signal, stacking, stats, strf, tables, timeseries
from lattix.plans import options
from lattix.sources import files


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.fixture(scope="module")
def tensor(spark):
    rows = [(b, t, [float(12 * b + 4 * t + f) for f in range(4)]) for b in range(2) for t in range(3)]
    return spark.createDataFrame(rows, "b int, t_idx long, features array<double>")


def test_subdivide(spark):
    for n, k, want in ((7, 2, [1] * 4 + [2] * 3), (15, 3, [1] * 5 + [2] * 5 + [3] * 5), (10, 4, [1, 1, 1, 2, 2, 2, 3, 3, 4, 4]), (3, 5, [1, 2, 3]), (1, 1, [1])):
        df = spark.range(n).repartition(3)
        assert column(folds.subdivide(df, k, ["id"]), "fold", "id") == want
        assert column(folds.subdivide(df.withColumn("g", F.lit(1)), k, ["id"], ["g"]), "fold", "id") == want


def test_partition_within_labels(spark):
    df = spark.createDataFrame(list(enumerate("xxxxxyyy")), "i long, label string").repartition(2)
    part = lambda f, **k: column(folds.partition_within_labels(df, "label", "i", f, **k), "fold", "i")
    assert part(2) == [1, 1, 1, 2, 2, 1, 1, 2]
    assert part([0.6, 0.2, 0.2]) == [1, 1, 1, 2, 3, 1, 1, 2]
    assert part([0.2, 0.2]) == [1, 1, 1, 2, 2, 1, 1, 2]
    assert set(part([0.8, 0.8])) == {1, 2}
    assert sorted(part(2, shuffle=True, seed=1)) == sorted(part(2)) and part(2, shuffle=True, seed=1) == part(2, shuffle=True, seed=1)
    assert folds.leave_one_out(df, "label").count() == 16


def test_lags(tensor):
    s = tensor.where("b = 0").select("b", "t_idx", F.get("features", F.lit(0)).alias("x"))
    past = timeseries.lag_columns(s, "x", timeseries.lag_steps(3), ["b"], ["t_idx"]).orderBy("t_idx").collect()
    assert [tuple(r)[3:] for r in past] == [(0, 0, 0), (4, 0, 0), (8, 4, 0)]
    future = timeseries.lag_columns(s, "x", timeseries.lag_steps(-3), ["b"], ["t_idx"]).orderBy("t_idx").collect()
    assert [tuple(r)[3:] for r in future] == [(0, 4, 8), (4, 8, 0), (8, 0, 0)]
    stack = column(timeseries.lag_stack(tensor.where("b = 0"), "features", [0, 1, 2, 4], ["b"], ["t_idx"]), "lags", "t_idx")
    assert [x[0] for x in stack] == [[0, 0, 0, 0], [4, 0, 0, 0], [8, 4, 0, 0]]
    assert column(timeseries.structure_lag(tensor, "features", 2, ["b"], ["t_idx"]).where("b = 0"), "lagged", "t_idx")[1] == [4, 5, 6, 7, 0, 1, 2, 3]
    with pytest.raises(ValueError):
        timeseries.lag_steps(0)


def test_hanning(spark):
    taps = timeseries.hanning_taps(normalise=False)
    first = {j: h for k, j, h in taps if k == 0}
    assert timeseries.n_windows(0.2, 1) == 9 and len(first) == 19 and first[10] == pytest.approx(1) and first[5] == pytest.approx(0.5)
    assert sum(h for *_, h in taps) == pytest.approx(90)
    x = np.random.default_rng(0).normal(size=(80, 2))
    df = spark.createDataFrame([(1, t, x[t].tolist()) for t in range(80)], "s int, t_idx long, features array<double>")
    for scale in (1.0, 0.5):
        got = np.array(column(timeseries.hanning_feature(df, "features", ["s"], ["t_idx"], scale=scale), "basis", "t_idx"))
        want = np.zeros((80, 2, 9))
        for k, j, h in timeseries.hanning_taps(scale=scale):
            if j < 80:
                want[j:, :, k] += h * x[: 80 - j]
        assert np.allclose(got, want)
    assert timeseries.rho_scales(1) == (1, 0.5) and timeseries.rho_scales(-1) == (0.5, 1)
    with pytest.raises(ValueError):
        timeseries.hanning_taps(scale=0)


def test_rasters_and_islands(spark):
    iv = spark.createDataFrame([("a", 0.0, 0.02), ("b", 0.02, 0.03)], "label string, onset double, offset double")
    n = intervals.time_length(iv)
    assert n == 3 and intervals.sorted_labels(iv) == ["a", "b"]
    wide = [tuple(r)[1:] for r in intervals.onehot_wide(iv, ["a", "b"], n).orderBy("t_idx").collect()]
    assert wide == [(1, 0), (1, 0), (1, 1)]
    back = timeseries.islands(intervals.onehot_long(iv, n), [], "label")
    assert sorted(tuple(r) for r in back.collect()) == [("a", 0.0, 0.02), ("b", 0.02, 0.02)]
    assert column(intervals.onset_raster(spark.createDataFrame([(0.01,)], "onset double"), 5), "value", "t_idx") == [0, 1, 1, 0, 0]
    assert sorted(tuple(r) for r in intervals.onehot_long(iv, n, onset_feature=True).collect()) == [(0, "a"), (2, "b")]
    between = spark.createDataFrame([("c", 0.011, 0.012)], iv.schema)
    assert intervals.onehot_long(between, 5, onset_feature=True).first()["t_idx"] == 2
    with pytest.raises(Exception, match="past the end"):
        intervals.onehot_long(between, 2, onset_feature=True).collect()
    last = spark.createDataFrame([(0, 0.0, 0.03, 1.0), (1, 0.01, 0.02, 2.0)], "i int, onset double, offset double, x double")
    assert column(intervals.last_writer(last, "x", "i", 5, 100, F.lit(0.0)), "x", "t_idx") == [1, 2, 2, 1, 0]


def test_containment_join(spark):
    word = spark.createDataFrame([(0, "", 0.0, 1.0), (1, "one", 0.0, 1.0), (2, "two", 1.0, 2.5)], "idx int, text string, onset double, offset double")
    phone = spark.createDataFrame([(0, "P", 0.1, 0.4), (1, "", 0.4, 0.5), (2, "T", 1.0, 1.25)], word.schema)
    got = [tuple(r) for r in intervals.containment_join(phone, word, 0.5).orderBy("phoneme").collect()]
    assert got[0] == ("P", 0.1, 0.4, "one", 0.0, 1.0, 0, 0.1, 0.4) and got[1][3:7] == ("two", 1.0, 2.5, 1)
    with pytest.raises(Exception, match="no word holds"):
        intervals.containment_join(phone.union(spark.createDataFrame([(3, "X", 2.4, 2.6)], word.schema)), word, 0.5).collect()


def test_interpolation_and_alignment(spark, tensor):
    s = spark.createDataFrame([(1, float(t), float(t * t)) for t in range(4)], "k int, t double, x double")
    at = spark.createDataFrame([(1, v) for v in (0.0, 0.5, 1.0, 2.5, 3.0, 9.0)], "k int, t double")
    assert column(timeseries.interpolate(s, at, ["k"]), "x_new", "t") == [0, 0.5, 1, 6.5, 9]
    one = spark.createDataFrame([("s", float(t), [float(np.sin(t / 8))]) for t in range(200)], "k string, t double, features array<double>")
    same = np.array(column(timeseries.align_time(one, ["k"], timeseries.regular_times(1, -2, 199)), "features", "t"))[:, 0]
    assert len(same) == 202 and (same[:2] == 0).all() and np.allclose(same[2:202], np.sin(np.arange(200) / 8))
    fine = timeseries.align_time(one, ["k"], timeseries.regular_times(2, 20, 150)).toPandas().sort_values("t")
    assert np.allclose(np.stack(fine.features)[:, 0], np.sin(fine.t / 8), atol=5e-3)
    with pytest.raises(Exception, match="needs"):
        timeseries.align_time(one, ["k"], timeseries.regular_times(1, 0, 400)).collect()


def test_tables(spark):
    obs = [(s, r, p, list(range(10 * i, 10 * i + 10))) for i, (s, r, p) in enumerate((s, r, p) for s in "AB" for r in ("1", "2", "3") for p in "xy")]
    df = spark.createDataFrame(obs, "section string, rep string, rate string, data array<long>").repartition(3)
    got = {(r.section, r.rep): r.data for r in tables.concatenate_by_variables(df, ["rate"]).collect()}
    assert len(got) == 6 and got["A", "1"] == [*range(20)] and got["B", "3"] == [*range(100, 120)]
    masked = tables.concatenate_by_variables(df, ["rep", "rate"], fold_mask=True).where("section = 'A'").first()
    assert masked.data[:20] == [*range(10), *range(20, 30)] and masked.rate_mask == ["x"] * 30 + ["y"] * 30
    whole = tables.concatenate_by_variables(df.drop("section", "rep").limit(3), ["rate"]).collect()
    assert len(whole) == 1 and len(whole[0].data) == 30
    assert tables.filter_at(df, [{"section": "A"}, {"section": "A", "rep": "1"}]).count() == 8
    features = spark.createDataFrame([("1", 5), ("2", 6), ("3", 7)], "rep string, feature int")
    x, y = tables.replicate_data_feature(features, df)
    assert x.count() == y.count() == 12 and "data" not in x.columns and "feature" not in y.columns
    with pytest.raises(ValueError, match="levels"):
        tables.replicate_data_feature(features.limit(2), df)
    with pytest.raises(ValueError, match="identify"):
        tables.replicate_data_feature(features, df.union(df))
    ragged = spark.createDataFrame([("a", [[[1.0] * 4] * 3] * 2), ("b", [[[2.0] * 2] * 2])], "other string, y array<array<array<double>>>")
    long = tables.expand_nested(ragged, "y")
    assert long.count() == 28 and long.columns == ["other", "y", "d1_index", "d2_index", "d3_index"]


def test_strf(spark):
    df = spark.createDataFrame([(1, [9.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "k int, coefficients array<double>")
    one = df.select("k", tables.to_strf(F.col("coefficients"), 3).alias("STRF"))
    assert one.first().STRF == [[1, 3, 5], [2, 4, 6]]
    parts = tables.split_strf(one, "STRF", [1, 1], ["a", "b"], ["k"])
    assert {r.feature_name: r.STRF for r in parts.collect()} == {"a": [[1, 3, 5]], "b": [[2, 4, 6]]}
    v = np.array(strf.trf(one).first().TRF)
    assert v.sum() >= 0 and np.linalg.norm(v) == pytest.approx(1)
    assert tables.lag_rows(spark.createDataFrame([(1, [0.0, 3.0, 3.0])], "k int, x array<double>"), ["k"], "x").first().max_lag == 1
    assert spark.range(1).select(tables.normalise_by_max(F.array(F.lit(0.0))), tables.normalise_by_max(F.array(F.lit(2.0), F.lit(1.0)))).first()[:] == ([0.0], [1.0, 0.5])


def test_lookups(spark):
    got = {r.phoneme: r.attributes for r in lookup.attributes_of(spark.createDataFrame([("AA",), ("zz",)], "phoneme string")).collect()}
    assert got == {"AA": ["voiced", "sonorant", "syllabic", "back", "low"], "zz": []}
    ipa = lookup.attributes_of(spark.createDataFrame([("AXH",)], "phoneme string"), "IPA").first()
    assert ipa.attributes == ["voiced", "sonorant", "syllabic"]
    assert lookups.phonemes("SemiVowel") == ["W", "L", "R", "Y"] and lookups.phonemes("none") == []
    vec = spark.createDataFrame([("is", [1.0, 0.0]), ("not", [0.0, 1.0])], "word string, vec array<double>")
    tokens = spark.createDataFrame([("is",), ("ain't",), ("isn't",), ("it's",), ("zz",), (None,), ("IS",)], "word string")
    out = {r.word: r.vec for r in lookup.encode_words(tokens, vec, 2).collect()}
    assert out == {"is": [1, 0], "ain't": [0.5, 0.5], "isn't": [0.5, 0.5], "it's": [0.5, 0], "zz": [0, 0], None: [0, 0], "IS": [0, 0]}


def test_statistics(spark):
    x = spark.createDataFrame([(t, float(a), float(b)) for t, p in ((0, [(1, 1), (3, 2), (5, 3)]), (1, [(2, 2), (4, 2), (6, 2)])) for a, b in p], "target int, x double, y double")
    r = column(stats.correlate_columns(x, "target", "x", "y"), "r", "target")
    assert r[0] == pytest.approx(1) and math.isnan(r[1])
    assert column(stats.usable_targets(x, "target", "y"), "usable", "target") == [True, False]
    wer = stats.word_error_rate(spark.createDataFrame([("a b c d", "a x c"), ("", "z"), ("q", "")], "t string, h string"), "t", "h").first()
    assert (wer.edits, wer.words) == (4, 5)
    assert stats.char_error_rate(spark.createDataFrame([("abc", "abd")], "t string, h string"), "t", "h").first().cer == pytest.approx(1 / 3)


@pytest.fixture(scope="module")
def regression(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 6))
    w = r.normal(size=(6, 3))
    y = x @ w + 3 + r.normal(size=(600, 3))
    g = r.integers(0, 4, 600)
    df = spark.createDataFrame([(i, int(g[i]), x[i].tolist(), y[i].tolist()) for i in range(600)], "row_id long, grp int, x array<double>, y array<double>").repartition(5)
    return df, x, y, g, w


def direct_ridge(x, y, alpha):
    mx, my = x.mean(0), y.mean(0)
    w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return w, my - mx @ w


def test_nested_ridge_equals_direct_fits(regression):
    df, x, y, g, _ = regression
    f = linear.group_factors(df, "grp")
    alphas = [2.0**k for k in range(-10, 11)]
    res = linear.nested_ridge_cv(f, alphas)
    for k in range(4):
        rest = [j for j in range(4) if j != k]
        loss = np.zeros((3, len(alphas), 3))
        for i, h in enumerate(rest):
            tr = (g != k) & (g != h)
            for a, alpha in enumerate(alphas):
                w, b = direct_ridge(x[tr], y[tr], alpha)
                loss[i, a] = ((x[g == h] @ w + b - y[g == h]) ** 2).mean(0)
        assert np.allclose(-res.models[k].cv_scores, loss, rtol=1e-9)
        best = loss.mean(0).argmin(0)
        assert (res.models[k].best_alphas == np.array(alphas)[best]).all()
        for t in range(3):
            w, b = direct_ridge(x[g != k], y[g != k], alphas[best[t]])
            assert np.allclose(res.models[k].coef[:, t], w[:, t])
            assert res.r[k][t] == pytest.approx(np.corrcoef(x[g == k] @ w[:, t], y[g == k, t])[0, 1])
    rows = linear.predict(df, res.models, "grp").collect()
    assert all(np.allclose(r.y_hat, x[r.row_id] @ res.models[r.grp].coef + res.models[r.grp].intercept) for r in rows)
    sizes = {k: v.count() for k, v in linear.result_tables(df.sparkSession, res).items()}
    assert sizes == {"r": 12, "coefs": 72, "intercepts": 12, "best_alphas": 12, "cv_scores": 4 * 3 * 21 * 3}
    inner = linear.nested_ridge_cv(f, alphas, {0: {1: "a", 2: "a", 3: "b"}})
    assert len(inner.models[0].cv_scores) == 2 and len(inner.models[1].cv_scores) == 3


def test_weights_by_method(regression):
    df, x, y, _, w = regression
    f = linear.group_factors(df, "grp")
    d = linear.decompose(f.of(f.r), f.f)
    least = linear.regression_weights(d, "least-squares")
    want = np.linalg.lstsq(np.column_stack([np.ones(600), x]), y, rcond=None)[0]
    assert np.allclose(least, want)
    for method, k in (("pcreg", 6), ("pls", 6), ("ridge", 1e-9), ("lasso", 1e-9)):
        assert np.allclose(linear.regression_weights(d, method, k), want, atol=1e-5), method
    assert np.allclose(linear.regression_weights(d, "lasso", 1e9)[1:], 0)
    model = linear.Ridge([0.5]).fit(f)
    a = np.column_stack([x, np.ones(600)])
    direct = np.linalg.solve(a.T @ a + 0.5 * np.eye(7), a.T @ y)
    assert np.allclose(model.coef, direct[:-1]) and np.allclose(model.intercept, direct[-1])
    assert set(linear.Ridge([0.1, 1e6], scoring="mse").inner_cv(f).best_alphas) == {0.1}
    assert len(linear.Ridge([1.0], scoring="r", normalize=True).outer_cv(f)) == 4
    scores, parts = linear.pca(df)
    s = np.array(column(scores, "scores", "row_id"))
    z = (x - x.mean(0)) / x.std(0)
    assert np.allclose(s @ parts.vt, z) and np.allclose(parts.vt @ parts.vt.T, np.eye(6))


def test_stacking(spark):
    assert np.allclose(stacking.simplex_weights(np.array([[2, 0.5], [0.5, 1]])), [0.25, 0.75])
    r = np.random.default_rng(1)
    for _ in range(5):
        e = r.normal(size=(50, 4)) + r.normal(size=4)
        p = e.T @ e / 50
        w = stacking.simplex_weights(p)
        assert (w >= 0).all() and w.sum() == pytest.approx(1)
        assert all(w @ p @ w <= v @ p @ v + 1e-12 for v in [*np.eye(4), *r.dirichlet(np.ones(4), 200)])
    long = spark.createDataFrame([(i, t, m, float(r.normal() * (m + 1))) for i in range(60) for t in range(2) for m in range(3)], "row int, t int, m int, e double")
    out = stacking.stacking_weights(long, "row", "t", "m").groupBy("t").agg(F.sum("weight").alias("s")).collect()
    assert all(x.s == pytest.approx(1) for x in out)


def test_scalars_and_signal(spark):
    one = spark.range(1).select(scalar.strip_stress(F.lit("AH0")), scalar.strip_stress(F.lit("HH")), scalar.hz_to_erb(F.lit(1000.0)), scalar.erb_to_hz(scalar.hz_to_erb(F.lit(440.0))), scalar.erb_to_hz_ferret(scalar.hz_to_erb_ferret(F.lit(440.0))), scalar.list_to_text(F.array(F.lit(1), F.lit(2))), scalar.frame_times(F.lit(3))).first()
    assert one[:2] == ("AH", "HH") and one[2] == pytest.approx(15.572457147860659) and one[3] == pytest.approx(440) and one[4] == pytest.approx(440) and one[5] == "1-2" and one[6] == [-0.5, 319.5, 639.5]
    x = np.sin(2 * np.pi * 1000 * np.arange(16001) / 16000)
    s = signal.spectrogram(x)
    assert s.shape[1] == 161 and (s[5:-5].argmax(1) == 20).all()
    bank, cut, f = signal.erb_filters(4000, 16000, 10, 50, 7000)
    # each cosine stops one bin short of its upper edge, so the squares sum to 1 but for those bins
    assert bank.shape == (2001, 12) and np.median(np.abs((bank**2).sum(1) - 1)) < 1e-9
    assert np.allclose(signal.fft_resample(signal.fft_resample(x[:800, None], 1600), 800)[:, 0], x[:800], atol=1e-9)
    assert np.allclose(signal.envelope(np.cos(2 * np.pi * 5 * np.arange(100) / 100)[:, None]), 1)
    assert np.sqrt(np.mean(signal.format_wav(np.stack([x, x], 1), 16000, 0.5, 8000) ** 2)) == pytest.approx(0.01)
    t = np.linspace(0, 1, 9)
    assert np.allclose(signal.pchip(t, np.stack([t, 2 * t], 1), np.array([0.3, 0.77])), [[0.3, 0.6], [0.77, 1.54]])


def test_options():
    o = options.parse_options(["rate", 50, "bands", ["low", "mid"]], {"rate": 100, "width": [2, 5], "bands": ["all"]})
    assert o.changed == {"rate": True, "width": False, "bands": True} and o.values["width"] == [2, 5]
    assert options.options_to_text(o, ["width"], ["rate"]) == "width-2-5_bands-low-mid"
    assert options.struct_to_text({"tag": "lag", "span": [0.25, 8]}) == "tag-lag_span-0.25-8"
    assert options.struct_to_text({"tag": "lag", "q": "z"}, max_len=7, delimiter="/") == "tag-lag/q-z"
    assert options.to_text([]) == options.to_text(None) == "NULL"
    for bad in (["rate"], ["rate", 1, "rate", 2], ["z", 1], ["rate", "x"]):
        with pytest.raises(ValueError):
            options.parse_options(bad, {"rate": 1})


def test_alignment_to_uneven_times(spark, tensor):
    s = spark.createDataFrame([("s", t, [t * 2, 1.0]) for t in (0.0, 0.4, 1.0, 1.1, 2.0)], "k string, t double, features array<double>")
    got = timeseries.align_time(s, ["k"], [0.1, 0.4, 1.05, 1.9], resample_first=False).orderBy("t").collect()
    assert [r.t for r in got] == [0.1, 0.4, 1.05, 1.9] and np.allclose([r.features for r in got], [[0.2, 1], [0.8, 1], [2.1, 1], [3.8, 1]])
    padded = timeseries.align_time(s, ["k"], [-1.0, 0.0, 1.0, 2.0, 3.0], interpolate=False, resample_first=False).orderBy("t", F.get("features", F.lit(1))).collect()
    assert [r.t for r in padded] == [-1.0, 0.0, 0.4, 1.0, 1.1, 2.0, 3.0] and padded[0].features == padded[-1].features == [0.0, 0.0]
    with pytest.raises(Exception, match="needs"):
        timeseries.align_time(s, ["k"], timeseries.regular_times(2, 0, 9)).collect()


def test_basis_expansion_streams_through_series(spark):
    r = np.random.default_rng(4)
    rows = [(k, t, None if (k, t) == (1, 3) else r.normal(size=2).tolist()) for k in range(3) for t in range(40 + 30 * k)]
    df = spark.createDataFrame(rows, "k int, t int, features array<double>").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(x.k, x.t): x.basis for x in timeseries.hanning_feature(df, "features", ["k"], ["t"], sr=20).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    taps = timeseries.hanning_taps(sr=20)
    value = {(k, t): x or [0.0, 0.0] for k, t, x in rows}
    assert len(got) == len(rows)
    for (k, t), basis in got.items():
        want = np.zeros((2, timeseries.n_windows(0.2, 1)))
        for w, j, h in taps:
            if t - j >= 0:
                want[:, w] += h * np.array(value[k, t - j])
        assert np.allclose(basis, want)
    assert timeseries.hanning_feature(df.limit(0), "features", ["k"], ["t"], sr=20).count() == 0


def test_folds_from_index_lists(spark):
    df = spark.createDataFrame([(k, "ab"[k % 2]) for k in range(10)] + [(None, "c")], "row int, label string")
    tests = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, 0), (3, 1)], "row int, fold int")
    got = {(r.row, r.fold) for r in folds.folds_from_lists(df, tests, "row", 2).where("is_test").collect()}
    assert got == {(1, 0), (2, 1), (3, 0), (3, 1)} and folds.folds_from_lists(df, tests, "row", 2).count() == 22
    dealt = folds.partition_within_labels(spark.createDataFrame([(k, "ab"[k % 3 == 0]) for k in range(23)] + [(40 + k, None) for k in range(5)], "row int, label string"), "label", "row", 4)
    assert sorted((r.label or "", r.fold, r["count"]) for r in dealt.groupBy("label", "fold").count().collect()) == sorted([("a", f, 4 - (f > 3)) for f in (1, 2, 3, 4)] + [("b", f, 2) for f in (1, 2, 3, 4)] + [("", 1, 2), ("", 2, 1), ("", 3, 1), ("", 4, 1)])
    assert [r.fold for r in dealt.where("label = 'b'").orderBy("row").collect()] == [1, 1, 2, 2, 3, 3, 4, 4]


def test_scores_pool_over_targets(spark):
    r = np.random.default_rng(5)
    y = r.normal(size=(40, 3)) * [1, 5, 0.2] + [10, -3, 0]
    p = y + r.normal(size=y.shape) * [0.5, 2, 0.3]
    df = spark.createDataFrame([(int(i), int(t), float(y[i, t]), float(p[i, t])) for i in range(40) for t in range(3)], "i int, t int, y double, p double")
    got = stats.scores(df, "t").first()
    assert np.isclose(got.mse, ((p - y) ** 2).mean()) and np.isclose(got.r2, 1 - ((p - y) ** 2).sum() / ((y - y.mean(0)) ** 2).sum()) and np.isclose(got.r, np.corrcoef(y.ravel(), p.ravel())[0, 1])
    flat = stats.scores(df.withColumn("y", F.lit(2.0)), "t").first()
    assert flat.r2 is None and np.isnan(flat.r)
    odd = df.withColumn("y", F.when(F.col("t") == 0, 1.0).when((F.col("t") == 1) & (F.col("i") == 3), F.lit(float("nan"))).otherwise(F.col("y")))
    found = {x.t: x.r for x in stats.scores_of_usable(odd, "t").collect()}
    assert found[0] == found[1] == 0 and np.isclose(found[2], np.corrcoef(y[:, 2], p[:, 2])[0, 1])


def test_lasso_goes_with_the_mean_of_squared_errors(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(50, 3))
    y = x @ [2.0, -1.0, 0.1] + 3
    df = spark.createDataFrame([(0, a.tolist(), [float(b)]) for a, b in zip(x, y)], "g int, x array<double>, y array<double>")
    d = linear.decompose(linear.group_factors(df, "g").r[0], 3, std=False)
    w = linear.regression_weights(d, "lasso", [0.05, 0.5])[:, 1:, 0]
    c = x - x.mean(0)
    for k, one in zip((0.05, 0.5), w):
        slope = c.T @ (y - y.mean() - c @ one) / 50  # at the least: k * sign(w), or within k where w is 0
        assert np.allclose(slope[one != 0], k * np.sign(one[one != 0]), atol=1e-6) and (np.abs(slope[one == 0]) <= k + 1e-6).all()


def test_sound_shapes(spark):
    sound = np.sin(np.arange(1601) / 5)
    low, high = signal.cochleagram(sound, 16000, 100, 6), signal.cochleagram(sound, 16000, 100, 6, flip=True)
    assert low.shape == (10, 6) and np.allclose(low, high[:, ::-1])
    assert len(signal.cochleagram(sound[:960], 16000, 100, 6)) == 6 and len(signal.cochleagram(np.tile(sound, 2)[:2500], 16000, 100, 6)) == 16
    bank, cut, _ = signal.erb_filters(4000, 16000, 10, 50, 7000, "ferret")
    assert np.allclose((bank**2).sum(1)[(np.linspace(0, 8000, 2001) > cut[1]) & (np.linspace(0, 8000, 2001) < cut[-2])], 1, atol=0.05)
    assert np.allclose(signal.erb_to_hz_ferret(signal.hz_to_erb_ferret([50, 800, 7000])), [50, 800, 7000])
    f = np.array([100.0, 200, 400, 800])
    same = signal.resample_time_and_freq(low[:, :4], 100, 100, f, f)
    assert np.allclose(same, low[:, :4])
    df = spark.createDataFrame([(0, [[1.0, 3.0], [2.0, 6.0]]), (1, [[0.0], [0.0]])], "layer int, activation array<array<double>>")
    assert {r.layer: r.mean for r in signal.layer_means(df).collect()} == {0: [0.5, 1.0], 1: [0.0, 0.0]}


def test_files(spark, tmp_path):
    (tmp_path / "i.csv").write_text("label,onset\na,0\n>,0.5\nb,1.0\n")
    got = [tuple(r)[2:] for r in files.read_intervals(spark, str(tmp_path / "i.csv")).orderBy("idx").collect()]
    assert got == [(0.0, 0.5, "a"), (0.5, 1.0, "")]
    (tmp_path / "w.csv").write_text("on,off,x,lab\n0,1,9,p\n1,2,9,q\n")
    wide = files.read_intervals(spark, str(tmp_path / "w.csv"), 3, 0, 1)
    assert [tuple(r)[2:] for r in wide.orderBy("idx").collect()] == [(0.0, 1.0, "p"), (1.0, 2.0, "q")]
    files.csv_to_textgrid(spark, [str(tmp_path / "i.csv"), str(tmp_path / "i.csv")], str(tmp_path / "out"), ["phones", "words", "more"])
    grid = files.read_textgrids(spark, str(tmp_path / "out"))
    assert grid.where("tier = 'phones'").count() == 2 and files.words(grid).count() == 1
    back = grid.where("tier = 'words'").orderBy("idx").select("xmin", "xmax", "text").collect()
    assert [tuple(r) for r in back] == [(0.0, 0.5, "a"), (0.5, 1.0, "")]
    stressed = spark.createDataFrame([("f", "phones", 0, 0.0, 1.0, "AH0"), ("f", "phones", 1, 1.0, 2.0, "")], grid.schema)
    assert [r.text for r in files.phones(stressed).collect()] == ["AH"]
    assert {r.tier for r in files.tier_per_label(wide).collect()} == {"p", "q"}
    (tmp_path / "v.txt").write_text("the 1 2.5\nof 0 -1\n")
    v = files.read_vectors(spark, str(tmp_path / "v.txt"))
    files.keep_vectors(v, str(tmp_path / "v.parquet"))
    assert {r.word: r.vec for r in files.read_vectors(spark, str(tmp_path / "v.parquet")).collect()} == {"the": [1, 2.5], "of": [0, -1]}
    with pytest.raises(ValueError):
        files.read_vectors(spark, "x.pkl")
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[0, 16384], [-32768, 0]], "<i2").tobytes())
    r = files.read_wavs(spark, str(tmp_path / "a.wav")).first()
    assert (r.sr, r.channels, r.samples) == (8000, 2, [[0, 0.5], [-1, 0]])
    waves = spark.createDataFrame([("p", 10, [0.5] * 100)], "path string, sr int, samples array<double>")
    layers = signal.layer_activations(waves, lambda: lambda x, sr: [x[:10, None], x[:5, None]])
    assert [(r.layer, len(r.activation), r.time_stamp[:2]) for r in layers.orderBy("layer").collect()] == [(0, 10, [-0.5, 319.5]), (1, 5, [-0.5, 319.5])]


def test_streams(spark, tmp_path):
    from lattix.streaming import live

    parts = [[("u", 0, 1.0, "a"), ("u", 1, 2.0, "a"), ("w", 0, 9.0, "b")], [("u", 3, 4.0, "b"), ("u", 2, 3.0, "a"), ("u", 1, 7.0, "z")], [("u", 4, 5.0, "c")]]
    schema = "k string, t long, x double, label string"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for name, df in (("lags", live.stream_lags(source(), "k", "t", "x", 3)), ("runs", live.stream_islands(source(), "k", "t", "label"))):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r.k, r.t): r.lags for r in spark.table("lags").collect()}
    assert got["u", 0] == [1, 0, 0] and got["u", 1] == [2, 1, 0] and got["w", 0] == [9, 0, 0]
    assert all(len(v) == 3 for v in got.values())
    runs = {tuple(r) for r in spark.table("runs").collect()}
    assert any(r[0] == "u" and r[1] == "a" and r[2] == 0.0 for r in runs)


def test_concatenated_digests_hold_no_series(spark):
    import hashlib

    rows = [(g, rep, k, None if k % 7 == 3 else (k * 37 + rep) % 11) for g in "ABC" for rep in (2, 1) for k in range(50 * (g != "B") + 3)] + [(None, 1, 0, 1)]
    df = spark.createDataFrame(rows, "g string, rep int, k int, data int").repartition(3)
    out = tables.digest_concatenated(df, ["rep"], ["k"], fold_mask=True)
    digest = lambda xs: str(sum(int(hashlib.md5(f"{i}:{'' if x is None else x}".encode()).hexdigest()[:15], 16) for i, x in enumerate(xs)))
    ordered = {g: sorted((r[1:] for r in rows if r[0] == g), key=lambda r: r[:2]) for g in "ABC"}
    assert sorted(tuple(r) for r in out.collect()) == [(g, digest(r[2] for r in x), digest(r[0] for r in x)) for g, x in ordered.items()]
    assert "collect_list" not in out._jdf.queryExecution().toString()
    assert tables.digest_concatenated(df.limit(0), ["rep"], ["k"]).count() == 0
    placed = tables.concatenate_rows(df, ["rep"], ["k"])
    assert {tuple(r) for r in placed.where("g = 'A'").collect()} == {("A", x[2], x[0], i) for i, x in enumerate(ordered["A"])}


def test_cochleagram_of_a_tone_and_of_silence(spark):
    """A tone on a frequency of the spectrum has the same envelope at all times: its amplitude times each filter's gain there."""
    n, sr, k = 1600, 16000, 100
    bank, _, f = signal.erb_filters(n, sr, 8, 80, 6990)
    tone = 0.5 * np.cos(2 * np.pi * k * np.arange(n) / n)
    rows = spark.createDataFrame([(0, tone.tolist(), sr), (1, [0.0] * n, sr), (2, None, sr)], "id long, samples array<double>, sr int")
    out = {r["id"]: r["c"] for r in signal.map_waveforms(rows, lambda x, r: signal.cochleagram(x, r, n=8, low=80, high=6990, compression=1.0), "c").collect()}
    assert f[k] == 1000 and (bank[k, 1:-1] > 0).sum() >= 1
    assert np.allclose(np.array(out[0]), np.tile(0.5 * np.abs(bank[k, 1:-1]), (10, 1)), atol=1e-9)
    assert not np.any(out[1]) and out[2] is None


def test_time_and_frequency_of_even_planes():
    """Constant in time and linear in octaves: both survive, beyond the ends as well."""
    f = np.array([100.0, 200.0, 400.0, 800.0])
    x = np.tile(2 + 3 * np.log2(f), (16, 1))
    to = np.array([50.0, 300.0, 1600.0])
    assert np.allclose(signal.resample_time_and_freq(x, 8, 12, f, to), np.tile(2 + 3 * np.log2(to), (24, 1)))


def test_rank_one_responses(spark):
    lags = np.array([0.1, 0.9, -0.3, 0.2])
    planes = [(0, np.outer([1.0, -2.0, 0.5], lags).tolist()), (1, np.outer([-1.0, 2.0, 0.5], -lags).tolist()), (2, None), (3, []), (4, [[1.0, None], [0.0, 1.0]]), (5, [[math.nan, 1.0]])]
    out = {r["id"]: r["TRF"] for r in strf.trf(spark.createDataFrame(planes, "id long, STRF array<array<double>>")).collect()}
    want = lags / np.linalg.norm(lags)
    assert np.allclose(out[0], want) and np.allclose(out[1], want)
    assert all(out[k] is None for k in (2, 3, 4, 5))


def test_balanced_blocks_keep_the_whole_norm(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4)) * [1.0, 10.0, 100.0, 0.0] + [3.0, 0.0, -5.0, 0.0]
    y = rng.normal(size=(40, 1))
    blocks = [0, 0, 1, 2]
    # rows, and the same by hand
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i long, a double, b double, c double, z double")
    got = np.array([[r.a, r.b, r.c, r.z] for r in stats.balance_groups(df, {"one": ["a", "b"], "two": ["c"], "none": ["z"]}).orderBy("i").collect()])
    share = np.linalg.norm(x) / math.sqrt(3)
    assert np.allclose(got, x / np.array([*[np.linalg.norm(x[:, :2]) / share] * 2, np.linalg.norm(x[:, 2]) / share, 1.0]))
    # weights of ridge on centred, balanced features
    r = np.linalg.qr(np.column_stack([np.ones(40), x, y]), mode="r")
    for std in (False, True):
        c = x - x.mean(0)
        c = c / np.where(c.std(0) == 0, 1, c.std(0)) if std else c
        share = np.linalg.norm(c) / math.sqrt(3)
        scale = np.array([*[np.linalg.norm(c[:, :2]) / share] * 2, np.linalg.norm(c[:, 2]) / share, 1.0])
        b = c / scale
        assert math.isclose(np.linalg.norm(b[:, :2]), np.linalg.norm(b[:, 2]))
        w = np.linalg.solve(b.T @ b + 7.0 * np.eye(4), b.T @ (y - y.mean())) / scale[:, None]
        w = w / np.where(x.std(0) == 0, 1, x.std(0))[:, None] if std else w
        assert np.allclose(linear.regression_weights(linear.decompose(r, 4, std, True, blocks), "ridge", 7.0)[1:], w)
    # one block is left as it is
    whole, plain = linear.decompose(r, 4, False, True, [0] * 4), linear.decompose(r, 4, False)
    assert np.allclose(whole.s, plain.s) and np.allclose(whole.norm, plain.norm)


def test_interval_joins_broadcast_no_intervals(spark):
    """A planner takes words that a sequence makes of few rows for few."""
    p = spark.range(40).select(F.lit(1).alias("u"), F.col("id").alias("idx"), F.lit("a").alias("text"), F.col("id").cast("double").alias("onset"), (F.col("id") + 0.5).alias("offset"))
    w = spark.range(1).select(F.lit(1).alias("u"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("idx"))
    w = w.select("u", "idx", F.concat(F.lit("w"), F.col("idx").cast("string")).alias("text"), (F.col("idx") * 10.0).alias("onset"), (F.col("idx") * 10.0 + 11).alias("offset"))
    out = intervals.containment_join(p, w, 10, ["u"])
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert column(out, "word_index", "phoneme_absolute_onset") == [0] * 11 + [1] * 10 + [2] * 10 + [3] * 9


def test_signs_of_equal_loadings():
    """The components of two standardised columns load both equally, whichever rounding makes the larger."""
    for tilt in (-1e-12, 1e-12):
        a, b = np.cos(np.pi / 4 + tilt), np.sin(np.pi / 4 + tilt)
        x = np.array([[2 * a, 2 * b], [a, -b], [0, 0]])
        r = np.concatenate([np.array([[2.0], [0], [0]]), np.concatenate([np.zeros((1, 2)), x[:2]]), np.zeros((3, 1))], 1)
        vt = linear.decompose(r, 2, std=False).vt
        assert (np.sign(vt) == [[1, 1], [1, -1]]).all()


def test_wide_components_of_two_columns(spark):
    """All pairs of 50 and 9 values, and one row that links the columns a little."""
    x = spark.range(45_001).select(F.array(F.when(F.col("id") == 45_000, 50.0).otherwise(F.col("id") % 50 + 1.0), F.when(F.col("id") == 45_000, 0.08).otherwise(F.floor(F.col("id") / 50) % 9 / 100.0)).alias("x"))
    for parts in (1, 2, 3, 5):
        vt = linear.wide_pca(x.repartition(parts), 2)[1].vt
        assert np.abs(vt * 2**0.5 - [[1, 1], [1, -1]]).max() < 1e-11


def test_phones_as_csv_without_broadcast(spark, tmp_path):
    """What io13_phones writes is joined by sort and merge too."""
    from lattix.plans import catalog

    rows = catalog._phones_in_words(spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    files.write_rows(rows, f"{tmp_path}/phones")
    back = spark.read.option("header", True).schema(rows.schema).csv(f"{tmp_path}/phones")
    assert back.exceptAll(rows).isEmpty() and back.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_waveforms_give_results_in_parts():
    """100 waveforms of a batch, of which two results are as many numbers as a task holds at once."""
    import pandas as pd

    wide = signal.RESULT_NUMBERS // 2
    x = pd.Series([None if k == 50 else np.full(4, float(k)) for k in range(100)])
    made = list(signal.waveform_results([(x, pd.Series([8] * 100))], lambda a, r: np.full((2, wide // 2), a[0] + r)))
    assert max(map(len, made)) <= 3
    rows = [v for s in made for v in s]
    assert len(rows) == 100 and rows[50] is None and all(v[1][-1] == k + 8 for k, v in enumerate(rows) if k != 50)


def test_alignment_streams_through_blocks(spark):
    """Many short series in one stream, whose batches end within blocks."""
    df = spark.range(30).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"), "id")
    df = df.select("k", (F.col("i") / 2).alias("t"), F.array(F.col("id") * 100.0 + F.col("i"), F.lit(1.0)).alias("features"))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in (7, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            out = timeseries.align_time(df, ["k"], [0.25, 3.0, 8.75], resample_first=False, block=6)
            assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
            got = {(r.k, r.t): r.features for r in out.collect()}
            assert got == {(f"s{k}", t): [k * 100 + 2 * t, 1.0] for k in range(30) for t in (0.25, 3.0, 8.75)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_digests_are_summed_as_longs(spark):
    """Sums of decimals for each row took a good part of the time; the parts make the same digest, above a long's range too."""
    import hashlib

    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), F.lit(1).alias("rep"), (F.col("id") % 13).alias("data"))
    out = tables.digest_concatenated(rows, ["rep"], ["k"])
    assert "sum(cast(conv" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {g: str(sum(int(hashlib.md5(f"{i}:{(2 * i + g) % 13}".encode()).hexdigest()[:15], 16) for i in range(1500))) for g in (0, 1)}
    assert {r.g: r.data for r in out.collect()} == want and all(int(v) > 1 << 63 for v in want.values())


def test_words_of_users_are_many_tasks(spark):
    """Adaptive execution sees 15 users, not the 15,000 words that are made of them."""
    from lattix.plans import catalog

    words = catalog._words_of_users(spark, spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    tasks = words.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 15_000
