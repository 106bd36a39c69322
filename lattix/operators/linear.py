"""Linear models from one small factor per group of rows.

For each group Spark keeps what the QR decomposition of [1, x] makes of the rows: its R, Q'y, and per target the norm of what is left of y,
as one last row. Partial factors per task are stacked and decomposed again, so rows never travel, and any set of groups has the factor of
its stacked factors. As 1 comes first, a factor holds the means in its first row and the centred data below; squared errors of any weights
are column norms of the factor times the weights. Working on R and not on x'x keeps the condition number of x. A factor has
(2 + features) * (1 + features + targets) numbers: nothing grows with the square of the targets.

With few targets the factors of all groups reach the driver. ``nested_ridge_blocks`` is for many: rows are dealt out by blocks of targets
within their task, blocks are solved in tasks of their own, and results are written by executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

#: The penalties tried by default, 2^-100 to 2^99.
ALPHAS = tuple(2.0**k for k in range(-100, 100))


def stack_factors(parts: Iterable[np.ndarray], p: int) -> np.ndarray:
    """The factor of all rows that the given factors, or rows themselves, stand for; the first ``p`` columns are those of [1, x]."""
    a = np.concatenate(list(parts))
    q, r = np.linalg.qr(a[:, :p])
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    q, top = q * sign, np.zeros((p, a.shape[1]))
    top[: len(r), :p] = r * sign[:, None]
    inside = q.T @ a[:, p:]
    top[: len(r), p:] = inside
    rest = np.zeros((1, a.shape[1]))
    rest[0, p:] = np.sqrt(((a[:, p:] - q @ inside) ** 2).sum(0))
    return np.concatenate([top, rest])


@dataclass
class Factors:
    """The factor of every group, and the numbers of features and targets."""

    r: dict[object, np.ndarray]
    f: int
    t: int

    def without(self, *groups: object) -> np.ndarray:
        return stack_factors((r for g, r in self.r.items() if g not in groups), 1 + self.f)

    def of(self, groups: Iterable[object]) -> np.ndarray:
        return stack_factors((self.r[g] for g in groups), 1 + self.f)


#: Numbers of a stretch of rows that a task decomposes at once.
STRETCH = 1 << 20


def _shape(df: DataFrame, x: str, y: str) -> tuple[int, int]:
    """(features, targets) of the first row; rows that differ are found when they are decomposed."""
    shape = df.select(F.size(x).alias("f"), F.size(y).alias("t")).first()
    if shape is None:
        raise ValueError("no rows")
    return shape["f"], shape["t"]


def factor_rows(rows: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """(keys, r): the factor of each key of ``rows`` (keys, x, y), its rows one after another. Tasks keep one factor a key; factors are merged in two steps."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, r array<double>"

    def key_of(part: pd.DataFrame) -> tuple:
        return tuple(part[k].iloc[0] for k in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for _, part in pdf.groupby(list(keys), sort=False):
                key = key_of(part)
                step = max(1, STRETCH // (p + len(part["y"].iloc[0])))
                for i in range(0, len(part), step):
                    some = part.iloc[i : i + step]
                    a = np.column_stack([np.ones(len(some)), np.stack(some["x"].to_numpy()), np.stack(some["y"].to_numpy())])
                    if np.isnan(a).any():
                        raise ValueError("NaN among features or targets")
                    held[key] = stack_factors([held[key], a] if key in held else [a], p)
        yield pd.DataFrame([(*g, r.ravel().tolist()) for g, r in held.items()], columns=[*keys, "r"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key_of(pdf), stack_factors((np.array(v).reshape(p + 1, -1) for v in pdf["r"]), p).ravel().tolist())], columns=[*keys, "r"])

    parts = rows.mapInPandas(partial, schema)
    tree = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy(*keys, "salt").applyInPandas(merge, schema)
    return tree.groupBy(*keys).applyInPandas(merge, schema)


def _usable(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    return df.where(f"{group} is not null and {x} is not null and {y} is not null").select(F.col(group).alias("g"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y"))


def group_factors(df: DataFrame, group: str, x: str = "x", y: str = "y") -> Factors:
    """Factors of array columns x and y per group. Rows with a null group, x or y are left out; NaN is an error."""
    rows = _usable(df, group, x, y)
    f, t = _shape(rows, "x", "y")
    return Factors({r["g"]: np.array(r["r"]).reshape(f + 2, -1) for r in factor_rows(rows, ["g"], 1 + f).collect()}, f, t)


def centred(r: np.ndarray, f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """(mean of x, mean of y, centred x, centred y, rows) that a factor stands for."""
    n = r[0, 0]
    return r[0, 1 : 1 + f] / n, r[0, 1 + f :] / n, r[1:, 1 : 1 + f], r[1:, 1 + f :], float(n * n)


def ridge_path(r: np.ndarray, f: int, alphas: Sequence[float], intercept: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(weights: alphas x f x targets, intercepts: alphas x targets) by one SVD."""
    mx, my, x, y, _ = centred(r, f)
    if not intercept:
        x, y, mx, my = r[:, 1 : 1 + f], r[:, 1 + f :], 0 * mx, 0 * my
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    keep = s > s.max(initial=0) * np.finfo(float).eps * max(x.shape)
    u, s, vt = u[:, keep], s[keep], vt[keep]
    uy = u.T @ y
    shrink = s[None, :] / (s[None, :] ** 2 + np.asarray(alphas, float)[:, None])
    w = np.einsum("kf,ak,kt->aft", vt, shrink, uy)
    return w, my[None] - np.einsum("f,aft->at", mx, w)


def squared_loss(r: np.ndarray, f: int, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean squared error per target of weights (.. x f x t) and intercepts (.. x t) on the rows of a factor."""
    error = r[:, 1 + f :] - np.einsum("pf,...ft->...pt", r[:, 1 : 1 + f], w) - r[:, 0][:, None] * b[..., None, :]
    return (error**2).sum(-2) / r[0, 0] ** 2


def correlation_of(r: np.ndarray, f: int, w: np.ndarray) -> np.ndarray:
    """Pearson r per target of predictions and truth on the rows of a factor; NaN where either is constant."""
    _, _, x, y, _ = centred(r, f)
    p = x @ w
    a, b = np.sqrt((p**2).sum(0)), np.sqrt((y**2).sum(0))
    scale = np.finfo(float).eps * 100 * np.abs(r).max(initial=1)
    ok = (a > scale) & (b > scale)
    return np.where(ok, np.clip((p * y).sum(0) / np.where(ok, a * b, 1), -1, 1), np.nan)


@dataclass
class RidgeModel:
    coef: np.ndarray
    intercept: np.ndarray
    best_alphas: np.ndarray
    cv_scores: np.ndarray  # folds x alphas x targets, negative mean squared errors
    alphas: tuple[float, ...] = field(default=ALPHAS)


def ridge_cv(factors: Factors, groups: Sequence[object] | None = None, alphas: Sequence[float] = ALPHAS, intercept: bool = True, folds: Mapping[object, object] | None = None) -> RidgeModel:
    """Leave one group out (or one fold of groups, where ``folds`` maps groups to folds), the penalty with the least loss per target (the smaller one of equals), fitted on all."""
    groups = sorted(factors.r, key=str) if groups is None else list(groups)
    alphas = tuple(sorted(alphas))
    label = {g: folds[g] if folds else g for g in groups}
    kinds = sorted(set(label.values()), key=str)
    if len(kinds) < 2:
        raise ValueError("cross-validation needs two groups at least")
    scores = []
    for k in kinds:
        w, b = ridge_path(factors.of(g for g in groups if label[g] != k), factors.f, alphas, intercept)
        scores.append(-squared_loss(factors.of(g for g in groups if label[g] == k), factors.f, w, b))
    cv = np.stack(scores)
    best = cv.mean(0).argmax(0)
    w, b = ridge_path(factors.of(groups), factors.f, alphas, intercept)
    t = np.arange(factors.t)
    return RidgeModel(w[best, :, t].T, b[best, t], np.array(alphas)[best], cv, alphas)


@dataclass
class NestedResult:
    """Per outer fold: model and r per target."""

    models: dict[object, RidgeModel]
    r: dict[object, np.ndarray]


def nested_ridge_cv(factors: Factors, alphas: Sequence[float] = ALPHAS, train_groups: Mapping[object, Mapping[object, object]] | None = None) -> NestedResult:
    """Each group held out in turn; the others choose penalties among themselves. ``train_groups`` maps an outer fold to its own inner folds of groups."""
    models, r = {}, {}
    for g in sorted(factors.r, key=str):
        rest = [h for h in sorted(factors.r, key=str) if h != g]
        models[g] = ridge_cv(factors, rest, alphas, folds=(train_groups or {}).get(g))
        r[g] = correlation_of(factors.r[g], factors.f, models[g].coef)
    return NestedResult(models, r)


#: Numbers that the weights of all penalties of a block of targets may take.
BLOCK_NUMBERS = 1 << 22


def nested_ridge_blocks(df: DataFrame, group: str, x: str = "x", y: str = "y", alphas: Sequence[float] = ALPHAS, block: int | None = None) -> DataFrame:
    """``nested_ridge_cv`` for any number of targets: a row for each outer fold and target, with r, alpha (the penalty chosen), intercept and coef.

    A row's targets are cut into blocks in the task that holds the row; a block's factors of all groups meet in one task, which solves it. A
    block has so many targets that its weights of all penalties stay under BLOCK_NUMBERS.
    """
    rows = _usable(df, group, x, y)
    kind = rows.schema["g"].dataType.simpleString()
    f, t = _shape(rows, "x", "y")
    block = block or max(1, min(t, BLOCK_NUMBERS // (len(alphas) * (f + 1))))
    first = F.explode(F.sequence(F.lit(0), F.lit(max(t - 1, 0)), F.lit(block)))
    cut = rows.select("g", first.alias("b"), "x", "y").select("g", "b", "x", F.slice("y", F.col("b") + 1, F.lit(block)).alias("y"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        start = int(pdf["b"].iloc[0])
        held = {g: np.array(r).reshape(f + 2, -1) for g, r in zip(pdf["g"], pdf["r"], strict=True)}
        factors = Factors(held, f, next(iter(held.values())).shape[1] - 1 - f)
        found = nested_ridge_cv(factors, alphas)
        return pd.DataFrame([(g, start + k, float(found.r[g][k]), float(m.best_alphas[k]), float(m.intercept[k]), m.coef[:, k].tolist()) for g, m in found.models.items() for k in range(factors.t)], columns=["outer_fold", "target", "r", "alpha", "intercept", "coef"])

    return factor_rows(cut, ["g", "b"], 1 + f).groupBy("b").applyInPandas(solve, f"outer_fold {kind}, target int, r double, alpha double, intercept double, coef array<double>")


#: Numbers in a table of weights up to which it is sent to every task.
MOST_BROADCAST = 4_000_000


def predict(df: DataFrame, models: Mapping[object, RidgeModel], group: str, x: str = "x", out: str = "y_hat") -> DataFrame:
    """Out-of-fold predictions: each row by the model that did not see its group. The models are folds * targets * features numbers."""
    spark = df.sparkSession
    kind = df.schema[group].dataType.simpleString()
    rows = [(g, m.coef.T.tolist(), m.intercept.tolist()) for g, m in models.items()]
    table = spark.createDataFrame(rows, f"_g {kind}, _w array<array<double>>, _b array<double>")
    dot = F.transform(F.col("_w"), lambda w, t: F.aggregate(F.zip_with(w, F.col(x), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.get("_b", t))
    if sum(m.coef.size for m in models.values()) <= MOST_BROADCAST:
        table = F.broadcast(table)
    return df.join(table, F.col(group) == F.col("_g"), "left").withColumn(out, dot).drop("_g", "_w", "_b")


def result_tables(spark, result: NestedResult) -> dict[str, DataFrame]:
    """Tidy tables: r (outer_fold, target, r), coefs, intercepts, best_alphas, cv_scores (outer_fold, inner_fold, alpha, target, score)."""
    r, coefs, intercepts, best, cv = [], [], [], [], []
    for k, (g, m) in enumerate(result.models.items()):
        fold = str(g)
        r += [(fold, t, float(v)) for t, v in enumerate(result.r[g])]
        coefs += [(fold, t, i, float(m.coef[i, t])) for i in range(m.coef.shape[0]) for t in range(m.coef.shape[1])]
        intercepts += [(fold, t, float(v)) for t, v in enumerate(m.intercept)]
        best += [(fold, t, float(v)) for t, v in enumerate(m.best_alphas)]
        cv += [(fold, i, float(a), t, float(m.cv_scores[i, j, t])) for i in range(len(m.cv_scores)) for j, a in enumerate(m.alphas) for t in range(m.cv_scores.shape[2])]
    return {
        "r": spark.createDataFrame(r, "outer_fold string, target int, r double"),
        "coefs": spark.createDataFrame(coefs, "outer_fold string, target int, feature int, coef double"),
        "intercepts": spark.createDataFrame(intercepts, "outer_fold string, target int, intercept double"),
        "best_alphas": spark.createDataFrame(best, "outer_fold string, target int, alpha double"),
        "cv_scores": spark.createDataFrame(cv, "outer_fold string, inner_fold int, alpha double, target int, score double"),
    }


@dataclass
class Decomposition:
    """u * s * vt of the standardised features of a factor's rows; u in the factor's own coordinates."""

    u: np.ndarray
    s: np.ndarray
    vt: np.ndarray
    mean: np.ndarray
    norm: np.ndarray
    y: np.ndarray
    y_mean: np.ndarray
    rows: float


def _signs(vt: np.ndarray) -> np.ndarray:
    """1 or -1 for each component, by its largest loading; of loadings as large but for rounding, by the first."""
    size = np.abs(vt)
    first = (size >= size.max(1, initial=0, keepdims=True) * (1 - 1e-6)).argmax(1)
    return np.where(vt[np.arange(len(vt)), first] < 0, -1.0, 1.0)


def decompose(r: np.ndarray, f: int, std: bool = True, demean: bool = True, blocks: Sequence[int] | None = None) -> Decomposition:
    """Standardise by population deviation (1 where it is 0), balance blocks of features to equal Frobenius norms that keep the whole one, and take the SVD. Signs: the largest loading is positive, of equal ones the first."""
    mx, my, xc, yc, n = centred(r, f)
    x, y = (xc, yc) if demean else (r[:, 1 : 1 + f], r[:, 1 + f :])
    norm = np.sqrt((xc**2).sum(0) / n) if std else np.ones(f)
    norm = np.where(norm < 1e-12 * np.abs(r).max(initial=1), 1.0, norm)
    x = x / norm
    if blocks is not None:
        blocks = np.asarray(blocks)
        # penalties weigh against the whole norm, so it stays
        share = np.linalg.norm(x) / np.sqrt(len(np.unique(blocks)))
        for b in np.unique(blocks):
            size = np.linalg.norm(x[:, blocks == b]) / max(share, 1e-300)
            if size > 0:
                x[:, blocks == b] /= size
                norm[blocks == b] *= size
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    sign = _signs(vt)
    return Decomposition(u * sign, s, vt * sign[:, None], mx if demean else np.zeros(f), norm, y, my if demean else np.zeros_like(my), n)


def pca(df: DataFrame, x: str = "x", std: bool = True, demean: bool = True, n_components: int | None = None, out: str = "scores") -> tuple[DataFrame, Decomposition]:
    """(rows with their scores, the decomposition): scores are standardised features times loadings. NaN is an error."""
    r = group_factors(df.select(F.lit(0).alias("_g"), F.col(x), F.array(F.lit(0.0)).alias("_y")), "_g", x, "_y")
    d = decompose(r.r[0], r.f, std, demean)
    k = len(d.s) if n_components is None else n_components
    if d.vt[:k].size > MOST_BROADCAST:
        raise ValueError(f"{k} components of {r.f} features are too many to send to every task")
    w = (d.vt[:k] / d.norm).tolist()
    shift = [float(v) for v in (d.vt[:k] / d.norm) @ d.mean]
    one = df.sparkSession.createDataFrame([(w, shift)], "_w array<array<double>>, _s array<double>")
    dot = F.transform(F.col("_w"), lambda v, i: F.aggregate(F.zip_with(v, F.col(x), lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p) - F.get("_s", i))
    return df.join(F.broadcast(one)).withColumn(out, dot).drop("_w", "_s"), d  # one row of a bounded size


def wide_pca(df: DataFrame, n_components: int, x: str = "x", std: bool = True, out: str = "scores", extra: int = 10, power: int = 1, seed: int = 0) -> tuple[DataFrame, Decomposition]:
    """``pca`` of demeaned rows for many features, by a randomised range finder: nothing of features squared is made.

    A pass takes means and deviations; a pass multiplies the standardised rows z by a random thin matrix and keeps the R of the product's QR;
    a pass gathers q'z, which is thin, and whose decomposition is that of z up to what lies outside the range. ``power`` passes before turn
    the thin matrix towards the largest components. Tasks and driver hold (n_components + extra) * features numbers.
    """
    rows = df.where(F.col(x).isNotNull()).select(F.col(x).cast("array<double>").alias("x"))
    f, _ = _shape(rows, "x", "x")
    k = min(f, n_components + extra)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, square = 0, np.zeros(f), np.zeros(f)
        for pdf in batches:
            a = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, f))
            if np.isnan(a).any():
                raise ValueError("NaN among features")
            if len(a):
                m, s = a.mean(0), ((a - a.mean(0)) ** 2).sum(0)
                square += s + (m - mean) ** 2 * (n * len(a) / (n + len(a)))
                mean, n = mean + (m - mean) * (len(a) / (n + len(a))), n + len(a)
        if n:
            yield pd.DataFrame({"n": [n], "a": [mean.tolist()], "b": [square.tolist()]})

    def merged(parts: DataFrame, join: Callable[[pd.DataFrame], pd.DataFrame]) -> list:
        """What tasks send, merged by up to 64 tasks and then by one."""
        tree = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("salt").applyInPandas(join, parts.schema)
        return tree.withColumn("salt", F.lit(0)).groupBy("salt").applyInPandas(join, parts.schema).collect()

    def join_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy(float)
        means, squares = np.stack(pdf["a"].to_numpy()), np.stack(pdf["b"].to_numpy())
        mean = (n[:, None] * means).sum(0) / n.sum()
        return pd.DataFrame({"n": [int(n.sum())], "a": [mean.tolist()], "b": [(squares + n[:, None] * (means - mean) ** 2).sum(0).tolist()]})

    one = merged(rows.mapInPandas(sums, "n long, a array<double>, b array<double>"), join_sums)[0]
    n, mean, norm = one["n"], np.array(one["a"]), np.sqrt(np.array(one["b"]) / one["n"]) if std else np.ones(f)
    norm = np.where(norm < 1e-12 * max(1.0, np.abs(mean).max()), 1.0, norm)

    def thin_r(thin: np.ndarray) -> np.ndarray:
        """R of the QR of z times a thin matrix."""

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = np.zeros((0, thin.shape[1]))
            for pdf in batches:
                if len(pdf):
                    held = np.linalg.qr(np.concatenate([held, (np.stack(pdf["x"].to_numpy()) - mean) / norm @ thin]), mode="r")
            yield pd.DataFrame({"r": [held.ravel().tolist()]})

        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"r": [np.linalg.qr(np.concatenate([np.array(v).reshape(-1, thin.shape[1]) for v in pdf["r"]]), mode="r").ravel().tolist()]})

        return np.array(merged(rows.mapInPandas(work, "r array<double>"), join)[0]["r"]).reshape(-1, thin.shape[1])

    def gathered(thin: np.ndarray) -> np.ndarray:
        """(z thin)'z: thin columns by features."""

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = np.zeros((thin.shape[1], f))
            for pdf in batches:
                if len(pdf):
                    z = (np.stack(pdf["x"].to_numpy()) - mean) / norm
                    held += (z @ thin).T @ z
            yield pd.DataFrame({"r": [held.ravel().tolist()]})

        return np.array(merged(rows.mapInPandas(work, "r array<double>"), lambda pdf: pd.DataFrame({"r": [np.sum(np.stack(pdf["r"].to_numpy()), 0).tolist()]}))[0]["r"]).reshape(-1, f)

    thin = np.linalg.qr(np.random.default_rng(seed).normal(size=(f, k)))[0]
    for _ in range(power):
        thin = np.linalg.qr(gathered(thin).T)[0]
    r = thin_r(thin)
    u, s, _ = np.linalg.svd(r.T @ r)
    whiten = u[:, s > s.max(initial=0) * 1e-24] / np.sqrt(s[s > s.max(initial=0) * 1e-24])
    inside = gathered(thin @ whiten)
    if std and k == f:
        # the range holds all of z, so these columns are as long as z's: sqrt(n). Nearly equal components turn with the rounding of sums.
        size = np.linalg.norm(inside, axis=0)
        inside = np.where(size > 0.5 * np.sqrt(n), inside * np.sqrt(n) / np.where(size > 0, size, 1), inside)
    u, s, vt = np.linalg.svd(inside, full_matrices=False)
    sign = _signs(vt)
    u, s, vt = (u * sign)[:, :n_components], s[:n_components], (vt * sign[:, None])[:n_components]
    d = Decomposition(u, s, vt, mean, norm, np.zeros((len(u), 1)), np.zeros(1), float(n))
    weights, shift = (vt / norm).T, (vt / norm) @ mean
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            there = pdf[x].notna().to_numpy()
            made = np.full(len(pdf), None, object)
            if there.any():
                for k, v in zip(np.flatnonzero(there), np.stack(pdf[x][there].to_numpy()).astype(float) @ weights - shift, strict=True):
                    made[k] = v
            yield pdf.assign(**{out: made})

    return df.mapInPandas(project, schema), d


def ridge_from_svd(d: Decomposition, penalties: Sequence[float]) -> np.ndarray:
    """Weights (penalties x features x targets) for the standardised features."""
    return np.einsum("kf,ak,kt->aft", d.vt, d.s / (d.s**2 + np.asarray(penalties, float)[:, None] + np.where(d.s == 0, 1e-300, 0)), d.u.T @ d.y)


def regression_weights(d: Decomposition, method: str = "ridge", k: float | Sequence[float] = 1.0) -> np.ndarray:
    """(1 + features) x targets in the units of the features, the intercept first; for a sequence of k, one of these for each. Methods: least-squares, pcreg and pls (k components), ridge and lasso (penalty k; the lasso's goes with the mean, not the sum, of squared errors)."""
    if np.ndim(k):
        return np.stack([regression_weights(d, method, one) for one in k])
    solid = d.s > d.s.max(initial=0) * 1e-12
    if method == "least-squares":
        w = d.vt[solid].T @ ((d.u[:, solid].T @ d.y) / d.s[solid][:, None])
    elif method == "pcreg":
        n = min(int(k), int(solid.sum()))
        w = d.vt[:n].T @ ((d.u[:, :n].T @ d.y) / d.s[:n][:, None])
    elif method == "ridge":
        w = ridge_from_svd(d, [k])[0]
    elif method == "pls":
        w = np.stack([_pls((d.u * d.s) @ d.vt, c, int(k)) for c in d.y.T], 1)
    elif method == "lasso":
        w = np.stack([_lasso((d.u * d.s) @ d.vt, c, k * d.rows) for c in d.y.T], 1)
    else:
        raise ValueError(f"unknown method: {method}")
    w = w / d.norm[:, None]
    return np.concatenate([(d.y_mean - d.mean @ w)[None], w])


def _pls(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Weights of n latent components of one target."""
    x0, x, y = x, x.copy(), y.copy()
    weights, loads, gains = [], [], []
    for _ in range(min(n, x.shape[1])):
        w = x.T @ y
        if np.linalg.norm(w) < 1e-12 * max(1.0, np.linalg.norm(x0)):
            break
        w /= np.linalg.norm(w)
        t = x @ w
        tt = t @ t
        p, q = x.T @ t / tt, y @ t / tt
        x -= np.outer(t, p)
        y -= q * t
        weights.append(w)
        loads.append(p)
        gains.append(q)
    if not weights:
        return np.zeros(x.shape[1])
    w, p = np.array(weights).T, np.array(loads).T
    return w @ np.linalg.solve(p.T @ w, np.array(gains))


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 1000) -> np.ndarray:
    """Minimises half the squared error plus penalty * sum |w|, by coordinates."""
    w, square, rest = np.zeros(x.shape[1]), (x**2).sum(0), y.copy()
    for _ in range(rounds):
        most = 0.0
        for j in np.flatnonzero(square):
            rho = x[:, j] @ rest + square[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - penalty, 0) / square[j]
            if new != w[j]:
                rest -= x[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]))
                w[j] = new
        if most < 1e-10:
            break
    return w


class Ridge:
    """Closed-form ridge whose intercept is a penalised column of ones; features may be scaled by their deviation."""

    def __init__(self, alphas: float | Sequence[float] = 1.0, scoring: object = "r2", normalize: bool = False):
        self.alphas, self.scoring, self.normalize = np.atleast_1d(np.asarray(alphas, float)), scoring, normalize

    def get_params(self) -> dict:
        return {"alphas": self.alphas.tolist(), "scoring": self.scoring, "normalize": self.normalize}

    def set_params(self, **values) -> Ridge:
        for k, v in values.items():
            if k not in ("alphas", "scoring", "normalize"):
                raise ValueError(f"unknown parameter: {k}")
            setattr(self, k, np.atleast_1d(np.asarray(v, float)) if k == "alphas" else v)
        return self

    def _scale(self, r: np.ndarray, f: int) -> np.ndarray:
        if not self.normalize:
            return np.ones(f)
        _, _, x, _, n = centred(r, f)
        s = np.sqrt((x**2).sum(0) / n)
        return np.where(s == 0, 1.0, s)

    def path(self, r: np.ndarray, f: int) -> tuple[np.ndarray, np.ndarray]:
        scale = self._scale(r, f)
        a = np.column_stack([r[:, 1 : 1 + f] / scale, r[:, 0]])
        u, s, vt = np.linalg.svd(a, full_matrices=False)
        w = np.einsum("kf,ak,kt->aft", vt, s / (s**2 + self.alphas[:, None]), u.T @ r[:, 1 + f :])
        return w[:, :f] / scale[None, :, None], w[:, f]

    def fit(self, factors: Factors, groups: Iterable[object] | None = None) -> Ridge:
        w, b = self.path(factors.of(factors.r if groups is None else groups), factors.f)
        self.coef, self.intercept = w[0], b[0]
        return self

    def loss(self, r: np.ndarray, f: int, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Per target and alpha, lower is better: mse, 1 - r2 (of each target on its own; ``stats.scores`` pools them), or -r."""
        mse = squared_loss(r, f, w, b)
        if self.scoring == "mse":
            return mse
        if self.scoring == "r2":
            _, _, _, y, n = centred(r, f)
            v = (y**2).sum(0) / n
            return mse / np.where(v == 0, 1, v)
        if self.scoring == "r":
            return -np.stack([np.nan_to_num(correlation_of(r, f, one), nan=-1.0) for one in w])
        return np.stack([np.asarray(self.scoring(r, f, one, c)) for one, c in zip(w, b, strict=True)])

    def inner_cv(self, factors: Factors, groups: Iterable[object] | None = None, folds: Mapping[object, object] | None = None) -> Ridge:
        """The alpha of least mean loss over folds, per target, fitted on all. A fold is a group of the factors, or all groups that ``folds`` maps to it."""
        groups = sorted(factors.r if groups is None else groups, key=str)
        label = {g: folds[g] if folds else g for g in groups}
        losses = []
        for k in sorted(set(label.values()), key=str):
            w, b = self.path(factors.of(g for g in groups if label[g] != k), factors.f)
            losses.append(self.loss(factors.of(g for g in groups if label[g] == k), factors.f, w, b))
        best = np.mean(losses, 0).argmin(0)
        w, b = self.path(factors.of(groups), factors.f)
        t = np.arange(factors.t)
        self.coef, self.intercept, self.best_alphas = w[best, :, t].T, b[best, t], self.alphas[best]
        return self

    def outer_cv(self, factors: Factors, outer: Mapping[object, object] | None = None, inner: Mapping[object, object] | None = None) -> dict[object, np.ndarray]:
        """Loss per target on each fold, of the model that the other folds choose and fit. ``outer`` and ``inner`` map groups to folds; without them each group is one."""
        label = {g: outer[g] if outer else g for g in factors.r}
        out = {}
        for k in sorted(set(label.values()), key=str):
            self.inner_cv(factors, [g for g in factors.r if label[g] != k], inner)
            out[k] = self.loss(factors.of(g for g in factors.r if label[g] == k), factors.f, self.coef[None], self.intercept[None])[0]
        return out

    def transform(self, df: DataFrame, x: str = "x", out: str = "y_hat") -> DataFrame:
        model = RidgeModel(self.coef, self.intercept, np.zeros(0), np.zeros((0, 0, 0)))
        return predict(df.withColumn("_one", F.lit(0)), {0: model}, "_one", x, out).drop("_one")


def stratified_cells(df: DataFrame, label: str, row_id: str, outer: int, inner: int, seed: int | None = None) -> DataFrame:
    """Rows with ``outer`` and ``inner`` (1-based folds, both stratified by label) and ``cell``, their pair as one number.

    Inner folds are dealt within each label and outer fold, so that they are stratified among whichever outer folds remain.
    """
    from .folds import partition_within_labels

    shuffle = {"seed": seed, "shuffle": True} if seed is not None else {}
    rows = partition_within_labels(df, label, row_id, outer, out="outer", **shuffle)
    rows = partition_within_labels(rows, [label, "outer"], row_id, inner, out="inner", **shuffle)
    return rows.withColumn("cell", (F.col("outer") - 1) * inner + F.col("inner") - 1)


def stratified_cv(df: DataFrame, label: str, row_id: str, ridge: Ridge, outer: int = 5, inner: int = 5, seed: int | None = None, x: str = "x", y: str = "y") -> dict[int, np.ndarray]:
    """``Ridge.outer_cv`` over stratified folds: factors by cell, from which every training and test set of both levels is stacked; one pass over the rows for all."""
    factors = group_factors(stratified_cells(df, label, row_id, outer, inner, seed), "cell", x, y)
    return ridge.outer_cv(factors, {c: c // inner + 1 for c in factors.r}, {c: c % inner + 1 for c in factors.r})


def fold_predictions(df: DataFrame, factors: Factors, group: str, method: str = "ridge", k: float = 1.0, std: bool = True, blocks: Sequence[int] | None = None, x: str = "x", out: str = "y_hat") -> DataFrame:
    """Out-of-fold predictions by any method of ``regression_weights``."""
    models = {}
    for g in factors.r:
        w = regression_weights(decompose(factors.without(g), factors.f, std, True, blocks), method, k)
        models[g] = RidgeModel(w[1:], w[0], np.zeros(0), np.zeros((0, 0, 0)))
    return predict(df, models, group, x, out)


def fold_scores(df: DataFrame, group: str, x: str = "x", y: str = "y", alphas: Sequence[float] = ALPHAS) -> dict[object, np.ndarray]:
    """r per fold and target by nested ridge; 0 for targets that hold a NaN or null, are constant, or cannot be predicted."""
    bad = F.transform(F.col(y), lambda v: v.isNull() | F.isnan(v))
    width = df.agg(F.max(F.size(y))).first()[0] or 0
    flags = df.select(F.posexplode(F.arrays_zip(F.col(y).alias("v"), bad.alias("bad"))).alias("t", "z"))
    usable = sorted(r["t"] for r in flags.groupBy("t").agg(F.max("z.bad").alias("bad"), (F.max("z.v") != F.min("z.v")).alias("moves")).where("not bad and moves").collect())
    out: dict[object, np.ndarray] = {}
    if usable:
        kept = df.withColumn(y, F.array(*(F.get(F.col(y), F.lit(t)) for t in usable)))
        for g, r in nested_ridge_cv(group_factors(kept, group, x, y), alphas).r.items():
            out[g] = np.zeros(width)
            out[g][usable] = np.nan_to_num(r, nan=0.0)
        return out
    return {r[group]: np.zeros(width) for r in df.select(group).distinct().where(F.col(group).isNotNull()).collect()}
