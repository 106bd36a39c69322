"""Lags, basis expansion, islands and clock alignment of sampled series.

A series is a set of rows with the same ``keys``, ordered by ``order``. Series of up to LONG_SERIES rows are windows or groups by the keys.
A longer one is cut into blocks of so many rows, each with a halo of the rows that its lags or taps reach, so that it is many tasks; runs
and places are put together again at the blocks' edges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T, Window

from ..plans.ranking import with_group_index

#: Rows of a series from which it is cut into blocks, and rows of a block.
LONG_SERIES = 1 << 20
Work = Callable[[DataFrame, Sequence[str], Sequence[str]], DataFrame]


def _series(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def _long_and_short(df: DataFrame, keys: Sequence[str], block: int) -> tuple[DataFrame | None, DataFrame]:
    """(rows of series of over ``block`` rows, or None where there are none; the others)."""
    sizes = df.groupBy(*keys).count().where(F.col("count") > block).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.lit(1).alias("_one"))
    if sizes.isEmpty():
        return None, df
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    few = F.broadcast(sizes)  # each stands for over ``block`` rows
    return df.join(few, on, "left_semi"), df.join(few, on, "left_anti")


def by_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], past: int, future: int, work: Work, block: int | None = None) -> DataFrame:
    """``work`` (which adds columns to rows, given them with keys and order) on each series, where a row's result needs ``past`` rows before it and ``future`` rows after it at most."""
    block = block or LONG_SERIES
    long, short = _long_and_short(df, keys, block)
    if long is None:
        return work(df, keys, order)
    at = F.col("_at")
    first, last = F.greatest(F.floor((at - future) / block), F.lit(0).cast("long")), F.floor((at + past) / block)
    blocks = with_group_index(long, keys, order, "_at").withColumn("_block", F.explode(F.sequence(first, last)))
    made = work(blocks, [*keys, "_block"], ["_at"]).where(F.floor(at / block) == F.col("_block")).drop("_at", "_block")
    return work(short, keys, order).unionByName(made)


def series_places(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "t_idx", block: int | None = None) -> DataFrame:
    """0-based places of rows in their series."""
    long, short = _long_and_short(df, keys, block or LONG_SERIES)
    made = short.withColumn(out, F.row_number().over(_series(keys, order)).cast("long") - 1)
    return made if long is None else made.unionByName(with_group_index(long, keys, order, out))


def lag_steps(lag_num: int) -> list[int]:
    """n >= 0: 0..n-1 into the past; n < 0: 0..|n|-1 into the future, as negative steps."""
    if lag_num == 0:
        raise ValueError("at least one lag is needed")
    return list(range(lag_num)) if lag_num > 0 else [-k for k in range(-lag_num)]


def shifted(value: str, step: int, window: Window, zero: Column | None = None) -> Column:
    """The value ``step`` rows back (or on, for a negative step), zero beyond the series."""
    zero = F.lit(0.0) if zero is None else zero
    return F.coalesce(F.lag(value, step).over(window), zero)


def _reach(steps: Sequence[int]) -> tuple[int, int]:
    return max(0, *steps), max(0, *(-s for s in steps))


def lag_columns(df: DataFrame, value: str, steps: Sequence[int], keys: Sequence[str], order: Sequence[str], block: int | None = None) -> DataFrame:
    """One column ``<value>_lag<step>`` for each step (``lead`` for negative ones). One sort serves all of them."""

    def work(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
        w = _series(keys, order)
        return rows.select("*", *(shifted(value, s, w).alias(f"{value}_lag{s}" if s >= 0 else f"{value}_lead{-s}") for s in steps))

    return by_series(df, keys, order, *_reach(steps), work, block)


def _lagged_arrays(df: DataFrame, features: str, steps: Sequence[int], keys: Sequence[str], order: Sequence[str], out: str, join: Callable[..., Column], block: int | None) -> DataFrame:
    def work(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
        w = _series(keys, order)
        zero = F.transform(F.col(features), lambda _: F.lit(0.0))
        return rows.withColumn(out, join(*(shifted(features, s, w, zero) for s in steps)))

    return by_series(df, keys, order, *_reach(steps), work, block)


def lag_stack(df: DataFrame, features: str, steps: Sequence[int], keys: Sequence[str], order: Sequence[str], out: str = "lags", block: int | None = None) -> DataFrame:
    """features array<double> to array<array<double>>, feature by lag: the lags are a new last axis."""
    taken = _lagged_arrays(df, features, steps, keys, order, out, F.array, block)
    return taken.withColumn(out, F.transform(F.col(features), lambda _, f: F.transform(F.col(out), lambda x: F.get(x, f))))


def structure_lag(df: DataFrame, features: str, lag_num: int, keys: Sequence[str], order: Sequence[str], out: str = "lagged", block: int | None = None) -> DataFrame:
    """All features at lag 0, then all at lag 1, and so on, in one array."""
    return _lagged_arrays(df, features, lag_steps(lag_num), keys, order, out, F.concat, block)


def n_windows(hanning_width: float, dur: float) -> int:
    return int(dur / (hanning_width / 2) - 1)


def hanning_taps(hanning_width: float = 0.2, dur: float = 1, sr: float = 100, scale: float = 1, scale_max: float = 2, normalise: bool = True) -> list[tuple[int, int, float]]:
    """(window k, tap j, weight) of raised cosines half a width apart on the time axis divided by ``scale``; zero taps are left out. Normalised by the sum of all."""
    if scale == 0:
        raise ValueError("scale divides time and must not be 0")
    taps = []
    for k in range(n_windows(hanning_width, dur)):
        for j in range(max(0, math.ceil(scale_max * dur * sr - 1))):
            x = (j / sr) / scale - k * 0.5 * hanning_width
            if 0 < x < hanning_width:
                taps.append((k, j, 0.5 * (1 - math.cos(2 * math.pi * x / hanning_width))))
    total = sum(h for *_, h in taps)
    return [(k, j, h / total) for k, j, h in taps] if normalise else taps


def taps_by_scale(df: DataFrame, scale: str, hanning_width: float = 0.2, dur: float = 1, sr: float = 100, scale_max: float = 2) -> DataFrame:
    """``hanning_taps`` for the scale of each row: its columns, k, j, h. Expressions only, so that many scales are many tasks."""
    width = F.lit(float(hanning_width))
    windows, last = n_windows(hanning_width, dur), max(0, math.ceil(scale_max * dur * sr - 1)) - 1
    at = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(last)), lambda j: F.struct(k.alias("k"), j.alias("j"), ((j / F.lit(float(sr))) / F.col(scale) - k * F.lit(0.5) * width).alias("x"))))
    inside = F.filter(F.flatten(at), lambda p: (p["x"] > 0) & (p["x"] < width))
    taps = F.transform(inside, lambda p: F.struct(p["k"].alias("k"), p["j"].alias("j"), (0.5 * (1 - F.cos(2 * math.pi * p["x"] / width))).alias("h")))
    rows = df.withColumn("_taps", taps).withColumn("_sum", F.aggregate("_taps", F.lit(0.0), lambda s, p: s + p["h"]))
    return rows.select(*df.columns, F.explode("_taps").alias("_t"), "_sum").select(*df.columns, "_t.k", "_t.j", (F.col("_t.h") / F.col("_sum")).alias("h"))


def taps_table(spark: SparkSession, **parameters) -> DataFrame:
    return spark.createDataFrame(hanning_taps(**parameters), "k int, j int, h double")


def hanning_feature(df: DataFrame, features: str, keys: Sequence[str], order: Sequence[str], out: str = "basis", scale: float = 1, block: int | None = None, **parameters) -> DataFrame:
    """features array<double> to array<array<double>>, feature by window: each feature convolved with each window of past samples.

    A task streams through its series (or blocks of a long one) in order and keeps the last samples that a window reaches back to; a batch
    is one product with the taps. All rows have equally many features; a null array is all zeros.
    """
    taps = hanning_taps(scale=scale, **parameters)
    windows = n_windows(parameters.get("hanning_width", 0.2), parameters.get("dur", 1))
    last = max((j for _, j, _ in taps), default=0)
    weights = np.zeros((last + 1, windows))
    for k, j, h in taps:
        weights[last - j, k] = h  # a window of samples has the newest last
    place = df.columns.index(features)

    def stream(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
        flagged = rows.withColumn("_first", F.row_number().over(_series(keys, order)) == 1)
        schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.ArrayType(T.DoubleType())))])
        return flagged.mapInArrow(convolve([*rows.columns, out]), schema)

    def convolve(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        return lambda batches: convolved(batches, names)

    def convolved(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
        past = None
        for batch in batches:
            for at in range(0, len(batch), 4096):
                some = batch.slice(at, 4096)
                column = some.column(place)
                sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
                there = column.is_valid().to_numpy(zero_copy_only=False)
                width = int(sizes[there][0]) if there.any() else 0 if past is None else past.shape[1]
                if (sizes[there] != width).any() or (past is not None and len(past) and past.shape[1] not in (0, width)):
                    raise ValueError("rows differ in their number of features")
                x = np.zeros((len(some), width))
                x[there] = column.drop_null().flatten().cast(pa.float64()).fill_null(0.0).to_numpy().reshape(-1, width)
                first = some.column(len(names) - 1).to_numpy(zero_copy_only=False)
                made = np.empty((len(some), width, windows))
                edges = [0, *(np.flatnonzero(first[1:]) + 1).tolist(), len(some)]
                for a, b in zip(edges, edges[1:]):
                    if first[a] or past is None or past.shape[1] != width:
                        past = np.zeros((last, width))
                    run = np.concatenate([past, x[a:b]])
                    made[a:b] = np.lib.stride_tricks.sliding_window_view(run, last + 1, axis=0) @ weights
                    past = run[len(run) - last :]
                inner = pa.ListArray.from_arrays(pa.array(np.arange(len(some) * width + 1, dtype=np.int32) * windows), pa.array(made.ravel()))
                outer = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * width), inner)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], outer], names=names)

    return by_series(df, keys, order, last, 0, stream, block)


def rho_scales(rho: float) -> tuple[float, float]:
    """Time scales of two conditions whose rates differ by 2^rho: the longer response keeps 1."""
    return (1.0, 2.0**-rho) if rho > 0 else (2.0 ** -abs(rho), 1.0)


def hanning_from_rho(fast: DataFrame, slow: DataFrame, rho: float, features: str, keys: Sequence[str], order: Sequence[str], **parameters) -> DataFrame:
    a, b = rho_scales(rho)
    return hanning_feature(fast, features, keys, order, scale=a, **parameters).unionByName(hanning_feature(slow, features, keys, order, scale=b, **parameters))


#: Samples of a block in which runs are found before they are put together.
RUN_BLOCK = 1 << 16


def islands(df: DataFrame, keys: Sequence[str], label: str, t_idx: str = "t_idx", sr: float = 100, active: Column | None = None, block: int = RUN_BLOCK) -> DataFrame:
    """Runs of consecutive active samples of one label: keys, label, onset, offset (the last sample's time). ``df`` is long: one row per sample and label.

    Runs are found in blocks of samples; those that touch a block's edge, two a block and label at most, are joined to their neighbours.
    """
    rows = df if active is None else df.where(active)
    rows = rows.where(F.col(label).isNotNull()).select(*keys, label, t_idx).distinct().withColumn("_block", F.floor(F.col(t_idx) / block))
    w = Window.partitionBy(*keys, label, "_block").orderBy(t_idx)
    rows = rows.withColumn("_g", F.col(t_idx) - F.row_number().over(w))
    runs = rows.groupBy(*keys, label, "_block", "_g").agg(F.min(t_idx).alias("_a"), F.max(t_idx).alias("_b"))
    edge = (F.col("_a") % block == 0) | ((F.col("_b") + 1) % block == 0)
    runs = runs.withColumn("_inside", F.when(~edge, F.col("_block")))  # runs within a block meet none
    near = Window.partitionBy(*keys, label, "_inside").orderBy("_a")
    new = F.when(F.lag("_b").over(near) == F.col("_a") - 1, 0).otherwise(1)
    runs = runs.withColumn("_new", new).withColumn("_run", F.sum("_new").over(near))
    ends = runs.groupBy(*keys, label, "_inside", "_run").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    return ends.select(*keys, label, (F.col("_a") / F.lit(sr)).alias("onset"), (F.col("_b") / F.lit(sr)).alias("offset"))


def interpolate(samples: DataFrame, t_new: DataFrame, keys: Sequence[str], t: str = "t", x: str = "x", out: str = "x_new", bin_width: float = 1.0, block: int | None = None) -> DataFrame:
    """Linear interpolation at the times of ``t_new`` (columns keys and t): each time finds its segment by a binned range join. Times outside the samples give no row."""
    from .intervals import range_join

    def segments(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
        w = _series(keys, order)
        return rows.select("*", F.lead("_t0").over(w).alias("_t1"), F.lead("_x0").over(w).alias("_x1"), F.lag("_t0").over(w).isNull().alias("_first"))

    seg = by_series(samples.select(*keys, F.col(t).alias("_t0"), F.col(x).alias("_x0")), keys, ["_t0"], 1, 1, segments, block)
    seg = seg.where("_t1 is not null")
    hit = range_join(t_new.select(*keys, F.col(t).alias("_t")), seg, "_t", "_t0", "_t1", bin_width, keys)
    hit = hit.where((F.col("_t") > F.col("_t0")) | F.col("_first"))  # at a knot the segment that ends there
    lerp = F.col("_x0") + (F.col("_t") - F.col("_t0")) * (F.col("_x1") - F.col("_x0")) / (F.col("_t1") - F.col("_t0"))
    return hit.select(*keys, F.col("_t").alias(t), lerp.alias(out))


def resample_filter(up: int, down: int) -> np.ndarray:
    """A Kaiser low-pass for rational resampling, ten zero crossings of the slower rate to each side."""
    most = max(up, down)
    n = np.arange(-10 * most, 10 * most + 1)
    h = np.sinc(n / most) * np.kaiser(len(n), 5.0)
    return up * h / h.sum()


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling along the first axis."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down:
        return np.array(x, float)
    h, half = resample_filter(up, down), 10 * max(up, down)
    n = -(-len(x) * up // down)
    wide = np.zeros((len(x) * up, *x.shape[1:]))
    wide[::up] = x
    flat = wide.reshape(len(wide), -1)
    full = np.stack([np.convolve(c, h) for c in flat.T], 1)[half:]
    return full[: n * down : down][:n].reshape(n, *x.shape[1:])


def resample_part(x: np.ndarray, begin: int, total: int, up: int, down: int, first: int, stop: int) -> np.ndarray:
    """Samples first..stop-1 of ``resample`` of a series of ``total`` samples, from its samples ``begin`` on that they reach. ``up`` and ``down`` have no common factor."""
    if up == down:
        return x[first - begin : stop - begin].astype(float)
    h, half = resample_filter(up, down), 10 * max(up, down)
    n = np.arange(first, stop)
    k = -(-(n * down - half) // up)[:, None] + np.arange(2 * half // up + 1)
    tap = half + n[:, None] * down - k * up
    there = (k >= 0) & (k < total) & (tap >= 0)
    weight = np.where(there, h[np.where(there, tap, 0)], 0.0)
    out = np.zeros((stop - first, *x.shape[1:]))
    for j in range(k.shape[1]):
        out += weight[:, j, None] * x[np.where(there[:, j], k[:, j] - begin, 0)]
    return out


#: Samples that a task aligns at once.
ALIGN_BLOCK = 1 << 16


def align_time(df: DataFrame, keys: Sequence[str], t_new: Sequence[float], t: str = "t", features: str = "features", interpolate: bool = True, resample_first: bool = True, block: int = ALIGN_BLOCK) -> DataFrame:
    """Each series at the times ``t_new``: resampled by a rational ratio to their mean rate, padded with zeros to cover them, interpolated.

    Without ``resample_first`` the samples keep their own times, which may be uneven. Without ``interpolate`` the padded samples and their
    times come back. A series is worked in blocks of resampled samples, each with the samples that the filter reaches at its edges and the
    next resampled one; its length, first and last time come from a pass before.
    """
    fresh = np.round(np.asarray(t_new, float), 8)
    own = ["_n", "_from", "_to"]
    stats = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(t).cast("double").alias("_from"), F.max(t).cast("double").alias("_to"))

    def plan(n: int, start: float, end: float) -> tuple[float, int, int, int]:
        """(rate, up, down, resampled samples) of a series."""
        f_old = (n - 1) / (end - start) if n > 1 else 1.0
        f_new = (len(fresh) - 1) / (fresh[-1] - fresh[0]) if len(fresh) > 1 else f_old
        if not resample_first:
            return f_new, 1, 1, n
        ratio = Fraction(f_new).limit_denominator() / Fraction(f_old).limit_denominator()
        needed = ((fresh[-1] - start) * f_new + 1) * ratio.denominator / ratio.numerator
        if n < math.floor(needed):
            raise ValueError(f"the series has {n} samples; covering the new times needs {needed:g}")
        return f_new, ratio.numerator, ratio.denominator, -(-n * ratio.numerator // ratio.denominator)

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        """The blocks from _b0 to _b1 that a sample at _at reaches."""
        out = pd.DataFrame({"_b0": 0, "_b1": 0}, index=pdf.index)
        for (n, start, end), part in pdf.groupby(own, sort=False):
            _, up, down, made = plan(n, start, end)
            half, at = 10 * max(up, down) if up != down else 0, part["_at"].to_numpy() * up
            out.loc[part.index, "_b0"] = np.maximum(0, ((at - half) // down - 1) // block)
            out.loc[part.index, "_b1"] = np.minimum(made - 1, (at + half) // down) // block
        return out

    def one(place: np.ndarray, times: np.ndarray, x: np.ndarray, start: float, end: float, k: int, n: int, how: tuple[float, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(times, samples) of block k, from its samples in their order."""
        f_new, up, down, made = how
        first, stop = k * block, min((k + 1) * block, made)
        last = min(stop + 1, made)  # the next block's first sample ends the last stretch
        begin = int(place[0])
        y = resample_part(x, begin, n, up, down, first, last)
        at = np.round(np.arange(first, last) / f_new + start, 8) if resample_first else np.round(times[first - begin : last - begin], 8)
        final = round((made - 1) / f_new + start, 8) if resample_first else round(end, 8)
        if first == 0:
            before = max(0, math.ceil(round((at[0] - fresh[0]) * f_new, 8)))
            at, y = np.concatenate([np.linspace(fresh[0], at[0], before), at]), np.concatenate([np.zeros((before, y.shape[1])), y])
        if stop == made:
            after = max(0, math.ceil(round((fresh[-1] - final) * f_new, 8)))
            at = np.concatenate([at, np.linspace(final, fresh[-1] + 1 / f_new, after + 1, endpoint=False)[1:]])
            y = np.concatenate([y, np.zeros((after, y.shape[1]))])
        elif not interpolate:
            at, y = at[: len(at) - (last - stop)], y[: len(y) - (last - stop)]
        if interpolate:
            low = -np.inf if first == 0 else at[0]
            high = np.inf if stop == made else at[-1]
            some = fresh[(fresh >= low) & (fresh < high)]
            y, at = np.stack([np.interp(some, at, c) for c in y.T], 1), some
        return at, y

    def aligned(rows: pa.RecordBatch) -> pa.RecordBatch:
        """Whole blocks, one after another."""
        flags, sizes = rows.column("_first").to_numpy(zero_copy_only=False), np.diff(rows.column("_x").offsets.to_numpy())
        if rows.column("_x").null_count or (sizes != sizes[0]).any():
            raise ValueError("rows differ in their number of features")
        x = rows.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        place, times, n, start, end, k = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("_at", "_t", *own, "_block"))
        edges = [*np.flatnonzero(flags).tolist(), len(rows)]
        plans = {u: plan(*u) for u in {(int(n[a]), float(start[a]), float(end[a])) for a in edges[:-1]}}
        made = [one(place[a:b], times[a:b], x[a:b], float(start[a]), float(end[a]), int(k[a]), int(n[a]), plans[int(n[a]), float(start[a]), float(end[a])]) for a, b in zip(edges, edges[1:])]
        at, y = (np.concatenate(v) for v in zip(*made))
        of = pa.array(np.repeat(edges[:-1], [len(v) for v, _ in made]))
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
        return pa.RecordBatch.from_arrays([*(rows.column(c).take(of) for c in keys), pa.array(at), values], names=[*keys, t, features])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            last = int(np.flatnonzero(held.column("_first").to_numpy(zero_copy_only=False))[-1])  # its block may go on
            if last:
                yield aligned(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield aligned(held)

    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_s{i}"))
    stats = stats.withColumnsRenamed({k: f"_s{i}" for i, k in enumerate(keys)})
    placed = series_places(df.select(*keys, t, features), keys, [t], "_at").join(stats, on).drop(*(f"_s{i}" for i in range(len(keys))))
    reach = F.pandas_udf(lambda at, n, a, b: deal(pd.DataFrame({"_at": at, "_n": n, "_from": a, "_to": b})), "_b0 long, _b1 long")
    dealt = placed.withColumn("_r", reach("_at", *own)).where("_r._b0 <= _r._b1").withColumn("_block", F.explode(F.sequence("_r._b0", "_r._b1"))).drop("_r")
    kinds = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), f"`{t}` double", f"`{features}` array<double>"])
    first = (F.row_number().over(_series([*keys, "_block"], ["_at"])) == 1).alias("_first")
    # a task streams through its blocks: calls for each of many short series would cost more than they do
    return dealt.select(*keys, "_at", "_block", *own, F.col(t).cast("double").alias("_t"), F.col(features).cast("array<double>").alias("_x"), first).mapInArrow(stream, kinds)


def regular_times(f_new: float, t_start: float, t_stop: float) -> np.ndarray:
    """t_start, t_start + 1/f_new, ... t_stop."""
    return np.round(np.arange(int(round((t_stop - t_start) * f_new)) + 1) / f_new + t_start, 8)


def fit_over_rho(fast: DataFrame, slow: DataFrame, rhos: Sequence[float], features: str, target: str, keys: Sequence[str], order: Sequence[str], **parameters) -> DataFrame:
    """(rho, r): for each assumed rho both conditions' basis features are stacked, the target fitted on them by least squares without an intercept, and truth and fit correlated. Rows never leave their tasks but as the factor of their decomposition."""
    from .linear import correlation_of, group_factors, ridge_path

    out = []
    for rho in rhos:
        both = hanning_from_rho(fast, slow, rho, features, keys, order, **parameters)
        rows = both.select(F.lit(0).alias("g"), F.flatten("basis").alias("x"), F.array(F.col(target).cast("double")).alias("y"))
        made = group_factors(rows, "g")
        w, _ = ridge_path(made.r[0], made.f, [0.0], intercept=False)
        out.append((float(rho), float(correlation_of(made.r[0], made.f, w[0])[0])))
    return fast.sparkSession.createDataFrame(out, "rho double, r double")
