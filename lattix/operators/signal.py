"""Audio features in Arrow batches: of waveforms that are one cell each, so that a task holds a batch of them, or of waveforms in rows of samples, of any length."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .timeseries import resample, series_places

FEATURES = "array<array<double>>"


def mono(samples: np.ndarray) -> np.ndarray:
    return samples if samples.ndim == 1 else samples[:, 0] if samples.shape[1] == 1 else samples.mean(1)


def spectrogram(audio: np.ndarray, sr: int = 16000, window_s: float = 0.02, stride_s: float = 0.01, normalise: bool = False) -> np.ndarray:
    """Time by frequency log(1 + magnitude) of a centred, reflected, Hamming-windowed Fourier transform. The end is trimmed by the remainder of the hop and one sample."""
    n, hop = int(sr * window_s), int(sr * stride_s)
    x = mono(np.asarray(audio, float))
    x = x[: len(x) - len(x) % hop - 1]
    if len(x) <= n // 2:
        raise ValueError("the waveform is shorter than half a window")
    x = np.pad(x, n // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(x, n)[::hop]
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)
    out = np.log1p(np.abs(np.fft.rfft(frames * window, axis=1)))
    return (out - out.mean()) / out.std(ddof=1) if normalise else out


#: Frames that a task transforms at once.
FRAME_BLOCK = 1 << 12


def spectrogram_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], sample: str, sr: int = 16000, window_s: float = 0.02, stride_s: float = 0.01, normalise: bool = False, block: int = FRAME_BLOCK) -> DataFrame:
    """``spectrogram`` of waveforms that are rows of one sample each, of any length: keys, frame, spectrum.

    Samples get their place in the waveform and those near its ends a mirrored one; a block of frames meets in a task with the samples that
    they overlap. Waveforms of no frame give no row.
    """
    n, hop = int(sr * window_s), int(sr * stride_s)
    half = n // 2
    placed = series_places(df.select(*keys, *(c for c in order if c not in keys), F.col(sample).cast("double").alias("_x")), keys, order, "_i")
    sizes = placed.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_n", F.col("_n") - F.col("_n") % hop - 1).where(F.col("_n") > half)
    rows = placed.join(sizes, list(keys)).where(F.col("_i") < F.col("_n"))
    i, last = F.col("_i"), F.col("_n") - 1
    places = F.array_compact(F.array(i + half, F.when((i >= 1) & (i <= half), half - i), F.when((i < last) & (i >= last - half), 2 * last - i + half)))
    frames = F.floor((F.col("_n") + 2 * half - n) / hop) + 1
    at = rows.select(*keys, "_x", frames.alias("_frames"), F.explode(places).alias("_at"))
    first, stop = F.greatest(F.ceil((F.col("_at") - n + 1) / hop), F.lit(0).cast("long")), F.least(F.floor(F.col("_at") / hop), F.col("_frames") - 1)
    dealt = at.where(first <= stop).withColumn("_block", F.explode(F.sequence(F.floor(first / block), F.floor(stop / block))))
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        begin = int(pdf["_block"].iloc[0]) * block
        here = np.arange(begin, min(begin + block, int(pdf["_frames"].iloc[0])))
        x = pdf["_x"].to_numpy()[here[0] * hop - int(pdf["_at"].iloc[0]) :]
        made = np.log1p(np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, n)[::hop][: len(here)] * window, axis=1)))
        return pd.DataFrame({**{k: pd.Series([pdf[k].iloc[0]] * len(here), dtype=object) for k in keys}, "frame": here, "spectrum": pd.Series(list(made), dtype=object)})

    kinds = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "frame long, spectrum array<double>"])
    out = dealt.groupBy(*keys, "_block").applyInPandas(work, kinds)
    if not normalise:
        return out
    stats = out.select(*keys, F.explode("spectrum").alias("v")).groupBy(*keys).agg(F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s"))
    return out.join(stats, list(keys)).withColumn("spectrum", F.transform("spectrum", lambda v: (v - F.col("_m")) / F.col("_s"))).drop("_m", "_s")


def hz_to_erb(f: np.ndarray) -> np.ndarray:
    return 9.265 * np.log(1 + np.asarray(f, float) / (24.7 * 9.265))


def erb_to_hz(e: np.ndarray) -> np.ndarray:
    return 24.7 * 9.265 * (np.exp(np.asarray(e, float) / 9.265) - 1)


def hz_to_erb_ferret(f: np.ndarray) -> np.ndarray:
    return (1 / 0.31) * (1 / (1 - 0.533)) * (np.asarray(f, float) / 1000) ** (1 - 0.533)


def erb_to_hz_ferret(e: np.ndarray) -> np.ndarray:
    return (np.asarray(e, float) * 0.31 * (1 - 0.533)) ** (1 / (1 - 0.533)) * 1000


def erb_filters(length: int, sr: float, n: int, low: float, high: float, animal: str = "human") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(filters: frequency by n + 2, cutoffs, frequencies): half-cosines evenly spaced in ERBs (of a human or a ferret), with a low and a high pass that complete them."""
    if animal not in ("human", "ferret"):
        raise ValueError(f"no ERB scale for: {animal}")
    to_erb, to_freq = (hz_to_erb, erb_to_hz) if animal == "human" else (hz_to_erb_ferret, erb_to_hz_ferret)
    f = np.linspace(0, sr / 2, length // 2 + 1)
    cut = to_freq(np.linspace(to_erb(low), to_erb(min(high, sr / 2)), n + 2))
    e, edges = to_erb(f), to_erb(cut)
    bank = np.zeros((len(f), n + 2))
    for k in range(n):
        # from the first frequency above the lower edge up to, but without, the last one below the upper edge
        inside = np.arange(int(np.searchsorted(f, cut[k], "right")), int(np.searchsorted(f, cut[k + 2], "left")) - 1)
        bank[inside, k + 1] = np.cos((e[inside] - (edges[k] + edges[k + 2]) / 2) / (edges[k + 2] - edges[k]) * np.pi)
    lows, highs = slice(0, int(np.searchsorted(f, cut[1], "left")) - 1), slice(int(np.searchsorted(f, cut[n], "right")), None)
    bank[lows, 0] = np.sqrt(1 - bank[lows, 1] ** 2)
    bank[highs, n + 1] = np.sqrt(1 - bank[highs, n] ** 2)
    return bank, cut, f


def format_wav(samples: np.ndarray, sr: int, max_seconds: float, audio_sr: int) -> np.ndarray:
    """Mono, cut to max_seconds, resampled, at a root mean square of 0.01 (silence stays)."""
    x = mono(np.asarray(samples, float))
    x = x[: int(sr * max_seconds)] if len(x) / sr > max_seconds else x
    x = resample(x, audio_sr, sr)
    power = math.sqrt(float(np.mean(x * x))) if len(x) else 0.0
    return x * 0.01 / power if power else x


def subbands(x: np.ndarray, bank: np.ndarray) -> np.ndarray:
    """Samples by filters: the signal through each zero-phase filter."""
    x = np.ravel(x)
    return np.fft.irfft(np.fft.rfft(x)[:, None] * bank, n=len(x), axis=0)


def envelope(bands: np.ndarray, compression: float = 1.0) -> np.ndarray:
    """Magnitude of the analytic signal along time, to a power."""
    n = len(bands)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(bands, axis=0) * gain.reshape(-1, *([1] * (bands.ndim - 1))), axis=0)) ** compression


def fft_resample(x: np.ndarray, n: int) -> np.ndarray:
    """The band-limited series through x at n even times; the bin at the lower rate's half is shared as its two sides need."""
    m = len(x)
    spectrum, keep = np.fft.rfft(x, axis=0), min(n, m)
    out = np.zeros((n // 2 + 1, *x.shape[1:]), complex)
    out[: keep // 2 + 1] = spectrum[: keep // 2 + 1]
    if keep % 2 == 0 and n != m:
        out[keep // 2] *= 2 if n < m else 0.5
    return np.fft.irfft(out, n=n, axis=0) * n / m


def pchip(x: np.ndarray, y: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Monotone cubic interpolation of the columns of y at ``to``; the end pieces go on beyond the ends."""
    h = np.diff(x)
    d = np.diff(y, axis=0) / h[:, None]
    if len(x) == 2:
        return y[0] + d[0] * (to - x[0])[:, None]
    m = np.zeros_like(y, dtype=float)
    w1, w2 = (2 * h[1:] + h[:-1])[:, None], (h[1:] + 2 * h[:-1])[:, None]
    flat = (d[1:] * d[:-1]) <= 0
    safe = np.where(flat, 1.0, d[1:]), np.where(flat, 1.0, d[:-1])
    m[1:-1] = np.where(flat, 0.0, (w1 + w2) / (w1 / safe[1] + w2 / safe[0]))

    def end(h0: float, h1: float, d0: np.ndarray, d1: np.ndarray) -> np.ndarray:
        v = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        v = np.where(np.sign(v) != np.sign(d0), 0.0, v)
        return np.where((np.sign(d0) != np.sign(d1)) & (np.abs(v) > 3 * np.abs(d0)), 3 * d0, v)

    m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    k = np.clip(np.searchsorted(x, to, "right") - 1, 0, len(h) - 1)
    t, hk = ((to - x[k]) / h[k])[:, None], h[k][:, None]
    return y[k] * (1 + 2 * t) * (1 - t) ** 2 + m[k] * hk * t * (1 - t) ** 2 + y[k + 1] * t * t * (3 - 2 * t) + m[k + 1] * hk * t * t * (t - 1)


def resample_time_and_freq(x: np.ndarray, sr: float, new_sr: float, f: np.ndarray, new_f: np.ndarray) -> np.ndarray:
    y = fft_resample(x, int(len(x) * new_sr / sr))
    return pchip(np.log2(f), y.T, np.log2(new_f)).T


def cochleagram(samples: np.ndarray, sr: int, output_sr: int = 100, n: int = 30, low: float = 50, high: float = 8000, compression: float = 0.3, flip: bool = False) -> np.ndarray:
    """Time by frequency (low to high; with ``flip`` high to low): ERB subbands, compressed envelopes, resampled in time to the nearest whole number of frames."""
    x = mono(np.asarray(samples, float))
    bank, _, _ = erb_filters(len(x), sr, n, low, high)
    y = envelope(subbands(x, bank[:, 1:-1]), compression)
    y = fft_resample(y, int(np.round(output_sr / sr * len(y))))
    return y[:, ::-1] if flip else y


def layer_means(activations: DataFrame, activation: str = "activation", out: str = "mean") -> DataFrame:
    """Per layer and frame the mean over units, over the layer's highest: an array beside each layer's activations. Layers without a positive mean stay as they are."""
    means = F.transform(F.col(activation), lambda frame: F.aggregate(frame, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(frame), F.lit(1)))
    top = F.array_max(F.col(out))
    return activations.withColumn(out, means).withColumn(out, F.when(top > 0, F.transform(F.col(out), lambda v: v / F.when(top > 0, top).otherwise(F.lit(1.0)))).otherwise(F.col(out)))


#: Numbers of results that a task holds at once, about.
RESULT_NUMBERS = 1 << 18


def map_waveforms(df: DataFrame, fn: Callable[[np.ndarray, int], np.ndarray], out: str, kind: str = FEATURES, samples: str = "samples", sr: str = "sr") -> DataFrame:
    """``fn(samples, sr)`` for each row, a few rows at a time; null waveforms give null."""

    @F.pandas_udf(kind)
    def work(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return waveform_results(batches, fn)

    return df.withColumn(out, work(F.col(samples), F.col(sr)))


def waveform_results(batches: Iterator[tuple[pd.Series, pd.Series]], fn: Callable[[np.ndarray, int], np.ndarray]) -> Iterator[pd.Series]:
    """Results of batches of waveforms and rates, in parts of RESULT_NUMBERS numbers or one row: a result may be far larger than its waveform."""

    def one(a, r) -> np.ndarray | None:
        if a is None:
            return None
        first = a[0] if len(a) else 0.0
        return fn(np.stack(a) if hasattr(first, "__len__") else np.asarray(a, float), int(r))

    for x, rate in batches:
        made, held = [], 0
        for a, r in zip(x, rate, strict=True):
            result = one(a, r)
            made.append(None if result is None else result.tolist())
            held += 1 if result is None else max(1, result.size)
            if held >= RESULT_NUMBERS:
                yield pd.Series(made)
                made, held = [], 0
        if made:
            yield pd.Series(made)


def layer_activations(df: DataFrame, load: Callable[[], Callable[[np.ndarray, int], Sequence[np.ndarray]]], path: str = "path", samples: str = "samples", sr: str = "sr", hop: int = 320) -> DataFrame:
    """One row per (path, layer): path, layer, time_stamp, activation. ``load`` returns, once per task, a function from a waveform to its layers' activations; network weights are the caller's."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            for p, x, r in zip(pdf[path], pdf[samples], pdf[sr], strict=True):
                layers = model(np.asarray(x, float), int(r))
                yield pd.DataFrame([(p, k, (np.arange(len(a)) * float(hop) - 0.5).tolist(), np.asarray(a, float).tolist()) for k, a in enumerate(layers)], columns=["path", "layer", "time_stamp", "activation"])

    return df.select(path, samples, sr).mapInPandas(work, "path string, layer int, time_stamp array<double>, activation array<array<float>>")
