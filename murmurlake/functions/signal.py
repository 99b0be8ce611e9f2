"""Functions over sample arrays: mixing and levels as expressions, filters with numpy inside Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def mix(a: Column, b: Column) -> Column:
    """Sum of two signals, the shorter padded with silence, clamped to [-1, 1]."""
    zero = F.lit(0.0)
    return F.zip_with(a, b, lambda x, y: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(x.cast("double"), zero) + F.coalesce(y.cast("double"), zero))))


def rms(a: Column) -> Column:
    """Root of the mean square; 0 for silence without samples."""
    return F.when(F.size(a) > 0, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(a))).otherwise(0.0)


def peak(a: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(a, lambda x: F.abs(x))), F.lit(0.0))


def downmix(frames: Column, channels: int, partial: bool = False) -> Column:
    """Interleaved channels to their mean; a last incomplete frame is dropped, or averaged over what it has."""
    n = F.ceil(F.size(frames) / channels) if partial else F.floor(F.size(frames) / channels)
    part = lambda i: F.slice(frames, i * channels + 1, F.lit(channels))
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(p)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: mean(part(i)))).otherwise(F.array().cast("array<double>"))


def resample_linear(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Straight lines between samples; the length is rounded down."""
    if rate == target or not len(x):
        return np.asarray(x, dtype=float)
    at = np.arange(int(len(x) * target / rate)) * (rate / target)
    return np.interp(at, np.arange(len(x)), x)


def resample_sinc(x: np.ndarray, rate: int, target: int = 16_000, taps: int = 32) -> np.ndarray:
    """Windowed-sinc interpolation with a low-pass at the lower of the two rates."""
    x = np.asarray(x, dtype=float)
    if rate == target or not len(x):
        return x
    cut, at = min(1.0, target / rate), np.arange(int(len(x) * target / rate)) * (rate / target)
    k = np.arange(-taps, taps)
    place = np.floor(at).astype(int)[:, None] + k + 1
    away = at[:, None] - place
    weight = cut * np.sinc(cut * away) * (0.5 + 0.5 * np.cos(np.pi * np.clip(away / taps, -1, 1)))
    padded = np.concatenate((np.zeros(taps), x, np.zeros(taps + 1)))
    return (weight * padded[np.clip(place + taps, 0, len(padded) - 1)]).sum(1)


def delay_of(mic: np.ndarray, ref: np.ndarray, rate: int = 16_000, most: int = 8000) -> int:
    """Samples by which mic lags ref: the best correlation of the reference's loudest two seconds within +-most; first on ties."""
    n = min(2 * rate, len(ref), len(mic))
    if n < 1:
        return 0
    energy = np.concatenate(([0.0], np.cumsum(np.square(ref[: min(len(ref), len(mic))]))))
    start = int(np.argmax(energy[n:] - energy[:-n]))
    part = ref[start : start + n]
    padded = np.concatenate((np.zeros(most), mic, np.zeros(most + n)))
    around = padded[start : start + 2 * most + n]
    size = 1 << int(np.ceil(np.log2(len(around) + n)))
    scores = np.fft.irfft(np.fft.rfft(around, size) * np.conj(np.fft.rfft(part, size)), size)[: 2 * most + 1]
    return int(np.argmax(scores)) - most if np.any(part) else 0


def cancelled(mic: np.ndarray, ref: np.ndarray, taps: int = 512, mu: float = 0.4, keep_under: float = 0.95) -> np.ndarray:
    """mic without the echo of ref, by a normalised LMS filter after aligning the two; mic as it is where that would not lower its
    energy to 95 % over frames in which ref is active."""
    return cancelled_each([mic], [ref], taps, mu, keep_under)[0]


def cancelled_each(mics: list, refs: list, taps: int = 512, mu: float = 0.4, keep_under: float = 0.95) -> list[np.ndarray]:
    """cancelled() of many recordings side by side: each step of the filter is taken for all of them at once."""
    mics, refs = [np.asarray(x, dtype=float) for x in mics], [np.asarray(x, dtype=float) for x in refs]
    out = list(mics)
    use = sorted((i for i, (m, r) in enumerate(zip(mics, refs, strict=True)) if len(m) and np.any(r)), key=lambda i: -len(mics[i]))
    if not use:
        return out
    n = len(mics[use[0]])
    moved, heard, sizes = np.zeros((len(use), n)), np.zeros((len(use), n)), np.array([len(mics[i]) for i in use])
    for row, i in enumerate(use):
        mic, lag = mics[i], delay_of(mics[i], refs[i])
        src = refs[i][max(0, -lag) : max(0, -lag) + len(mic) - max(0, lag)]
        moved[row, max(0, lag) : max(0, lag) + len(src)] = src
        heard[row, : len(mic)] = mic
    lines = np.concatenate((np.zeros((len(use), taps - 1)), moved), axis=1)
    squares = np.cumsum(np.concatenate((np.zeros((len(use), 1)), lines**2), axis=1), axis=1)
    power = np.maximum(squares[:, taps:] - squares[:, :-taps], 0.0) + 1e-6
    w, left, live = np.zeros((len(use), taps)), np.zeros((len(use), n)), len(use)
    for i in range(n):
        while sizes[live - 1] <= i:  # the shortest come last and end first
            live -= 1
        x = lines[:live, i : i + taps]
        e = heard[:live, i] - np.einsum("ij,ij->i", w[:live], x)
        left[:live, i] = e
        w[:live] += (mu * e / power[:live, i])[:, None] * x
    for row, i in enumerate(use):
        m = sizes[row]
        active = np.abs(moved[row, :m]) > 1e-4
        before, after = np.square(mics[i][active]).sum(), np.square(left[row, :m][active]).sum()
        if before > 0 and after < keep_under * before:
            out[i] = left[row, :m].copy()
    return out


def cancel_echo(mic: Column, ref: Column) -> Column:
    """cancelled over two columns of samples, the recordings of an Arrow batch side by side."""

    def run(m: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([x.tolist() for x in cancelled_each(list(m), list(r))])

    return F.pandas_udf(run, "array<double>")(mic, ref)


def tail_bytes(data: bytes) -> int:
    """How many bytes the last, unfinished UTF-8 character still lacks; 0 for whole or broken ones."""
    for back in range(1, min(4, len(data)) + 1):
        b = data[-back]
        if b < 0x80:
            return 0
        if b >= 0xC0:
            need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4 if b < 0xF8 else back
            return max(0, need - back)
    return 0
