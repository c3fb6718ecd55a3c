"""Signal features that need dense numerics: numpy over Arrow batches."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors

EPS = float(np.finfo(np.float32).eps)


def mel_bank(bins: int, points: int, rate: int, low: float = 20.0) -> np.ndarray:
    """Triangles on the mel scale 1127 ln(1 + f / 700), from ``low`` to half the rate, over ``points`` FFT bins."""
    mel = lambda f: 1127 * np.log(1 + np.asarray(f, float) / 700)
    edges = np.linspace(mel(low), mel(rate / 2), bins + 2)
    at = mel(np.arange(points) * rate / (2 * points))
    up = (at - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - at) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def fbank_matrix(wav: np.ndarray, bins: int, rate: int, mean_norm: bool, length_ms: float = 25, shift_ms: float = 10) -> np.ndarray:
    length, shift = int(rate * length_ms / 1000), int(rate * shift_ms / 1000)
    if len(wav) < length:
        return np.empty((0, bins))
    n = 1 + (len(wav) - length) // shift
    x = np.lib.stride_tricks.sliding_window_view(np.asarray(wav, float), length)[::shift][:n]
    x = x - x.mean(axis=1, keepdims=True)
    x = x - 0.97 * np.concatenate([x[:, :1], x[:, :-1]], axis=1)
    x = x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / (length - 1))) ** 0.85
    size = 1 << (length - 1).bit_length()
    power = np.abs(np.fft.rfft(x, size)[:, : size // 2]) ** 2
    out = np.log(np.maximum(power @ mel_bank(bins, size // 2, rate).T, EPS))
    return out - out.mean(axis=0) if mean_norm else out


def fbank(wav: Column, n_mels: int = 80, sr: int = 16000, mean_norm: bool = True) -> Column:
    """Log mel filterbank of an array of samples: array of frames."""

    @F.pandas_udf("array<array<double>>")
    def run(w: pd.Series) -> pd.Series:
        return w.map(lambda x: fbank_matrix(np.asarray(x, float), n_mels, sr, mean_norm).tolist() if x is not None else None)

    return run(wav)


def mfcc(wav: Column, n: int = 13, n_mels: int = 26, sr: int = 16000, fps: float = 25.0) -> Column:
    """Cosine transform (orthonormal) of log mel energies; windows are as much longer as ``fps`` is below 25 a second."""
    k, m = np.arange(n)[:, None], np.arange(n_mels)[None]
    basis = np.cos(np.pi * k * (2 * m + 1) / (2 * n_mels)) * np.where(k == 0, np.sqrt(1 / n_mels), np.sqrt(2 / n_mels))

    @F.pandas_udf("array<array<double>>")
    def run(w: pd.Series) -> pd.Series:
        return w.map(lambda x: (fbank_matrix(np.asarray(x, float), n_mels, sr, False, 25 * 25 / fps, 10 * 25 / fps) @ basis.T).tolist() if x is not None else None)

    return run(wav)


def power_spectrum(frame: Column) -> Column:
    """Squared magnitudes of the FFT, padded to a power of two."""

    @F.pandas_udf("array<double>")
    def run(w: pd.Series) -> pd.Series:
        return w.map(lambda x: (np.abs(np.fft.rfft(np.asarray(x, float), 1 << max(0, len(x) - 1).bit_length())) ** 2).tolist() if x is not None and len(x) else None)

    return run(frame)


def convolve(wav: Column, rir: Column) -> Column:
    """Reverberation: response of unit energy, full convolution cut to the signal's length, over the peak."""

    @F.pandas_udf("array<double>")
    def run(w: pd.Series, r: pd.Series) -> pd.Series:
        def one(a: np.ndarray, b: np.ndarray) -> list[float]:
            a, b = np.asarray(a, float), np.asarray(b, float)
            y = np.convolve(a, b / np.sqrt((b * b).sum()))[: len(a)]
            return (y / (np.abs(y).max() + 1e-6)).tolist()

        return pd.Series([one(a, b) if a is not None and b is not None else None for a, b in zip(w, r, strict=True)])

    return run(wav, rir)


def parse_wav(data: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, channels, samples by channel as int16) of a RIFF file; chunks before the data are walked over."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    at, kind = 12, None
    while at + 8 <= len(data):
        name, size = struct.unpack("<4sI", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind = struct.unpack("<HHIIHH", body[:16])
        if name == b"data":
            if kind is None or kind[0] != 1 or kind[5] != 16:
                raise ValueError("only 16-bit PCM is supported")
            samples = np.frombuffer(body[: len(body) // 2 * 2], "<i2")
            return kind[2], kind[1], samples[: len(samples) // kind[1] * kind[1]].reshape(-1, kind[1]).T
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(8)
def sinc_bank(rate: int, to: int, zeros: int = 6, rolloff: float = 0.99) -> tuple[np.ndarray, int]:
    """A filter for each phase of resampling ``rate`` to ``to`` (in lowest terms), and how far they reach back.

    Each is the ideal low-pass below ``rolloff`` of the lower half rate, at the places of the input samples around an
    output sample, under a Hann window of ``zeros`` zero crossings to each side.
    """
    band = min(rate, to) * rolloff
    back = math.ceil(zeros * rate / band)
    at = (np.arange(-back, back + rate) / rate - np.arange(to)[:, None] / to) * band
    inside = np.clip(at, -zeros, zeros)
    return np.sinc(inside) * np.cos(np.pi * inside / (2 * zeros)) ** 2 * band / rate, back


def resample(x: np.ndarray, rate: int, to: int, block: int = 4096) -> np.ndarray:
    """``x`` at another rate, by a bank of windowed-sinc filters, one for each phase of the rational rate.

    Output samples of one phase are products of one filter with frames ``rate`` / gcd samples apart. Frames go in blocks
    of at most ``block``, which overlap by the filter's reach, so memory is bounded by the block and the result.
    """
    common = math.gcd(rate, to)
    rate, to = rate // common, to // common
    if rate == to or not len(x):
        return np.asarray(x, float)
    bank, back = sinc_bank(rate, to)
    n = -(-len(x) * to // rate)
    frames = -(-n // to)
    width = bank.shape[1]
    out = np.empty(frames * to)
    for first in range(0, frames, block):
        count = min(block, frames - first)
        begin, end = first * rate - back, (first + count - 1) * rate - back + width
        part = np.zeros(end - begin)
        lo, hi = max(0, begin), min(len(x), end)
        if hi > lo:
            part[lo - begin : hi - begin] = x[lo:hi]
        shifted = np.lib.stride_tricks.sliding_window_view(part, width)[::rate][:count]
        out[first * to : (first + count) * to] = (shifted @ bank.T).ravel()
    return out[:n]


def mono(x: np.ndarray) -> np.ndarray:
    """One channel of samples: the mean over the shorter axis, integers over 32768."""
    y = np.asarray(x)
    if y.ndim > 2:
        raise ValueError(f"samples with {y.ndim} axes")
    if np.issubdtype(y.dtype, np.integer):
        y = y / 32768.0
    if y.ndim == 2:
        y = (y.T if y.shape[0] > y.shape[1] else y).mean(axis=0)
    return y.astype(float)


def decode_wav(content: Column, *, channels: str = "mean", divisor: float = 32768.0, rate: int | None = None, cap: float | None = None, strict: bool = False) -> Column:
    """(rate, samples) of WAV bytes: the ``mean`` of channels or the ``first``; resampled to ``rate``, cut to ``cap`` s.

    With ``strict`` another rate is an error instead.
    """

    def one(data: bytes) -> tuple[int, list[float]]:
        own, _, x = parse_wav(data)
        y = (x.mean(axis=0) if channels == "mean" else x[0].astype(float)) / divisor
        if rate and rate != own:
            if strict:
                raise ValueError(f"the sample rate is {own}, not {rate}")
            y, own = resample(y, own, rate), rate
        return own, y[: int(cap * own)].tolist() if cap else y.tolist()

    @F.pandas_udf("rate int, samples array<double>")
    def run(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x) if x is not None else (None, None) for x in c], columns=["rate", "samples"])

    return run(content)


def load_samples(samples: Column, *, own: int | None = None, rate: int | None = None) -> Column:
    """Samples of one or more channels (array of arrays, by channel or by time) as one channel, resampled from ``own`` to ``rate``."""

    @F.pandas_udf("array<double>")
    def run(c: pd.Series) -> pd.Series:
        def one(x: np.ndarray) -> list[float]:
            y = mono(np.stack(x) if len(x) and np.ndim(x[0]) else x)
            return (resample(y, own, rate) if own and rate and own != rate else y).tolist()

        return c.map(lambda x: None if x is None else one(x))

    return run(samples)


def batch_chunks(samples: Column, rate: int, *, cap: float = 90.0, chunk: float = 10.0) -> Column:
    """The first ``cap`` seconds in chunks of ``chunk`` seconds, the last one filled up from the beginning again."""
    kept = F.slice(samples, F.lit(1), F.lit(int(cap * rate)))
    return F.when(F.size(samples) > 0, vectors.circular_chunks(kept, int(chunk * rate)))


def mapped(df, fn: Callable, schema: str):
    """A slot for batched inference: ``fn`` takes and gives pandas frames; ids keep their order in a partition."""
    return df.mapInPandas(lambda it: (fn(x) for x in it), schema)
