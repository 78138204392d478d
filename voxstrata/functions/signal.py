"""Feature families of a clip, computed by numpy inside tasks and registered by name.

``extract`` returns one row for each clip, family and feature, so that families can be added, written and resumed one by
one. Defined cases: clips that are null, empty or shorter than a frame give null features, silent ones the floor values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FAMILIES: dict[str, tuple[list[str], Callable[[np.ndarray, int], list[float]]]] = {}
FLOOR = 1e-12
FRAME, STRIDE = 4096, 2048  # of spectra and cepstra


def family(name: str, features: list[str]):
    """Register a function (samples, rate) -> values as a family; callers may add their own."""

    def register(f):
        FAMILIES[name] = (features, f)
        return f

    return register


def framed(x: np.ndarray, size: int, stride: int) -> np.ndarray:
    """Overlapping frames; the tail that doesn't fill one is dropped."""
    if len(x) < size:
        raise ValueError("shorter than a frame")
    return np.lib.stride_tricks.sliding_window_view(x, size)[::stride]


def magnitudes(x: np.ndarray, size: int = FRAME, stride: int = STRIDE) -> np.ndarray:
    return np.abs(np.fft.rfft(framed(x, size, stride) * np.hanning(size), axis=1))


def decibels(power: np.ndarray) -> np.ndarray:
    return 10 * np.log10(np.maximum(power, FLOOR))


def triangles(points: np.ndarray, size: int, rate: int) -> np.ndarray:
    """Triangular filters between successive points in Hz, each with sum 1."""
    freqs = np.fft.rfftfreq(size, 1 / rate)
    low, mid, high = points[:-2, None], points[1:-1, None], points[2:, None]
    bank = np.maximum(0, np.minimum((freqs - low) / (mid - low), (high - freqs) / (high - mid)))
    return bank / np.maximum(bank.sum(1, keepdims=True), FLOOR)


def mel_bank(n: int, size: int, rate: int, low: float = 50, high: float = 16000) -> np.ndarray:
    ends = 2595 * np.log10(1 + np.array([low, min(high, rate / 2)]) / 700)
    return triangles(700 * (10 ** (np.linspace(*ends, n + 2) / 2595) - 1), size, rate)


def bark_bank(n: int, size: int, rate: int, low: float = 50, high: float = 16000) -> np.ndarray:
    ends = 6 * np.arcsinh(np.array([low, min(high, rate / 2)]) / 600)
    return triangles(600 * np.sinh(np.linspace(*ends, n + 2) / 6), size, rate)


def cosine_rows(n: int, first: int, last: int) -> np.ndarray:
    """Rows first..last of the orthonormal cosine transform (type 2)."""
    k, i = np.arange(first, last + 1)[:, None], np.arange(n)
    return np.sqrt(np.where(k == 0, 1, 2) / n) * np.cos(np.pi * k * (2 * i + 1) / (2 * n))


def lifter(n: np.ndarray, length: int = 23) -> np.ndarray:
    return 1 + length / 2 * np.sin(np.pi * n / length)


def levinson(r: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Prediction coefficients (first is 1) and error of each row of autocorrelations."""
    a, error = np.zeros((len(r), order + 1)), r[:, 0] + FLOOR
    a[:, 0] = 1
    for i in range(1, order + 1):
        k = -(a[:, :i] * r[:, i:0:-1]).sum(1) / error
        a[:, 1 : i + 1] += k[:, None] * a[:, i - 1 :: -1][:, :i]
        error = error * (1 - k * k)
    return a, error


def cepstrum_of(a: np.ndarray, error: np.ndarray, n: int) -> np.ndarray:
    """Cepstral coefficients 0..n-1 of prediction coefficients, by the usual recursion."""
    order, c = a.shape[1] - 1, np.zeros((len(a), n))
    c[:, 0] = np.log(np.maximum(error, FLOOR))
    for m in range(1, n):
        c[:, m] = -a[:, m] if m <= order else 0
        for k in range(max(1, m - order), m):
            c[:, m] -= k / m * c[:, k] * a[:, m - k]
    return c


def predicted(x: np.ndarray, order: int = 14, size: int = 1024, stride: int = 512) -> tuple[np.ndarray, np.ndarray]:
    f = framed(x, size, stride) * np.hamming(size)
    power = np.abs(np.fft.rfft(f, 2 * size, axis=1)) ** 2
    return levinson(np.fft.irfft(power, axis=1)[:, : order + 1], order)


def spread(rows: np.ndarray) -> list[float]:
    return [*rows.mean(0), *rows.std(0)]


def two(names: list[str]) -> list[str]:
    return [f"{n}_{s}" for s in ("mean", "std") for n in names]


@family("temporal", ["zero_crossings", "rms", "peak_to_peak", "energy", "duration"])
def temporal(x: np.ndarray, rate: int) -> list[float]:
    if not len(x):
        raise ValueError("empty")
    return [np.count_nonzero(np.diff(np.sign(x))) / len(x), np.sqrt((x * x).mean()), np.ptp(x), (x * x).sum() / (len(x) / rate), len(x) / rate]


@family("spectral", two(["centroid", "bandwidth", "rolloff", "rollon", "flatness", "entropy", "low_high"]))
def spectral(x: np.ndarray, rate: int) -> list[float]:
    s = magnitudes(x)
    freqs = np.fft.rfftfreq(FRAME, 1 / rate)
    whole = np.maximum(s.sum(1), FLOOR)
    centre = s @ freqs / whole
    wide = np.sqrt((s * (freqs - centre[:, None]) ** 2).sum(1) / whole)
    run = s.cumsum(1)
    at = lambda q: freqs[(run >= q * run[:, -1:]).argmax(1)]
    power = np.maximum(s * s, 1e-10)
    p = s * s / np.maximum((s * s).sum(1, keepdims=True), FLOOR)
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1) / np.log2(s.shape[1])
    low = freqs < 4000
    ratio = decibels((s[:, low] ** 2).sum(1)) - decibels((s[:, ~low] ** 2).sum(1))
    return spread(np.column_stack([centre, wide, at(0.85), at(0.15), np.exp(np.log(power).mean(1)) / power.mean(1), entropy, ratio]))


@family("mel_cepstral", two([f"mfcc_{k}" for k in range(1, 13)]))
def mel_cepstral(x: np.ndarray, rate: int) -> list[float]:
    s = magnitudes(x)
    s = s / np.maximum(s.sum(1, keepdims=True), FLOOR)
    bands = decibels(s @ mel_bank(40, FRAME, rate).T)
    return spread(bands @ cosine_rows(40, 1, 12).T * lifter(np.arange(1, 13)))


@family("perceptual", two([f"plp_{k}" for k in range(13)]))
def perceptual(x: np.ndarray, rate: int) -> list[float]:
    """Bark bands of the power, weighted by equal loudness, compressed, and modelled by linear prediction."""
    bands = magnitudes(x) ** 2 @ bark_bank(24, FRAME, rate).T
    w = (2 * np.pi * 600 * np.sinh(np.linspace(*6 * np.arcsinh(np.array([50, min(16000, rate / 2)]) / 600), 26)[1:-1] / 6)) ** 2
    loud = (w + 56.8e6) * w**2 / ((w + 6.3e6) ** 2 * (w + 0.38e9))
    r = np.fft.irfft(np.maximum(bands * loud, FLOOR) ** 0.33, axis=1)[:, :13]
    return spread(cepstrum_of(*levinson(r, 12), 13) * lifter(np.arange(13)))


@family("prediction", two([f"lpc_{k}" for k in range(1, 15)] + [f"lpcc_{k}" for k in range(1, 15)]))
def prediction(x: np.ndarray, rate: int) -> list[float]:
    a, error = predicted(x)
    return spread(np.hstack([a[:, 1:], cepstrum_of(a, error, 15)[:, 1:]]))


@family("pitch", ["f0", "voiced_share"])
def pitch(x: np.ndarray, rate: int, low: float = 50, high: float = 2000) -> list[float]:
    """Mean fundamental of 30 ms frames of the centred clip: the autocorrelation's peak after its first rise, if within the limits.

    A frame that ends with the clip takes no part; without frames there is no voice.
    """
    size = int(0.03 * rate)
    f = framed(x - x.mean(), size, size // 2)[: -(-(len(x) - size) // (size // 2))]
    if not len(f):
        return [0.0, 0.0]
    r = np.fft.irfft(np.abs(np.fft.rfft(f, 2 * size, axis=1)) ** 2, axis=1)[:, :size]
    rises = np.diff(r, axis=1) > 0
    first = np.where(rises.any(1), rises.argmax(1), size)
    masked = np.where(np.arange(size) >= first[:, None], r, -np.inf)
    lag = np.maximum(masked.argmax(1), 1)
    f0 = rate / lag
    good = (first < size) & (f0 >= low) & (f0 <= high)
    return [float(f0[good].mean()) if good.any() else 0.0, float(good.mean())]


# Weights of the four-term Blackman-Harris window.
BLACKMAN_HARRIS = [0.35875, -0.48829, 0.14128, -0.01168]


def highpass(rate: int, cut: float = 50.0, taps: int | None = None) -> np.ndarray:
    """A windowed sinc with unit gain at half the rate; an odd number of taps, by the rate where none is given."""
    taps = int(rate / 50 * 80 / 22) | 1 if taps is None else taps
    t, share = np.arange(taps) - (taps - 1) / 2, 2 * cut / rate
    window = np.cos(2 * np.pi * np.arange(4)[:, None] * np.arange(taps) / (taps - 1)).T @ BLACKMAN_HARRIS
    h = (np.sinc(t) - share * np.sinc(share * t)) * window
    return h / (h * np.cos(np.pi * t)).sum()


def zero_phase(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filtered forward and back, with the ends mirrored about their values."""
    pad = 3 * len(h)
    if len(x) <= pad:
        raise ValueError("shorter than the filter's padding")
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    n = 1 << (len(y) + 2 * len(h)).bit_length()
    out = np.fft.irfft(np.fft.rfft(y, n) * np.abs(np.fft.rfft(h, n)) ** 2, n)
    return out[pad : pad + len(x)]


def prepared(x: np.ndarray, rate: int, cut: float = 50.0, taps: int | None = None, silence: int = 1000) -> np.ndarray:
    """High-passed between ``silence`` zeros on both sides, centred and scaled to a largest value of 1."""
    y = zero_phase(highpass(rate, cut, taps), np.pad(x, silence))[silence : silence + len(x)]
    y = y - y.mean()
    return y / max(np.abs(y).max(), FLOOR)


def extract(clips: DataFrame, families: list[str], key: str = "clip", samples: str = "samples", rate: str = "sampling_rate") -> DataFrame:
    """(key, family, feature, value, error) of every clip, in one pass over the samples."""
    chosen = {name: FAMILIES[name] for name in families}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, x, fs in zip(frame["k"], frame["x"], frame["fs"]):
                for name, (features, f) in chosen.items():
                    try:
                        if x is None or pd.isna(fs):
                            raise ValueError("no samples")
                        values, error = f(np.asarray(x, float), int(fs)), None
                    except ValueError as fault:
                        values, error = [None] * len(features), str(fault)
                    rows += [(k, name, feature, None if v is None else float(v), error) for feature, v in zip(features, values)]
            yield pd.DataFrame(rows, columns=["key", "family", "feature", "value", "error"])

    kind = clips.schema[key].dataType.simpleString()
    return clips.selectExpr(f"`{key}` AS k", f"`{samples}` AS x", f"`{rate}` AS fs").mapInPandas(run, f"key {kind}, family string, feature string, value double, error string").withColumnRenamed("key", key)
