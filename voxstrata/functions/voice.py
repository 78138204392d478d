"""More feature families: auditory cepstra, line spectra and formants, cepstral peaks, harmonics, and measures of raw samples.

Each is a function of one clip that ``signal.extract`` applies inside tasks. Filters are built once for each size and rate.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .signal import FLOOR, FRAME, cosine_rows, decibels, family, framed, lifter, magnitudes, mel_bank, predicted, spread, two

#: Quality and least bandwidth of auditory filters (glasberg, greenwood, lyon), and the exponent of their sum.
EARS = {"glasberg": (9.26449, 24.7, 1), "greenwood": (7.23, 22.85, 1), "lyon": (8.0, 125.0, 2)}


@lru_cache(32)
def gammatone_bank(n: int, size: int, rate: int, low: float = 0.0, ear: str = "glasberg") -> np.ndarray:
    """Magnitudes of fourth-order gammatone filters about centres spaced by bandwidth, each with sum 1."""
    quality, least, order = EARS[ear]
    edge = quality * least
    centres = -edge + (low + edge) * ((rate / 2 + edge) / (low + edge)) ** (np.arange(n) / n)
    width = 1.019 * ((centres / quality) ** order + least**order) ** (1 / order)
    bank = (1 + ((np.fft.rfftfreq(size, 1 / rate) - centres[:, None]) / width[:, None]) ** 2) ** -2
    return bank / bank.sum(1, keepdims=True)


@family("gammatone_cepstral", two([f"gfcc_{k}" for k in range(12)]))
def gammatone_cepstral(x: np.ndarray, rate: int) -> list[float]:
    s = magnitudes(x)
    s = s / np.maximum(s.sum(1, keepdims=True), FLOOR)
    return spread(decibels(s @ gammatone_bank(40, FRAME, rate).T) @ cosine_rows(40, 0, 11).T * lifter(np.arange(12)))


def envelope(q: np.ndarray, up: float = 0.999, down: float = 0.5) -> np.ndarray:
    """A low-pass over frames that falls fast and rises slowly: the lower envelope of each band."""
    out = np.empty_like(q)
    level = 0.9 * q[0]
    out[0] = level
    for i in range(1, len(q)):
        weight = np.where(q[i] >= level, up, down)
        level = weight * level + (1 - weight) * q[i]
        out[i] = level
    return out


def masked(q: np.ndarray, decay: float = 0.85, share: float = 0.2) -> np.ndarray:
    """Frames below the decaying peak of those before give way to a share of it."""
    out, peak = q.copy(), q[0]
    for i in range(1, len(q)):
        out[i] = np.where(q[i] >= decay * peak, q[i], share * peak)
        peak = np.maximum(decay * peak, q[i])
    return out


def across(q: np.ndarray, reach: int, frames: bool) -> np.ndarray:
    """Sums over ``reach`` neighbours to each side, along frames or bands; beyond the ends are zeros."""
    run = np.cumsum(np.pad(q, ((reach + 1, reach), (0, 0)) if frames else ((0, 0), (reach + 1, reach))), axis=0 if frames else 1)
    return run[2 * reach + 1 :] - run[: -2 * reach - 1] if frames else run[:, 2 * reach + 1 :] - run[:, : -2 * reach - 1]


@family("power_normalised", two([f"pncc_{k}" for k in range(12)]))
def power_normalised(x: np.ndarray, rate: int) -> list[float]:
    """Power-normalised cepstra (Kim and Stern): noise suppressed over medium times, masking, smoothing over bands, a 15th root."""
    p = magnitudes(np.append(x[:1], x[1:] - 0.97 * x[:-1])) ** 2 @ gammatone_bank(40, FRAME, rate).T + FLOOR
    q = across(p, 2, True) / 5
    low = envelope(q)
    rest = np.maximum(q - low, 0)
    kept = np.where(q >= 2 * low, masked(rest), envelope(rest))
    near = across(np.ones_like(q), 4, False)
    t = p * across(kept / q, 4, False) / near
    mean = np.maximum(t.mean(1), FLOOR)
    level = np.empty(len(t))
    level[0] = mean[0]
    for i in range(1, len(t)):
        level[i] = 0.999 * level[i - 1] + 0.001 * mean[i]
    return spread((np.maximum(t, 0) / level[:, None]) ** (1 / 15) @ cosine_rows(40, 0, 11).T)


def line_spectrum(a: np.ndarray) -> np.ndarray:
    """Angles of the roots of the sum and difference polynomials, rising, one row for each row of coefficients."""
    out = []
    for row in a:
        p, q = np.append(row, 0) + np.append(0, row[::-1]), np.append(row, 0) - np.append(0, row[::-1])
        angles = np.angle(np.concatenate([np.roots(p), np.roots(q)]))
        angles = np.sort(angles[(angles > 1e-6) & (angles < np.pi - 1e-6)])
        out.append(np.pad(angles[: len(row) - 1], (0, max(0, len(row) - 1 - len(angles))), constant_values=np.pi))
    return np.array(out)


def formants(a: np.ndarray, rate: int, n: int = 4, wide: float = 400.0, low: float = 90.0) -> np.ndarray:
    """Frequencies of the lowest narrow resonances of each row; NaN where there are fewer."""
    out = np.full((len(a), n), np.nan)
    for i, row in enumerate(a):
        roots = np.roots(row)
        roots = roots[roots.imag > 0]
        hz, width = np.angle(roots) * rate / (2 * np.pi), -np.log(np.maximum(np.abs(roots), FLOOR)) * rate / np.pi
        good = np.sort(hz[(hz > low) & (width < wide)])[:n]
        out[i, : len(good)] = good
    return out


@family("line_spectrum", two([f"lsf_{k}" for k in range(1, 15)]) + [f"formant_{k}" for k in range(1, 5)])
def lines(x: np.ndarray, rate: int) -> list[float]:
    a, _ = predicted(x)
    f = formants(a, rate)
    known = ~np.isnan(f)
    return [*spread(line_spectrum(a)), *np.where(known, f, 0).sum(0) / np.maximum(known.sum(0), 1)]


@family("cepstral_peak", two(["cpp", "cpp_smooth"]))
def cepstral_peak(x: np.ndarray, rate: int, size: int = 1024, stride: int = 512) -> list[float]:
    """The cepstrum's peak beyond 3.3 ms over the line fitted there, in decibels; also of cepstra smoothed over frames and quefrency."""
    spectrum = decibels(np.abs(np.fft.fft(framed(x, size, stride) * np.hanning(size), axis=1)) ** 2)
    c = decibels(np.abs(np.fft.fft(spectrum, axis=1)) ** 2)[:, : size // 2 + 1]
    first = round(0.0033 * rate)
    if first + 2 > c.shape[1]:
        raise ValueError("a frame holds no quefrency of 3.3 ms")
    smooth = across(across(c, 3, True) / across(np.ones_like(c), 3, True), 1, False) / across(np.ones_like(c), 1, False)
    at = np.arange(first, c.shape[1])
    made = []
    for y in (c[:, first:], smooth[:, first:]):
        slope, cut = np.polyfit(at, y.T, 1)
        peak = y.argmax(1)
        made.append(y.max(1) - (slope * at[peak] + cut))
    return spread(np.column_stack(made))


@family("harmonics", two(["harmonic_share", "hnr", "noise_level"]))
def harmonics(x: np.ndarray, rate: int, low: float = 50, high: float = 2000, size: int = 1024, stride: int = 512) -> list[float]:
    """Share of magnitude at multiples of the fundamental, ratio of periodic to other energy, and level between harmonics."""
    f = framed(x, size, stride)
    f = (f - f.mean(1, keepdims=True)) * np.hanning(size)
    window = np.fft.irfft(np.abs(np.fft.rfft(np.hanning(size), 2 * size)) ** 2)[:size]
    r = np.fft.irfft(np.abs(np.fft.rfft(f, 2 * size, axis=1)) ** 2, axis=1)[:, :size] / np.maximum(window, FLOOR)
    span = np.arange(max(1, int(rate / high)), min(size // 2, int(rate / low)) + 1)
    if len(span) < 2:
        raise ValueError("a frame holds no period")
    lag = span[r[:, span].argmax(1)]
    periodic = np.clip(r[np.arange(len(r)), lag] / np.maximum(r[:, 0], FLOOR), 1e-6, 1 - 1e-6)
    s, bins = np.abs(np.fft.rfft(f, axis=1)), np.arange(size // 2 + 1)
    off = np.abs((bins * lag[:, None] / size + 0.5) % 1 - 0.5) * size / lag[:, None]  # bins to the nearest multiple
    near = (off <= 2) & (bins > 1)
    between = (off > 2) & (bins > 1)
    level = (s**2 * between).sum(1) / np.maximum(between.sum(1), 1)
    whole = (s**2).mean(1)
    return spread(np.column_stack([100 * (s * near).sum(1) / np.maximum(s.sum(1), FLOOR), 10 * np.log10(periodic / (1 - periodic)), decibels(level) - decibels(whole)]))


def peaks(x: np.ndarray, apart: int) -> np.ndarray:
    """Local maxima at least ``apart`` samples from any higher one; a plateau counts at its middle."""
    steps = np.flatnonzero(np.diff(x))
    starts, ends = np.append(0, steps + 1), np.append(steps, len(x) - 1)
    level = x[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    found = (starts[top] + ends[top]) // 2
    keep = np.ones(len(found), bool)
    for i in np.argsort(-x[found], kind="stable"):
        if keep[i]:
            left, right = np.searchsorted(found, [found[i] - apart + 1, found[i] + apart])
            keep[left:right] = False
            keep[i] = True
    return found[keep]


@family("literature", ["q25", "q50", "q75", "peak_frequency", "jitter", "shimmer", "flux", "low_high", "soft_phonation"])
def literature(x: np.ndarray, rate: int) -> list[float]:
    """Energy quartiles and peak of the whole spectrum, cycle measures from peaks 10 ms apart, L1 flux, band ratios."""
    s = magnitudes(x)
    n = len(x)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    power, freqs = np.abs(np.fft.rfft(x * hann)) ** 2, np.fft.rfftfreq(n, 1 / rate)
    run = power.cumsum()
    q = [freqs[(run >= k * run[-1]).argmax()] for k in (0.25, 0.5, 0.75)]
    at = peaks(x, max(1, int(0.01 * rate)))
    period, height = np.diff(at), x[at]
    relative = lambda v: float(np.abs(np.diff(v)).mean() / v.mean()) if len(v) > 1 and v.mean() > 0 else 0.0
    shares = s / np.maximum(s.sum(1, keepdims=True), FLOOR)
    bands = ((s**2) @ mel_bank(22, FRAME, rate, 50, 10000).T).mean(0)
    low = np.fft.rfftfreq(FRAME, 1 / rate) < 4000
    ratio = lambda a, b: float(decibels(a + FLOOR) - decibels(b + FLOOR))
    return [*q, freqs[power.argmax()], relative(period), relative(height), float(np.abs(np.diff(shares, axis=0)).sum() / max(1, len(s) - 1)), ratio((s[:, low] ** 2).sum(), (s[:, ~low] ** 2).sum()), ratio(bands[:11].sum(), bands[11:].sum())]


@family("dynamics", ["svd_entropy", "slope", "curvature"])
def dynamics(x: np.ndarray, rate: int, size: int = 3) -> list[float]:
    """Entropy of the singular values of delayed copies, and the second-degree trend of the frames' level."""
    delayed = framed(x, size, 1)
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(delayed.T @ delayed), 0))
    p = values / max(values.sum(), FLOOR)
    level = decibels((framed(x, 1024, 512) ** 2).mean(1))
    trend = np.polyfit(np.arange(len(level)) * 512 / rate, level, 2) if len(level) > 2 else np.zeros(3)
    return [float(-(p * np.log2(np.where(p > 0, p, 1))).sum()), float(trend[1]), float(trend[0])]


def resampled(x: np.ndarray, up: int, down: int, half: int = 10, beta: float = 5.0) -> np.ndarray:
    """Samples at up/down times the rate, through a Kaiser-windowed sinc; ends continue with zeros."""
    if not len(x):
        return x
    common = np.gcd(up, down)
    up, down = up // common, down // common
    slow = max(up, down)
    reach = half * slow
    h = np.sinc(np.arange(-reach, reach + 1) / slow) * np.kaiser(2 * reach + 1, beta)
    h *= up / h.sum()
    out = np.arange(-(-len(x) * up // down)) * down  # places on the fine grid
    made = np.zeros(len(out))
    for phase in range(up):  # outputs of one phase share their taps
        mine = np.flatnonzero(out % up == phase)
        taps = h[(reach + phase) % up :: up]
        newest = (out[mine] + reach) // up
        index = newest[:, None] - np.arange(len(taps))
        made[mine] = np.where((index >= 0) & (index < len(x)), x[np.clip(index, 0, len(x) - 1)], 0) @ taps
    return made


def recycled(cycles: np.ndarray, old: int, new: int) -> np.ndarray:
    """Cycle bounds at another rate: each cycle starts where the one before it ends."""
    starts = np.rint(cycles[:, 0] * new / old).astype(int)
    last = np.rint((cycles[-1:, 1] + 1) * new / old).astype(int) - 1
    return np.column_stack([starts, np.append(starts[1:] - 1, last)])


def rasta(bands: np.ndarray) -> np.ndarray:
    """The band-pass over frames of log spectra: slope over five frames, then a leak of 0.94."""
    slope = np.array([0.2, 0.1, 0, -0.1, -0.2])
    out = np.zeros_like(bands)
    for i in range(len(bands)):
        part = bands[max(0, i - 4) : i + 1][::-1]
        out[i] = (slope[: len(part), None] * part).sum(0) + (0.94 * out[i - 1] if i else 0)
    return out


def prediction_response(a: np.ndarray, error: np.ndarray, size: int) -> np.ndarray:
    """Power spectra of prediction models."""
    return error[:, None] / np.maximum(np.abs(np.fft.rfft(a, size, axis=1)) ** 2, FLOOR)



def spread_cycles(cycles: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """A step function of n samples from a value for each cycle; outside all cycles it has the last one."""
    out = np.full(n, values[-1] if len(values) else np.nan, float)
    for (first, last), v in zip(cycles, values):
        out[first : last + 1] = v
    return out


def density(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Gaussian kernel density with Silverman's width."""
    iqr = np.subtract(*np.quantile(x, [0.75, 0.25]))
    width = max(0.9 * min(x.std(ddof=1), iqr / 1.34) * len(x) ** -0.2, FLOOR)
    out = np.zeros(len(at))
    for first in range(0, len(x), 4096):
        out += np.exp(-0.5 * ((at[:, None] - x[first : first + 4096]) / width) ** 2).sum(1)
    return out / (len(x) * width * np.sqrt(2 * np.pi))
