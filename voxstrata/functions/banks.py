"""Filter banks and transforms as rows of small constant tables, to be joined to spectra.

Each builder returns plain rows, computed from its parameters; how many there are depends on bins and bands alone.
"""

from __future__ import annotations

import math

import numpy as np


def mel(f):
    return 2595 * np.log10(1 + np.asarray(f, float) / 700)


def from_mel(m):
    return 700 * (10 ** (np.asarray(m, float) / 2595) - 1)


def bark(f):
    return 6 * np.arcsinh(np.asarray(f, float) / 600)


def sparse(bank: np.ndarray) -> list[tuple[int, int, float]]:
    """(band, bin, weight) of the weights that are not 0, each band's with sum 1."""
    bank = bank / bank.sum(1, keepdims=True)
    return [(int(i), int(j), float(bank[i, j])) for i, j in zip(*np.nonzero(bank))]


def mel_bank(rate: float, nfft: int, bands: int, low: float = 0.0, high: float | None = None) -> list[tuple[int, int, float]]:
    """Triangles between points equally spaced in mel. A band that no bin falls into is an error."""
    points = from_mel(np.linspace(mel(low), mel(rate / 2 if high is None else high), bands + 2))
    freqs = np.fft.rfftfreq(nfft, 1 / rate)
    rise = (freqs - points[:-2, None]) / (points[1:-1] - points[:-2])[:, None]
    fall = (points[2:, None] - freqs) / (points[2:] - points[1:-1])[:, None]
    bank = np.clip(np.minimum(rise, fall), 0, None)
    if not (bank.sum(1) > 0).all():
        raise ValueError("a band without a bin: fewer bands or longer frames are needed")
    return sparse(bank)


def bark_bank(rate: float, nfft: int, bands: int | None = None, low: float = 0.0, high: float | None = None, width: float = 1.0) -> list[tuple[int, int, float]]:
    """Critical bands with slopes of 10 and -25 dB a bark about middles equally spaced in bark, a bark apart where no number is given."""
    ends = bark([low, rate / 2 if high is None else high])
    bands = math.ceil(ends[1] - ends[0]) + 1 if bands is None else bands
    off = bark(np.fft.rfftfreq(nfft, 1 / rate)) - np.linspace(*ends, bands)[:, None]
    return sparse(10 ** (np.minimum(0, np.minimum(off + 0.5, -2.5 * (off - 0.5))) / width))


def cosine_rows(bands: int, first: int, last: int, lifter: float = 0) -> list[tuple[int, int, float]]:
    """(coefficient, band, weight) of the orthonormal cosine transform (type 2), coefficients numbered from 0, liftered by their place."""
    out = []
    for place, k in enumerate(range(first, last + 1)):
        gain = math.sqrt((1 if k == 0 else 2) / bands) * (1 + lifter / 2 * math.sin(math.pi * (place + 1) / lifter) if lifter else 1)
        out += [(place, i, gain * math.cos(math.pi * k * (2 * i + 1) / (2 * bands))) for i in range(bands)]
    return out


def constant_q(rate: float, nfft: int, low: float, high: float | None = None, octaves: int = 7, per_octave: int = 24, base: float = 120.0, ratio: float = 1.0, threshold: float = 0.005, step: int | None = None) -> list[tuple[int, float, int, float, float, float, float]]:
    """(pitch, frequency, bin, a, b, c, d) of a sparse constant-Q kernel over the bins of a real spectrum.

    The transform at a pitch is the sum over bins of (a * re + b * im) + i (c * re + d * im). A pitch's window holds
    ``ratio / (2 ** (1 / per_octave) - 1)`` periods; pitches whose window is longer than ``nfft`` are left out. Weights of at
    most ``threshold`` in size are dropped. Octaves start ``step`` bins after each other (``per_octave`` where none is given).
    """
    step, high = per_octave if step is None else step, rate / 2 if high is None else high
    pitches = sorted({base * 2 ** ((m * step + n) / per_octave) for m in range(octaves) for n in range(per_octave)})
    q = ratio / (2 ** (1 / per_octave) - 1)
    out, pitch = [], 0
    for f in pitches:
        length = math.ceil(q * rate / f)
        if not (low <= f <= high and length <= nfft):
            continue
        atom = np.zeros(nfft, complex)
        begin = (nfft - length) // 2
        atom[begin : begin + length] = np.hanning(length) / length * np.exp(2j * np.pi * f / rate * np.arange(length))
        kernel = np.fft.fft(atom)
        kernel[np.abs(kernel) <= threshold] = 0
        kernel = kernel.conj() / nfft
        upper = np.zeros(nfft // 2 + 1, complex)  # bins beyond the half hold the conjugate of their mirror image
        mirrored = kernel[nfft // 2 + 1 :][::-1]
        upper[1 : 1 + len(mirrored)] = mirrored
        lower = kernel[: nfft // 2 + 1]
        plus, minus = lower + upper, lower - upper
        for k in np.flatnonzero((np.abs(lower) > 0) | (np.abs(upper) > 0)):
            out.append((pitch, float(f), int(k), float(plus[k].real), float(-minus[k].imag), float(plus[k].imag), float(minus[k].real)))
        pitch += 1
    if not out:
        raise ValueError("no pitch in that range has a window that fits")
    return out
