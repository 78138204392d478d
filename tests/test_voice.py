"""The further families on made-up signals, and entropies by brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxstrata.functions import scalars as S
from voxstrata.functions import signal as G
from voxstrata.functions import voice as V

RATE = 16000
T = np.arange(RATE) / RATE
PULSES = sum(np.sin(2 * np.pi * 200 * k * T) / k for k in range(1, 15))


def value(name, x):
    return dict(zip(G.FAMILIES[name][0], G.FAMILIES[name][1](x, RATE)))


def test_all_finite_on_sound_noise_and_silence():
    for x in (PULSES, np.random.default_rng(1).normal(size=RATE), np.zeros(RATE)):
        for name, (features, f) in G.FAMILIES.items():
            got = f(x, RATE)
            assert len(got) == len(features) and np.isfinite(got).all(), name


def test_short_clips_are_faults(spark):
    df = spark.createDataFrame([(0, [0.1] * 10, RATE), (1, None, RATE), (2, [], RATE)], "clip int, samples array<double>, sampling_rate int")
    assert G.extract(df, [n for n in G.FAMILIES if n != "temporal"]).where("value IS NOT NULL OR error IS NULL").count() == 0


def test_harmonic_signal_against_noise():
    noise = np.random.default_rng(2).normal(size=RATE)
    tone, hiss = value("harmonics", PULSES), value("harmonics", noise)
    assert tone["hnr_mean"] > hiss["hnr_mean"] + 10 and tone["noise_level_mean"] < hiss["noise_level_mean"] - 10
    assert value("cepstral_peak", PULSES + 0.01 * noise)["cpp_mean"] > value("cepstral_peak", noise)["cpp_mean"]
    got = value("literature", np.sin(2 * np.pi * 1000 * T))
    assert got["peak_frequency"] == pytest.approx(1000, abs=1) and got["q50"] == pytest.approx(1000, abs=2) and got["low_high"] > 20


def test_formants_and_line_spectrum_of_known_resonances():
    a = np.poly([0.97 * np.exp(s * 2j * np.pi * f / RATE) for f in (700, 1800) for s in (1, -1)]).real[None]
    assert V.formants(a, RATE, 2)[0] == pytest.approx([700, 1800], abs=1)
    w = V.line_spectrum(a)[0]
    assert len(w) == 4 and (np.diff(w) > 0).all()
    bin700 = V.prediction_response(a, np.ones(1), 1024)[0].argmax() * RATE / 1024
    assert min(abs(bin700 - 700), abs(bin700 - 1800)) < 40


def test_gammatone_rows_sum_to_one_and_peak_in_order():
    for ear in V.EARS:
        bank = V.gammatone_bank(20, 1024, RATE, ear=ear)
        assert bank.sum(1) == pytest.approx(1) and (np.diff(bank.argmax(1)) >= 0).all()


def test_resampling_keeps_a_tone():
    x = np.sin(2 * np.pi * 300 * T)
    for up, down in ((1, 2), (3, 2), (441, 160)):
        y = V.resampled(x, up, down)
        t = np.arange(len(y)) * down / up / RATE
        mid = slice(len(y) // 4, len(y) // 2)
        assert len(y) == -(-len(x) * up // down) and np.abs(y - np.sin(2 * np.pi * 300 * t))[mid].max() < 0.02
    assert V.recycled(np.array([[0, 99], [100, 199]]), 100, 50).tolist() == [[0, 49], [50, 99]]
    assert V.rasta(np.ones((400, 2)))[-1] == pytest.approx(0, abs=1e-6)


def test_peaks_by_height_and_distance():
    assert V.peaks(np.array([0, 1, 0, 3, 3, 0, 2, 0.0]), 1).tolist() == [1, 3, 6]
    assert V.peaks(np.array([0, 1, 0, 3, 3, 0, 2, 0.0]), 4).tolist() == [3]
    assert len(V.peaks(np.zeros(5), 1)) == 0


def brute(x, r, m):
    n = len(x)
    near = lambda i, j, k: max(abs(x[i + q] - x[j + q]) for q in range(k)) <= r
    a, b = (sum(near(i, j, k) for i in range(n - m) for j in range(i + 1, n - m)) for k in (m + 1, m))
    phi = lambda k: np.mean([np.log(np.mean([near(i, j, k) for j in range(n - k + 1)])) for i in range(n - k + 1)])
    return -np.log(a / b) if a else None, phi(m) - phi(m + 1)


def test_entropies(spark):
    rng = np.random.default_rng(3)
    xs = [list(map(float, rng.integers(0, 4, 30))), list(map(float, rng.normal(size=25))), [1.0, 2.0]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x array<double>")
    r = 0.5 * S.deviation(F.col("x"))
    got = {v["i"]: v for v in df.select("i", S.sample_entropy(F.col("x"), r).alias("s"), S.approximate_entropy(F.col("x"), r).alias("a")).collect()}
    for i in (0, 1):
        s, a = brute(xs[i], 0.5 * np.std(xs[i]), 2)
        assert (got[i]["s"] == pytest.approx(s) if s is not None else got[i]["s"] is None) and got[i]["a"] == pytest.approx(a)
    assert got[2]["s"] is None and got[2]["a"] is None


def test_spread_and_density():
    assert V.spread_cycles(np.array([[1, 2], [3, 4]]), np.array([5.0, 7.0]), 6).tolist() == [7, 5, 5, 7, 7, 7]
    at = np.linspace(-8, 8, 400)
    d = V.density(np.random.default_rng(4).normal(size=5000), at)
    assert d.sum() * (at[1] - at[0]) == pytest.approx(1, abs=1e-3) and d.max() == pytest.approx(0.3989, abs=0.03)


def test_contrast_by_hand(spark):
    """Two bands over nine bins: of bins 0 to 2 the last is left out but counted, and so on; 20 log10 of amplitude ratios."""
    bins = S.octave_bins([float(i) for i in range(9)], 2.0, 1)
    assert bins == [(0, 2, 3), (1, 8, 8)]
    got = spark.range(1).select(S.contrast(F.array(*(F.lit(float(x)) for x in (1, 10, 2, 4, 8, 16, 32, 64, 100))), bins, 0.25)).first()[0]
    want = [20 * np.log10(10 / 1), 20 * np.log10(((100 + 64) / 2) / ((2 + 4) / 2))]
    assert got == pytest.approx(want)


def test_highpass_gains_and_length():
    h = G.highpass(RATE)
    assert len(h) % 2 == 1 and len(h) in (int(RATE / 50 * 80 / 22), int(RATE / 50 * 80 / 22) + 1)
    t = np.arange(len(h)) - (len(h) - 1) / 2
    gain = lambda f: (h * np.cos(2 * np.pi * f / RATE * t)).sum()
    assert abs(gain(0)) < 1e-3 and gain(RATE / 2) == pytest.approx(1) and gain(1000) == pytest.approx(1, abs=1e-3) and 0.3 < gain(50) < 0.7


def test_preparation_removes_a_low_tone():
    t = np.arange(2 * RATE) / RATE
    y = G.prepared(np.sin(2 * np.pi * 400 * t) + 5 * np.sin(2 * np.pi * 5 * t), RATE)
    spectrum = np.abs(np.fft.rfft(y))
    assert spectrum[10] < 0.02 * spectrum[800] and np.abs(y).max() == pytest.approx(1)


def test_pitch_leaves_out_the_frame_that_ends_the_clip():
    size = int(0.03 * RATE)
    assert G.pitch(np.sin(np.arange(size)), RATE) == [0.0, 0.0]
    tone = np.sin(2 * np.pi * 200 * np.arange(size + 1) / RATE) + 7
    f0, share = G.pitch(tone, RATE)
    assert f0 == pytest.approx(200, rel=0.02) and share == 1.0


def test_shimmer_of_raw_heights():
    n = int(0.02 * RATE)
    x = np.full(20 * n, -3.0)
    x[n // 2 :: n] = -1.0
    names = G.FAMILIES["literature"][0]
    assert V.literature(x, RATE)[names.index("shimmer")] == 0.0  # heights below zero have no relative change
    y = np.zeros(20 * n)
    y[n // 2 :: n] = np.where(np.arange(20) % 2, 1.0, 3.0)
    assert V.literature(y, RATE)[names.index("shimmer")] == pytest.approx(1.0)
