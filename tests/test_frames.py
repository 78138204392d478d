"""Frame tables against numpy on whole recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxstrata.functions import banks
from voxstrata.operators import frames as R

SCHEMA = "clip long, at long, samples array<double>, rate double"


def cut(spark, clips, seed=0):
    """Recordings in blocks of any length, in any order."""
    r, rows = np.random.default_rng(seed), []
    for clip, (x, rate) in enumerate(clips):
        at = 0
        while at < len(x):
            n = int(r.integers(1, 700))
            rows.append((clip, at, [float(v) for v in x[at : at + n]], float(rate)))
            at += n
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def brute(x, size, stride, pad):
    out, i = [], 0
    while True:
        part = x[i * stride : i * stride + size]
        if len(part) == size:
            out.append(part)
        elif pad and len(part) and (i == 0 or len(part) > size - stride):
            out.append(np.pad(part, (0, size - len(part))))
        else:
            return out
        i += 1


@pytest.mark.parametrize("size, stride, pad", [(256, 128, None), (256, 128, "end"), (100, 37, "end"), (64, 90, None), (64, 90, "end"), (5000, 100, "end")])
def test_frames_are_those_of_the_whole_recording(spark, size, stride, pad):
    r = np.random.default_rng(1)
    clips = [(r.standard_normal(n), 1000) for n in (2000, 256, 257, 100, 1, 3001)]
    blocks = cut(spark, clips)
    got = {(f["clip"], f["frame"]): f["samples"] for f in R.frame_table(blocks, size, stride, pad=pad).collect()}
    want = {(c, i): x for c, (s, _) in enumerate(clips) for i, x in enumerate(brute(s, size, stride, pad))}
    if stride > size and pad:  # frames that begin beyond the last sample don't exist, those that hold none of it neither
        assert all(np.array_equal(got[k], want[k]) for k in want)
    else:
        assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)
    whole = spark.createDataFrame([(c, 0, [float(v) for v in s], 1.0) for c, (s, _) in enumerate(clips)], SCHEMA)
    again = {(f["clip"], f["frame"]): f["samples"] for f in R.frame_table(whole, size, stride, pad=pad, whole=True).collect()}
    assert again == got


def test_seconds_at_each_rate_and_windows(spark):
    r = np.random.default_rng(2)
    clips = [(r.standard_normal(1000), 1000), (r.standard_normal(1000), 441)]
    for kind, own in (("hann", np.hanning), ("hamming", np.hamming), ("blackman", np.blackman)):
        for f in R.frame_table(cut(spark, clips), 0.1, 0.05, "rate", unit="seconds", wfunc=kind).collect():
            x, rate = clips[f["clip"]]
            n, step = int(0.1 * rate), int(0.05 * rate)
            assert np.allclose(f["samples"], x[f["frame"] * step :][:n] * own(n)) and abs(f["centre"] - (n / 2 + step * f["frame"]) / rate) < 1e-12


def test_gaps_overlaps_nulls_and_clashing_columns(spark):
    ones = [1.0] * 10
    rows = [(1, 0, ones, 1.0), (1, 20, ones, 1.0), (2, 0, ones, 1.0), (2, 0, ones, 1.0), (2, 10, ones, 1.0), (3, 0, None, 1.0), (4, 0, [], 1.0), (None, 0, ones, 1.0), (5, 0, [1.0, None] * 5, 1.0), (6, 0, ones, 1.0), (6, 5, ones, 1.0)]
    blocks = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("x")).withColumn("frame", F.lit("x")).withColumn("got", F.lit(1))
    made = R.frame_table(blocks, 5, 5)
    assert sorted((str(f["clip"]), f["frame"]) for f in made.collect()) == [("1", 0), ("1", 1), ("1", 4), ("1", 5), ("2", 2), ("2", 3), ("5", 0), ("5", 1), ("6", 0), ("6", 2), ("None", 0), ("None", 1)]
    m = {(f["clip"], f["frame"]): f["magnitude"] for f in R.magnitudes(R.spectra(made)).collect()}
    assert len(m[None, 0]) == 3 and m[5, 0] is not None and all(v is None or v != v for v in m[5, 0])
    assert R.frame_table(blocks.limit(0), 5, 5).count() == 0
    assert R.cepstral_family(R.frame_table(blocks.limit(0), 16, 8), banks.mel_bank(100, 16, 2), 2, 0, 1, 16, "x").count() == 0
    with pytest.raises(ValueError):
        R.frame_table(blocks, 5, 5, unit="days")


def test_family_is_numpys(spark):
    r = np.random.default_rng(3)
    clips = [(np.cumsum(r.standard_normal(n)), 8000) for n in (4000, 2100, 800)]
    bank = banks.mel_bank(8000, 512, 20, 50.0, 4000.0)
    made = R.frame_table(cut(spark, clips), 512, 256, wfunc="hann")
    family = R.cepstral_family(made, bank, 20, 1, 12, 512, "mfcc")
    got = {r["clip"]: r for r in R.wide(family, "mfcc", 12, [0, 1, 2]).collect()}
    weights, cosine = np.zeros((20, 257)), np.zeros((12, 20))
    for i, j, w in bank:
        weights[i, j] = w
    for i, j, w in banks.cosine_rows(20, 1, 12, 23):
        cosine[i, j] = w
    assert np.allclose(weights.sum(1), 1) and np.allclose(cosine @ cosine.T, np.diag((1 + 11.5 * np.sin(np.pi * np.arange(1, 13) / 23)) ** 2))
    for c, (x, _) in enumerate(clips):
        s = np.abs(np.fft.rfft(np.array(brute(x, 512, 256, None)) * np.hanning(512), axis=1))
        cc = 20 * np.log10((s / s.sum(1, keepdims=True)) @ weights.T) @ cosine.T
        want = [f(np.diff(cc, n, axis=0), axis=0) for n in range(3) for f in (np.mean, np.std)]
        have = list(got[c])[1:]
        assert got[c].__fields__[1:3] == ["mfcc_0_mean", "mfcc_1_mean"] and got[c].__fields__[-1] == "ddmfcc_11_std"
        rest = [float("nan") if v is None else v for v in have]
        wide = np.concatenate([w if len(cc) > n // 2 else np.full(12, np.nan) for n, w in enumerate(want)])
        assert np.allclose(rest, wide, equal_nan=True)


def test_bark_bank():
    bank = banks.bark_bank(16000, 512)
    top = {}
    for band, place, w in bank:
        top[band] = max(top.get(band, (0, 0)), (w, place))
    middles = 600 * np.sinh(np.linspace(0, 6 * np.arcsinh(8000 / 600), len(top)) / 6)
    assert len(top) == int(np.ceil(6 * np.arcsinh(8000 / 600))) + 1 and all(abs(banks.bark(top[b][1] * 16000 / 512) - banks.bark(middles[b])) < 0.6 for b in top)


def test_tones_land_in_their_bins(spark):
    rate, n = 8000, 2048
    kernel = banks.constant_q(rate, n, 100.0, 3000.0, octaves=5, per_octave=12, base=110.0)
    pitches = sorted({(row[0], row[1]) for row in kernel})
    tones = [pitches[i] for i in (0, 7, 20, len(pitches) - 1)]
    t = np.arange(3 * n) / rate
    clips = [(np.sin(2 * np.pi * f * t + i), rate) for i, (_, f) in enumerate(tones)]
    q = R.constant_q(R.spectra(R.frame_table(cut(spark, clips), n, n)), kernel).withColumn("a", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2))
    best = q.groupBy("clip", "frame").agg(F.max_by("pitch", "a").alias("pitch"), F.max("a").alias("a"), F.count("*").alias("n")).collect()
    assert len(best) == 12 and all(r["pitch"] == tones[r["clip"]][0] and 0.2 < r["a"] < 0.3 and r["n"] == len(pitches) for r in best)
    # against products with the atoms in time, nothing dropped
    dense = banks.constant_q(rate, n, 100.0, 3000.0, octaves=5, per_octave=12, base=110.0, threshold=0.0)
    own = {(r["clip"], r["pitch"]): complex(r["re"], r["im"]) for r in R.constant_q(R.spectra(R.frame_table(cut(spark, clips[:1]), n, n)), dense).where("frame = 0").collect()}
    for p, f in pitches:
        length = int(np.ceil(rate / f / (2 ** (1 / 12) - 1)))
        i = np.arange(length)
        x = clips[0][0][(n - length) // 2 :][:length]
        assert abs(own[0, p] - (x * np.hanning(length) / length * np.exp(-2j * np.pi * f / rate * i)).sum()) < 1e-9
    family = R.constant_q_family(R.frame_table(cut(spark, clips), n, n // 2), kernel, n, count=4).collect()
    assert len(family) == 4 * 4 * 3 and all(np.isfinite(r["mean"]) and r["sd"] >= 0 for r in family)
    with pytest.raises(ValueError):
        banks.constant_q(rate, 64, 100.0)
