"""Recordings, cycle files and feature families on small made-up signals."""

import struct
import wave

import numpy as np
import pytest

from voxstrata.functions import signal as G
from voxstrata.sources import audio as A

RATE = 44100


def put(path, x, channels=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((np.repeat(x, channels) * 32767).round().astype("<i2").tobytes())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("clips")
    sine = 0.5 * np.sin(2 * np.pi * 1000 * np.arange(RATE) / RATE + 0.1)  # no sample is 0, so that each crossing counts once
    put(root / "Sham" / "week_3_Pig One_S_Snip" / "a.wav", sine)
    put(root / "Sham" / "week_3_Pig One_S_Snip" / "b.wav", sine[:2000], 2)
    (root / "Sham" / "week_3_Pig One_S_Snip" / "bad.wav").write_bytes(b"nothing")
    (root / "Sham" / "week_3_Pig One_S_Snip" / "._a.wav").write_bytes(b"x")
    for stamp, n in (("09Jan25(10-00)", 3), ("10Dec24(11-00)", 2)):
        cuts = [(441 * i, 441 * i + 440) for i in range(n)]
        (root / "Sham" / "week_3_Pig One_S_Snip" / f"a@{stamp}.cycles").write_bytes(struct.pack("<II", n, 2) + b"".join(struct.pack("<II", *c) for c in cuts))
    return "file://" + str(root).replace(" ", "%20")


def test_clips(spark, folder):
    got = {r["clip"]: r for r in A.read_clips(spark, folder).collect()}
    assert set(got) == {"a", "b", "bad"}
    assert (got["a"]["treatment"], got["a"]["week"]) == ("S", 3) and got["a"]["duration"] == pytest.approx(1)
    assert got["b"]["channels"] == 2 and len(got["b"]["samples"]) == 2000
    assert got["bad"]["error"] and got["bad"]["samples"] is None
    assert all("sampling rate" in r["error"] for r in A.read_clips(spark, folder, 8000).where("clip != 'bad'").collect())


def test_newest_cycles(spark, folder):
    both = A.annotated(A.read_clips(spark, folder), A.read_cycles(spark, folder))
    got = A.cycle_measures(both).orderBy("cycle").collect()
    assert [r["cycle"] for r in got] == [0, 1, 2]  # January 2025 is newer than December 2024
    assert all(r["period"] == pytest.approx(0.01) and not r["gap"] for r in got)
    assert got[0]["amplitude"] == pytest.approx(1, abs=0.01) and got[0]["energy"] == pytest.approx(RATE / 8, rel=0.01)


def test_families(spark, folder):
    out = G.extract(A.read_clips(spark, folder), list(G.FAMILIES)).collect()
    value = {(r["clip"], r["feature"]): r["value"] for r in out}
    assert value["a", "f0"] == pytest.approx(1000, rel=0.03) and value["a", "centroid_mean"] == pytest.approx(1000, rel=0.05)
    assert value["a", "rms"] == pytest.approx(0.5 / np.sqrt(2), rel=1e-3) and value["a", "zero_crossings"] == pytest.approx(2000 / RATE, rel=0.02)
    assert value["bad", "f0"] is None and all(np.isfinite(v) for (c, _), v in value.items() if c == "a")
    assert value["b", "centroid_mean"] is None and np.isfinite(value["b", "f0"]) and np.isfinite(value["b", "lpc_1_mean"])  # 2,000 samples fill no frame of 4,096


def test_levinson_solves_the_normal_equations():
    x = np.random.default_rng(1).normal(size=4096)
    r = np.array([[x[: len(x) - k] @ x[k:] for k in range(9)]])
    a, _ = G.levinson(r, 8)
    full = r[0][np.abs(np.arange(8)[:, None] - np.arange(8))]
    assert a[0, 1:] == pytest.approx(-np.linalg.solve(full, r[0, 1:]), abs=1e-6)


def test_filters_and_floors():
    t = np.arange(RATE) / RATE
    y = G.prepared(np.sin(2 * np.pi * 1000 * t) + 3, RATE)
    assert abs(y.mean()) < 1e-9 and np.abs(y).max() == pytest.approx(1)
    for _, f in G.FAMILIES.values():
        assert np.isfinite(f(np.zeros(4096), RATE)).all()
    assert G.mel_bank(40, 1024, RATE).sum(1) == pytest.approx(1)
    with pytest.raises(ValueError):
        G.framed(np.zeros(3), 4, 2)


def test_written_recordings_read_back(spark, folder, tmp_path):
    clips = A.read_clips(spark, folder)
    A.encoded_clips(clips).write.parquet(f"{tmp_path}/clips")
    old = {r["path"]: r for r in clips.collect()}
    for r in A.clips_of(spark.read.parquet(f"{tmp_path}/clips")).collect():
        if old[r["path"]]["samples"] is None:
            assert r["error"] == "no content"
        else:
            assert r["samples"] == pytest.approx(old[r["path"]]["samples"], abs=1e-9) and r["sampling_rate"] == RATE and r["clip"] == old[r["path"]]["clip"]
    cycles = A.read_cycles(spark, folder)
    row = A.encoded_cycles(cycles).first()
    assert bytes(row["content"]) == A.cycle_bytes(cycles.first()["cycles"]) and len(row["content"]) == 8 + 8 * 3


def test_wide_features(spark, folder):
    order = [("temporal", "rms"), ("pitch", "f0")]
    got = {r["clip"]: r for r in A.wide(G.extract(A.read_clips(spark, folder), ["temporal", "pitch"]), "clip", order).collect()}
    assert got["a"]["temporal_rms"] == pytest.approx(0.5 / np.sqrt(2), rel=1e-3) and got["bad"]["pitch_f0"] is None
