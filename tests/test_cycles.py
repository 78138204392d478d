"""Cycle measures against numpy."""

import numpy as np
from pyspark.sql import functions as F

from voxstrata.operators import cycles


def quotient(x, k):
    half = k // 2
    return 100 * np.mean([abs(1 - k * x[i] / x[i - half : i + half + 1].sum()) for i in range(half, len(x) - half)]) if len(x) >= k else None


def relative(x):
    return 100 * np.abs(np.diff(x)).mean() / np.abs(x).mean()


def test_family(spark):
    r = np.random.default_rng(1)
    clips = {1: 40, None: 12, 3: 4}
    rows, data = [], {}
    for clip, n in clips.items():
        p, a, e = r.uniform(0.9, 1.1, n) / 400, r.uniform(1, 2, n), r.uniform(5, 9, n)
        data[clip] = (p, a, e)
        rows += [(clip, i, float(p[i]), float(a[i]), float(e[i]), "x") for i in range(n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "clip long, cycle long, period double, amplitude double, energy double, kind string").drop("kind")
    got = {x["clip"]: x for x in cycles.family(df.repartition(3)).collect()}
    assert set(got) == set(clips)
    for clip, (p, a, e) in data.items():
        f, n = 1 / p, len(p)
        rap = np.sum([abs(p[i - 1 : i + 2].mean() - p[i]) for i in range(1, n - 1)]) / p.sum()
        want = {
            "f0_mean": f.mean(), "f0_std": f.std(), "f0_max": f.max(), "f0_min": f.min(), "mean_jit": np.abs(np.diff(p)).mean(), "jit_p": relative(p), "jit_ratio": 10 * relative(p), "jit_factor": relative(f),
            "ppf": 100 * np.mean(np.abs(np.diff(p) / p[1:])), "pvi": 1000 * p.var() / p.mean() ** 2, "rap_v1": rap, "rap_v2": rap * n / (n - 2), "avi": np.log10(1000 * a.var() / a.mean() ** 2),
            "mean_shim": 20 * np.mean(np.abs(np.log10(a[:-1] / a[1:]))), "shim_p": relative(a), "apf": 100 * np.mean(np.abs(np.diff(a) / a[1:])), "epf": 100 * np.mean(np.abs(np.diff(e) / e[1:])),
        } | {f"{c}pq{k}": quotient(x, k) for c, x in (("p", p), ("a", a), ("e", e)) for k in (3, 5, 11)}
        for name, value in want.items():
            have = got[clip][name]
            assert (have is None) == (value is None) and (value is None or abs(have - value) < 1e-9 * max(1, abs(value))), (clip, name)


def test_gaps_zeros_and_single_cycles(spark):
    rows = [(1, 0, 1.0), (1, 1, 2.0), (1, 3, 4.0), (1, 4, None), (2, 0, 5.0), (3, 0, 0.0), (3, 1, 0.0), (3, 2, 0.0), (4, 0, float("inf"))]
    got = {r["g"]: r for r in cycles.measures(spark.createDataFrame(rows, "g int, t int, v double"), ["g"], "t", "v").collect()}
    assert set(got) == {1, 2, 3} and got[1]["mean_step"] == 1 and got[1]["quotient_3"] is None and got[1]["n"] == 3
    assert got[2]["mean_step"] is None and got[2]["rap"] is None and got[2]["mean"] == 5 and got[3]["factor"] is None and got[3]["variability_log"] is None
    assert cycles.measures(spark.createDataFrame(rows, "g int, t int, v double").limit(0), ["g"], "t", "v").count() == 0


def test_flatness_in_db(spark):
    s = [9.0, 1.0, 2.0, 4.0]
    x = spark.createDataFrame([(s,), ([1.0, 3.0, 3.0],), ([1.0],), (None,)], "s array<double>")
    got = [r[0] for r in x.select(cycles.flatness_db(F.col("s"))).collect()]
    p = np.square(s[1:])
    assert abs(got[0] - (10 * np.log10(p).mean() - 10 * np.log10(p.mean()))) < 1e-12 and abs(got[1]) < 1e-12 and got[2] is None and got[3] is None
