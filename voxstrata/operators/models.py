"""Random-intercept models by restricted likelihood, fitted from sums that Spark aggregates.

With one random intercept a subject adds to the likelihood only through its counts and sums in each stage, so rows are
aggregated to subjects once; each trial value of the variance ratio then needs one more aggregate over the subjects, and
all trial values of all models share it. What reaches a numpy step is a row of k * k sums for a model and trial value, k
being the number of stages, however many subjects there are.

Defined cases: null values take no part; stages without rows leave the model; models with fewer than two stages, two
subjects or ``least`` rows give no result; a ratio of zero is reported as singular, with residual degrees of freedom.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import f_upper, t_quantile, t_two_sided
from ..sources.shared import checkpointed

#: Trial ratios (random over residual variance), then two finer grids about the best: exponents of 10.
FIRST = (0.0, *(10.0 ** (k / 2) for k in range(-10, 7)))
FINER = (tuple(k / 16 for k in range(-8, 9)), tuple(k / 128 for k in range(-8, 9)), tuple(k / 1024 for k in range(-8, 9)))
STEP = 0.01


def standardised(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values less their mean over their sample deviation in each model."""
    stats = long.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    return long.join(stats, keys).withColumn(value, F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def subject_sums(long: DataFrame, keys: list[str], subject: str, stage: str, levels: list[str], value: str) -> DataFrame:
    """Counts, sums and squares of each subject: all that the models need."""
    x = long.where(F.col(value).isNotNull() & F.col(stage).isin(levels))
    counts = [F.count_if(F.col(stage) == s).cast("double") for s in levels]
    sums = [F.coalesce(F.sum(F.when(F.col(stage) == s, F.col(value))), F.lit(0.0)) for s in levels]
    return x.groupBy(*keys, subject).agg(F.array(*counts).alias("__k"), F.array(*sums).alias("__s"), F.sum(F.col(value) * F.col(value)).alias("__q")).select(*keys, "__k", "__s", "__q")


def _at(subjects: DataFrame, keys: list[str], size: int, ratios: Column) -> DataFrame:
    """The sums of each model at each trial ratio."""
    whole = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    x = subjects.withColumn("__t", whole(F.col("__k"))).withColumn("__u", whole(F.col("__s"))).withColumn("theta", F.explode(ratios))
    w = F.col("theta") / (1 + F.col("theta") * F.col("__t"))
    k, s = [F.col("__k")[i] for i in range(size)], [F.col("__s")[i] for i in range(size)]
    a = [F.sum((k[i] if i == j else F.lit(0.0)) - w * k[i] * k[j]) for i in range(size) for j in range(size)]
    return x.groupBy(*keys, "theta").agg(
        F.array(*a).alias("a"),
        F.array(*(F.sum(s[i] - w * k[i] * F.col("__u")) for i in range(size))).alias("b"),
        F.sum(F.col("__q") - w * F.col("__u") * F.col("__u")).alias("c"),
        F.sum(F.log1p(F.col("theta") * F.col("__t"))).alias("ld"),
        F.sum("__t").alias("n"),
        F.count("*").cast("double").alias("m"),
        F.array(*(F.sum(k[i]) for i in range(size))).alias("nk"),
    )


def solved(row) -> dict:
    """Fixed effects, residual variance and deviance from a row of sums."""
    nk = np.asarray(row["nk"], float)
    has = np.flatnonzero(nk > 0)
    a = np.asarray(row["a"], float).reshape(len(nk), -1)[np.ix_(has, has)]
    b, p, n = np.asarray(row["b"], float)[has], len(has), row["n"]
    inverse = np.linalg.inv(a)
    beta = inverse @ b
    rest = n - p
    sigma2 = max(row["c"] - b @ beta, 1e-300) / rest if rest > 0 else math.nan
    deviance = rest * math.log(sigma2) + row["ld"] + np.linalg.slogdet(a)[1] + rest if rest > 0 else math.inf
    return {"has": has, "inverse": inverse, "beta": beta, "rest": rest, "sigma2": sigma2, "deviance": deviance, "share": nk[has] / n}


def _best(sums: DataFrame, keys: list[str], shape=dict) -> DataFrame:
    """The trial ratio of least deviance; ``shape`` makes another design of a row of sums."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*keys).schema), "theta double, deviance double"])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[[*keys, "theta"]].copy()
            out["deviance"] = [solved(shape(r))["deviance"] for r in f.to_dict("records")]
            yield out

    return sums.mapInPandas(score, schema).groupBy(*keys).agg(F.min_by("theta", F.struct("deviance", "theta")).alias("best"))


def _hessian(rows: list) -> tuple[np.ndarray, float] | None:
    """Half-steps of the deviance in (log residual variance, log ratio) and the step; None at a ratio of zero or on a flat top."""
    if len(rows) < 3:
        return None
    sigma2 = solved(rows[1])["sigma2"]
    h = math.log1p(STEP)
    part = lambda f: (f["deviance"] - f["rest"] * math.log(f["sigma2"]) - f["rest"], f["rest"] * f["sigma2"])
    (f0, r0), (f1, r1), (f2, r2) = (part(solved(r)) for r in rows)  # the deviance is f + r / v, with r the weighted residual squares
    curve = (f0 - 2 * f1 + f2) / h**2 + (r0 - 2 * r1 + r2) / h**2 / sigma2
    cross = -(r2 - r0) / (2 * h) / sigma2
    hessian = np.array([[r1 / sigma2, cross], [cross, curve]])
    return (hessian, h) if np.all(np.linalg.eigvalsh(hessian) > 1e-9) else None


def _degrees(rows: list, c: np.ndarray) -> float:
    """Satterthwaite's degrees of freedom of a contrast; residual ones where the ratio is zero."""
    fit, found = solved(rows[len(rows) // 2]), _hessian(rows)
    if found is None:
        return float(fit["rest"])
    spread = lambda f: float(c @ f["inverse"] @ c)
    hessian, h = found
    variance = fit["sigma2"] * spread(fit)
    slope = np.array([variance, fit["sigma2"] * (spread(solved(rows[2])) - spread(solved(rows[0]))) / (2 * h)])
    return 2 * variance**2 / float(slope @ (2 * np.linalg.inv(hessian)) @ slope)


def _contrasts(rows: list, levels: list[str]) -> list[tuple]:
    """All pairs of stages."""
    rows = sorted(rows, key=lambda r: r["theta"])
    mid = rows[len(rows) // 2]
    theta, fit = mid["theta"], solved(mid)
    sigma2 = fit["sigma2"]
    fixed = float(fit["share"] @ (fit["beta"] - fit["share"] @ fit["beta"]) ** 2)
    total = fixed + sigma2 * (1 + theta)
    singular = _hessian(rows) is None
    out = []
    for i in range(len(fit["has"])):
        for j in range(i + 1, len(fit["has"])):
            c = np.zeros(len(fit["has"]))
            c[i], c[j] = -1, 1
            df = _degrees(rows, c)
            estimate, se = float(fit["beta"][j] - fit["beta"][i]), math.sqrt(sigma2 * float(c @ fit["inverse"] @ c))
            t = estimate / se
            out.append((levels[fit["has"][j]], levels[fit["has"][i]], estimate, se, float(df), t, t_two_sided(t, df), sigma2, theta * sigma2, fixed / total, (fixed + theta * sigma2) / total, singular, int(mid["n"]), int(mid["m"])))
    return out


def _searched(long: DataFrame, keys: list[str], subject: str, stage: str, levels: list[str], value: str, least: int, shape=dict) -> DataFrame:
    """For each model a row whose ``rows`` are its sums at the best ratio and a step to either side."""
    sums, k = checkpointed(subject_sums(long, keys, subject, stage, levels, value)), len(levels)
    best = _best(_fit_for(_at(sums, keys, k, F.array(*map(F.lit, FIRST))), least), keys, shape)
    for offsets in FINER:
        about = F.array(*(F.col("best") * 10**o for o in offsets))
        best = _best(_at(sums.join(best, keys), keys, k, F.array_distinct(about)), keys, shape)
    three = F.array_distinct(F.array(F.col("best") / (1 + STEP), F.col("best"), F.col("best") * (1 + STEP)))
    last = _at(sums.join(best, keys), keys, k, three)
    return last.groupBy(*keys).agg(F.collect_list(F.struct("theta", "a", "b", "c", "ld", "n", "m", "nk")).alias("rows"))  # three a model


def _finished(grouped: DataFrame, keys: list[str], names: str, make) -> DataFrame:
    fields = [x.split()[0] for x in names.split(", ")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grouped.select(*keys).schema) + ", " + names

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [(*(r[c] for c in keys), *x) for r in f.to_dict("records") for x in make(list(r["rows"]))]
            yield pd.DataFrame(made, columns=[*keys, *fields])

    return grouped.mapInPandas(finish, schema)


def random_intercept(long: DataFrame, keys: list[str], subject: str, stage: str, levels: list[str], value: str = "value", least: int = 5) -> DataFrame:
    """One row for each model and pair of stages: estimate, error, df, t, p, variances, both R squared, singular, sizes."""
    names = "later string, earlier string, estimate double, se double, df double, t double, p double, residual_variance double, subject_variance double, r2_marginal double, r2_conditional double, singular boolean, n long, n_subjects long"
    return _finished(_searched(long, keys, subject, stage, levels, value, least), keys, names, lambda rows: _contrasts(rows, levels))


#: Columns of ``interaction``: ``part`` is term, mean, stage_contrast, treatment_contrast or fit.
INTERACTION = "part string, name string, stage string, treatment string, estimate double, se double, df1 double, df double, statistic double, p double, low double, high double, singular boolean, n long, n_subjects long"


def _joint(fit: dict, rows: list, l: np.ndarray) -> tuple[float, float, float]:
    """F, its numerator and Satterthwaite denominator degrees of freedom for the hypotheses l @ beta = 0."""
    v = fit["sigma2"] * l @ fit["inverse"] @ l.T
    values, vectors = np.linalg.eigh(v)
    keep = values > max(values[-1], 0) * 1e-10
    values, turned = values[keep], (vectors[:, keep].T @ l)
    q = len(values)
    stat = float((((turned @ fit["beta"]) ** 2) / values).sum() / q)
    nu = np.array([_degrees(rows, c) for c in turned])
    if q == 1:
        return stat, 1.0, float(nu[0])
    e = float((nu[nu > 2] / (nu[nu > 2] - 2)).sum())
    return stat, float(q), 2 * e / (e - q) if e > q else math.nan


def _interaction(rows: list, stages: list[str], treatments: list[str]) -> list[tuple]:
    """Type III tests, estimated means, contrasts and figures of the fit, from a model of cell means.

    Without rows in some cell the terms can't be told apart: the model becomes the additive one, fitted on the same sums,
    and has no interaction term.
    """
    rows = sorted(rows, key=lambda r: r["theta"])
    found = _design(rows[0], stages, treatments)
    if found is None:
        return []
    here_s, here_t, full, mean_of = found
    rows = [_shaped(r, stages, treatments) for r in rows]
    wanted = list(mean_of)
    fit = solved(rows[len(rows) // 2])
    theta, n, m = rows[len(rows) // 2]["theta"], int(rows[0]["n"]), int(rows[0]["m"])
    if not fit["rest"] > 0:
        return []
    singular = _hessian(rows) is None
    out = []

    def line(part: str, name: str, s: str | None, t: str | None, c: np.ndarray) -> None:
        estimate, se = float(c @ fit["beta"]), math.sqrt(fit["sigma2"] * float(c @ fit["inverse"] @ c))
        df = _degrees(rows, c)
        half = t_quantile(0.975, df) * se
        out.append((part, name, s, t, estimate, se, 1.0, df, estimate / se, t_two_sided(estimate / se, df), estimate - half, estimate + half, singular, n, m))

    over_t = {s: np.mean([mean_of[s, t] for t in here_t], axis=0) for s in here_s}
    over_s = {t: np.mean([mean_of[s, t] for s in here_s], axis=0) for t in here_t}
    terms = {"stage": [over_t[s] - over_t[here_s[0]] for s in here_s[1:]], "treatment": [over_s[t] - over_s[here_t[0]] for t in here_t[1:]]}
    if full:
        first = lambda s, t: mean_of[s, t] - mean_of[here_s[0], t] - mean_of[s, here_t[0]] + mean_of[here_s[0], here_t[0]]
        terms["stage:treatment"] = [first(s, t) for s in here_s[1:] for t in here_t[1:]]
    for name, hypotheses in terms.items():
        f, df1, df = _joint(fit, rows, np.array(hypotheses))
        out.append(("term", name, None, None, None, None, df1, df, f, f_upper(f, df1, df), None, None, singular, n, m))
    for s, t in wanted:
        line("mean", "mean", s, t, mean_of[s, t])
    for s in here_s:
        for i, t in enumerate(here_t):
            for u in here_t[i + 1 :]:
                line("treatment_contrast", f"{t} - {u}", s, None, mean_of[s, t] - mean_of[s, u])
    for t in here_t:
        for i, s in enumerate(here_s):
            for u in here_s[i + 1 :]:
                line("stage_contrast", f"{s} - {u}", None, t, mean_of[s, t] - mean_of[u, t])
    deviance = fit["deviance"] + fit["rest"] * math.log(2 * math.pi)
    k = len(fit["beta"]) + 2
    figures = {"log_likelihood": -deviance / 2, "aic": deviance + 2 * k, "bic": deviance + k * math.log(n), "residual_sd": math.sqrt(fit["sigma2"]), "subject_variance": theta * fit["sigma2"], "interaction": float(full)}
    out += [("fit", name, None, None, v, *[None] * 7, singular, n, m) for name, v in figures.items()]
    return out


def _design(row: dict, stages: list[str], treatments: list[str]) -> tuple | None:
    """Stages and treatments with rows, whether all their cells have some, and each cell's mean as a combination of effects."""
    cells = [(s, t) for s in stages for t in treatments]
    has = {c for c, n in zip(cells, row["nk"]) if n > 0}
    here_s, here_t = [s for s in stages if any(c[0] == s for c in has)], [t for t in treatments if any(c[1] == t for c in has)]
    wanted = [(s, t) for s in here_s for t in here_t]
    if len(here_s) < 2 or len(here_t) < 2:
        return None
    if len(has) == len(wanted):
        return here_s, here_t, True, dict(zip(wanted, np.eye(len(wanted))))
    effects = {(s, t): np.array([1.0, *(float(s == x) for x in here_s[1:]), *(float(t == x) for x in here_t[1:])]) for s, t in wanted}
    rank = np.linalg.matrix_rank(np.array([effects[c] for c in wanted if c in has]))
    return (here_s, here_t, False, effects) if rank == len(here_s) + len(here_t) - 1 else None


def _shaped(row: dict, stages: list[str], treatments: list[str]) -> dict:
    """A row of sums by cell, as one by additive effects where a cell has no rows."""
    found = _design(row, stages, treatments)
    if found is None or found[2]:
        return dict(row)
    cells, nk = [(s, t) for s in stages for t in treatments], np.asarray(row["nk"], float)
    kept = [i for i in range(len(cells)) if nk[i] > 0]
    design = np.array([found[3][cells[i]] for i in kept])
    a = np.asarray(row["a"], float).reshape(len(nk), -1)[np.ix_(kept, kept)]
    return {**dict(row), "a": (design.T @ a @ design).ravel(), "b": design.T @ np.asarray(row["b"], float)[kept], "nk": np.ones(design.shape[1])}


def interaction(long: DataFrame, keys: list[str], subject: str, stage: str, stages: list[str], treatment: str, treatments: list[str], value: str = "value", least: int = 10) -> DataFrame:
    """Stage by treatment models with a random intercept: a row for each term, mean, contrast and figure of a fit.

    Terms have F statistics of the marginal (type III) hypotheses; degrees of freedom are Satterthwaite's. Needs two
    stages and two treatments; contrasts carry unadjusted p values.
    """
    cell = F.concat_ws("\x1f", stage, treatment)
    x = long.withColumn("__cell", F.when(F.col(stage).isNotNull() & F.col(treatment).isNotNull(), cell))
    levels = [f"{s}\x1f{t}" for s in stages for t in treatments]
    return _finished(_searched(x, keys, subject, "__cell", levels, value, least, lambda r: _shaped(r, stages, treatments)), keys, INTERACTION, lambda rows: _interaction(rows, stages, treatments))


def subject_effects(long: DataFrame, keys: list[str], subject: str, stage: str, levels: list[str], fits: DataFrame, value: str = "value") -> DataFrame:
    """Predicted random intercepts: each subject's mean residual, shrunk by its count and the variance ratio.

    ``fits`` has keys, ``means`` (a map from level to estimated mean), ``residual_variance`` and ``subject_variance``.
    """
    x = long.where(F.col(value).isNotNull() & F.col(stage).isin(levels)).join(fits, keys)
    rest = F.col(value) - F.try_element_at("means", F.col(stage))
    by = x.groupBy(*keys, subject).agg(F.sum(rest).alias("__r"), F.count("*").alias("n"), F.first("residual_variance").alias("__e"), F.first("subject_variance").alias("__u"))
    return by.select(*keys, subject, "n", F.try_divide(F.col("__u") * F.col("__r"), F.col("__e") + F.col("n") * F.col("__u")).alias("effect"))


def _fit_for(sums: DataFrame, least: int) -> DataFrame:
    stages = F.size(F.filter("nk", lambda v: v > 0))
    return sums.where((F.col("n") >= least) & (F.col("m") >= 2) & (stages >= 2) & (F.col("n") > stages) & (F.col("c") > 0))
