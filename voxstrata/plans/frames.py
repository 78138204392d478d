"""Registered queries on frame tables. Eight successive vectors are one recording of 512 samples, a block each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import banks
from ..operators import cycles as C
from ..operators import frames as R
from .catalogue import query, r4, table

RATE, SIZE, STRIDE, BANDS, LOW, HIGH, LIFTER = 1000, 128, 64, 10, 20.0, 500.0, 23

BLOCKS = "s AS (SELECT vec_id // 8 AS clip, vec_id % 8 * 64 + unnest(range(64)) AS t, unnest(embedding)::DOUBLE AS v FROM embeddings)"
FRAMES = f"""{BLOCKS}, w AS (SELECT clip, f AS frame, t - f * {STRIDE} AS i, v FROM s JOIN range(0, 8) r(f) ON t >= f * {STRIDE} AND t < f * {STRIDE} + {SIZE}),
f AS (SELECT * FROM w JOIN (SELECT clip AS c, frame AS g FROM w GROUP BY 1, 2 HAVING count(*) = {SIZE}) ON clip = c AND frame = g)"""
HANN = f"(0.5 - 0.5 * cos(2 * pi() * i / {SIZE - 1}))"
#: The Fourier transform as sums over samples.
FOURIER = f"""x AS (SELECT clip, frame, k, sum(v * {HANN} * cos(2 * pi() * (k * i % {SIZE}) / {SIZE})) AS re, -sum(v * {HANN} * sin(2 * pi() * (k * i % {SIZE}) / {SIZE})) AS im
  FROM f, range(0, {SIZE // 2 + 1}) b(k) GROUP BY 1, 2, 3),
m AS (SELECT clip, frame, k, sqrt(re * re + im * im) / sum(sqrt(re * re + im * im)) OVER (PARTITION BY clip, frame) AS m FROM x)"""
MEL = f"""p AS (SELECT j, 700 * (pow(10, (2595 * log10(1 + {LOW}::DOUBLE / 700) + j * (2595 * log10(1 + {HIGH}::DOUBLE / 700) - 2595 * log10(1 + {LOW}::DOUBLE / 700)) / {BANDS + 1}) / 2595) - 1) AS hz FROM range(0, {BANDS + 2}) z(j)),
tri AS (SELECT a.j AS band, k, greatest(0, least((k * {RATE}::DOUBLE / {SIZE} - a.hz) / (b.hz - a.hz), (c.hz - k * {RATE}::DOUBLE / {SIZE}) / (c.hz - b.hz))) AS w
  FROM p a JOIN p b ON b.j = a.j + 1 JOIN p c ON c.j = a.j + 2, range(0, {SIZE // 2 + 1}) z(k)),
bank AS (SELECT band, k, w / sum(w) OVER (PARTITION BY band) AS w FROM tri),
l AS (SELECT clip, frame, band, 10 * log10(greatest(pow(sum(m * w), 2), 1e-12)) AS db FROM m JOIN bank USING (k) GROUP BY 1, 2, 3)"""


def blocks(spark, d):
    x = table(spark, d, "embeddings")
    return x.select(F.expr("vec_id div 8").alias("clip"), (F.col("vec_id") % 8 * 64).alias("at"), F.col("embedding").alias("samples"))


def framed(spark, d):
    return R.frame_table(blocks(spark, d), SIZE, STRIDE, RATE, wfunc="hann")


@query(
    f"""WITH {BLOCKS}, n AS (SELECT clip, max(t) + 1 AS n FROM s GROUP BY 1), r AS (SELECT clip, n, unnest(range(0, greatest(1, ceil((n - 150) / 70.0::DOUBLE)::BIGINT + 1))) AS frame FROM n)
SELECT r.clip, frame, round((75 + 70 * frame) / {RATE}.0::DOUBLE, 4) AS centre, least(150, n - frame * 70) AS present, round(sum(v * (0.54::DOUBLE - 0.46 * cos(2 * pi() * (t - frame * 70) / 149))), 4) AS total, round(max(v), 4) AS most
FROM r JOIN s ON s.clip = r.clip AND t >= frame * 70 AND t < frame * 70 + 150 GROUP BY ALL"""
)
def frame_rows(spark, d):
    """Frames of 150 ms every 70 ms, the end filled up with zeros, under a Hamming window: their sums, and the largest sample before it."""
    plain = R.frame_table(blocks(spark, d), 0.15, 0.07, RATE, unit="seconds", pad="end")
    ends = blocks(spark, d).groupBy("clip").agg(F.max(F.col("at") + F.size("samples")).alias("n"))
    sums = plain.select("clip", "frame", r4("centre").alias("centre"), r4(F.aggregate(R.window(F.col("samples"), F.lit(150), "hamming"), F.lit(0.0), lambda a, v: a + v)).alias("total"), "samples")
    out = sums.join(ends, "clip").withColumn("present", F.least(F.lit(150), F.col("n") - 70 * F.col("frame")))
    return out.select("clip", "frame", "centre", "present", "total", r4(F.expr("array_max(slice(samples, 1, int(present)))")).alias("most"))


@query(f"WITH {FRAMES}, {FOURIER}, {MEL} SELECT clip, frame, band::BIGINT AS band, round(db, 4) AS level FROM l")
def mel_levels(spark, d):
    """Mel bands of each frame's spectrum, in decibels."""
    levels = R.band_levels(R.magnitudes(R.spectra(framed(spark, d)), norm=True), banks.mel_bank(RATE, SIZE, BANDS, LOW, HIGH))
    return levels.select("clip", "frame", F.col("band").cast("long").alias("band"), r4(R.decibels(F.col("value"))).alias("level"))


@query(
    f"""WITH {FRAMES}, {FOURIER}, {MEL},
c AS (SELECT clip, frame, k - 1 AS k, sum(db * sqrt(2 / {BANDS}.0::DOUBLE) * cos(pi() * k * (2 * band + 1) / {2 * BANDS})) * (1 + {LIFTER} / 2.0::DOUBLE * sin(pi() * k / {LIFTER})) AS v FROM l, range(1, 7) z(k) GROUP BY clip, frame, k),
d AS (SELECT clip, k, 0 AS n, v FROM c UNION ALL SELECT b.clip, b.k, 1, b.v - a.v FROM c a JOIN c b ON a.clip = b.clip AND a.k = b.k AND b.frame = a.frame + 1
  UNION ALL SELECT b.clip, b.k, 2, x.v - 2 * b.v + a.v FROM c a JOIN c b ON a.clip = b.clip AND a.k = b.k AND b.frame = a.frame + 1 JOIN c x ON x.clip = a.clip AND x.k = a.k AND x.frame = a.frame + 2)
SELECT clip, repeat('d', n) || 'mfcc_' || k AS feature, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd, count(*) AS n FROM d GROUP BY clip, n, k"""
)
def mel_cepstra(spark, d):
    """Mean and deviation of six mel cepstral coefficients and of their first and second differences."""
    out = R.cepstral_family(framed(spark, d), banks.mel_bank(RATE, SIZE, BANDS, LOW, HIGH), BANDS, 1, 6, SIZE, "mfcc", LIFTER)
    return out.select("clip", "feature", r4("mean").alias("mean"), r4("sd").alias("sd"), "n")


Q_BINS = {"octaves": 3, "per_octave": 6, "base": 55.0, "threshold": 0.0, "low": 50.0, "high": 400.0}


@query(
    f"""WITH {FRAMES}, h AS (SELECT clip, frame, i, v * {HANN} AS v FROM f),
q AS (SELECT j - 1 AS pitch, hz, n, ({SIZE} - n) // 2 AS b FROM (SELECT row_number() OVER (ORDER BY hz) AS j, hz, n FROM (
  SELECT 55.0::DOUBLE * pow(2, e / 6.0::DOUBLE) AS hz, ceil(1 / (pow(2, 1 / 6.0::DOUBLE) - 1) * {RATE} / (55.0::DOUBLE * pow(2, e / 6.0::DOUBLE)))::BIGINT AS n FROM range(0, 18) z(e)) WHERE hz <= 400 AND n <= {SIZE})),
a AS (SELECT pitch, hz, i, (0.5 - 0.5 * cos(2 * pi() * (i - b) / (n - 1))) / n * cos(2 * pi() * hz / {RATE} * (i - b)) AS c, (0.5 - 0.5 * cos(2 * pi() * (i - b) / (n - 1))) / n * sin(2 * pi() * hz / {RATE} * (i - b)) AS s
  FROM q JOIN range(0, {SIZE}) z(i) ON i >= b AND i < b + n)
SELECT clip, frame, pitch, round(any_value(hz), 4) AS frequency, round(sqrt(pow(sum(v * c), 2) + pow(sum(v * s), 2)), 4) AS amplitude FROM h JOIN a USING (i) GROUP BY clip, frame, pitch"""
)
def constant_q_levels(spark, d):
    """Amplitudes of a constant-Q transform of each frame; without a threshold the kernel's products are those with its atoms in time."""
    out = R.constant_q(R.spectra(framed(spark, d)), banks.constant_q(RATE, SIZE, **Q_BINS))
    return out.select("clip", "frame", F.col("pitch").cast("long").alias("pitch"), r4("frequency").alias("frequency"), r4(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2)).alias("amplitude"))


@query(
    f"""WITH {BLOCKS}, x AS (SELECT clip, t, 0.5 + abs(v) AS v FROM s),
w AS (SELECT clip, v, lag(v) OVER o AS b, CASE WHEN count(*) OVER (o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 3 THEN avg(v) OVER (o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) END AS m3,
  CASE WHEN count(*) OVER (o ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 THEN avg(v) OVER (o ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS m5,
  CASE WHEN count(*) OVER (o ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) = 11 THEN avg(v) OVER (o ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) END AS m11 FROM x WINDOW o AS (PARTITION BY clip ORDER BY t))
SELECT clip, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(abs(v - b)), 6) AS mean_step, round(100 * avg(abs(v - b)) / avg(v), 6) AS step_percent, round(1000 * avg(abs(v - b)) / avg(v), 6) AS step_ratio,
  round(100 * avg(abs(1 / v - 1 / b)) / avg(1 / v), 6) AS inverse_percent, round(20 * avg(abs(log10(b / v))), 6) AS level_step, round(100 * avg(abs((v - b) / v)), 6) AS factor,
  round(100 * avg(abs(1 - v / m3)), 6) AS quotient_3, round(100 * avg(abs(1 - v / m5)), 6) AS quotient_5, round(100 * avg(abs(1 - v / m11)), 6) AS quotient_11, round(sum(abs(m3 - v)) / sum(v), 6) AS rap,
  round(sum(abs(m3 - v)) / sum(v) * count(*) / (count(*) - 2), 6) AS rap_scaled, round(1000 * var_pop(v) / avg(v) ** 2, 6) AS variability, round(log10(1000 * var_pop(v) / avg(v) ** 2), 6) AS variability_log FROM w GROUP BY clip"""
)
def cycle_measures(spark, d):
    """All perturbation measures of each recording's samples, taken as cycles' values."""
    x = blocks(spark, d).select("clip", F.posexplode("samples").alias("i", "v"), "at").select("clip", (F.col("at") + F.col("i")).alias("t"), (0.5 + F.abs(F.col("v").cast("double"))).alias("v"))
    out = C.measures(x, ["clip"], "t", "v")
    return out.select("clip", "n", *(F.round(c, 6).alias(c) for c in out.columns[2:]))
