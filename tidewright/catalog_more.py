"""More named queries and their DuckDB SQL: crops, names, bands, weights, cluster reports, spectra and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.catalog import _FCAST, _WIN, DIMENSIONS, KEY, SAMPLES, VECTORS, _forecasts, _frame, _windows, query, r6, samples, vectors
from tidewright.functions import columns as C
from tidewright.operators import aggregates as A
from tidewright.operators import clusters as G
from tidewright.operators import dynamics as D
from tidewright.operators import forecast as FC
from tidewright.operators import splits as X
from tidewright.operators import windows as WN
from tidewright.operators.ordered import sizes

# Crops and filters -------------------------------------------------------------------------------------------------


@query(" SELECT event_type, seq FROM s WHERE (seq - 1) / 8.0::DOUBLE >= 0.5 AND (seq - 1) / 8.0::DOUBLE <= 200.25")
def time_crop(s):
    from tidewright.sources.readers import crop_time

    return crop_time(s.withColumn("at", (F.col("seq") - 1) / 8.0), "at", 0.5, 200.25).select(*KEY, "seq")


@query(" SELECT event_id FROM s WHERE abs(zeroed) > 5")
def away_from_zero(s):
    return s.where(C.away_from_zero("zeroed", 5.0)).select("event_id")


@query(" SELECT event_id FROM s WHERE event_type IN ('click', 'view', 'error') AND event_type <> 'error'")
def keep_types(s):
    from tidewright.sources.readers import keep_types as keep

    return keep(s, "event_type", ["click", "view", "error"], "error").select("event_id")


@query(
    """, n AS (SELECT event_type, (count(*) - 64) // 7 + 1 AS n FROM s GROUP BY event_type), k AS (SELECT event_type, n, unnest(range(12)) AS k FROM n WHERE n > 12)
SELECT DISTINCT event_type, CAST(7 * round_even(k * ((n - 1) / 11.0::DOUBLE), 0) AS BIGINT) AS start FROM k
UNION ALL SELECT event_type, 7 * unnest(range(n)) FROM n WHERE n <= 12"""
)
def spaced_starts(s):
    starts = WN.window_starts(sizes(s, KEY), "n", 64, 0, 7, mode="center").select(*KEY, "start")
    return WN.spaced_starts(starts, KEY, 12, 7)


# Non-finite samples: null, NaN and infinity --------------------------------------------------------------------------

_HOLES = ", h AS (SELECT event_type, seq, CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0 THEN NULL ELSE sqrt(value) END AS x FROM s)"


def _holes(s):
    n = F.col("event_id")
    x = F.when(n % 17 == 0, None).when(n % 19 == 0, float("nan")).when(n % 23 == 0, float("inf")).otherwise(F.sqrt("value"))
    return s.select(*KEY, "seq", x.alias("x"))


@query(
    f"""{_HOLES} SELECT event_type, seq, {", ".join(f"round(avg(x) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) AS m{w}" for w in (9, 63, 64, 100))},
  round(sqrt(avg(x * x) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN 35 PRECEDING AND 34 FOLLOWING)), 6) AS rms70 FROM h"""
)
def frames_with_holes(s):
    out = _holes(s)
    for w in (9, 63, 64, 100):
        out = WN.frame_mean(out, KEY, F.col("x"), w, "causal", f"m{w}")
    out = WN.moving_rms(out, KEY, F.col("x"), 70, "A", "rms70")
    return out.select(*KEY, "seq", *[r6(c, c) for c in ("m9", "m63", "m64", "m100", "rms70")])


# Names and settings --------------------------------------------------------------------------------------------------


@query(
    """SELECT event_id, substr(CASE WHEN x = '' THEN 'na' ELSE x END, 1, 12) AS tag, regexp_replace(props || event_type, '[^A-Za-z0-9._-]', '_', 'g') AS file
FROM (SELECT *, trim(regexp_replace(props || event_type, '[^A-Za-z0-9_.-]+', '-', 'g'), '-') AS x FROM events)""",
    source=None,
)
def other_names(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.concat("props", "event_type")
    return e.select("event_id", C.tag_name(name, 12).alias("tag"), C.file_name(name).alias("file"))


_NAMES = "['x_raw', 'x_RAW', 'x_smooth', 'x_cma', 'main_raw', 'p00']"


@query(
    f"""SELECT event_id, lower(a) = lower(b) OR ((contains(lower(a), 'raw') = contains(lower(b), 'raw')) AND regexp_matches(lower(a), 'smooth|ma|cma|main') AND regexp_matches(lower(b), 'smooth|ma|cma|main')) AS same
FROM (SELECT event_id, {_NAMES}[event_id % 6 + 1] AS a, {_NAMES}[user_id % 6 + 1] AS b FROM events)""",
    source=None,
)
def same_waveform(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = lambda c: F.get(F.array(*map(F.lit, ("x_raw", "x_RAW", "x_smooth", "x_cma", "main_raw", "p00"))), (F.col(c) % 6).cast("int"))
    return e.select("event_id", C.same_waveform(name("event_id"), name("user_id")).alias("same"))


@query(
    """, n AS (SELECT event_type, user_id, count(*) AS n FROM s GROUP BY event_type, user_id), p AS (SELECT event_type, user_id, n,
  CASE WHEN n % 3 > 0 THEN (n % 3) * 20.0::DOUBLE WHEN n % 4 > 0 THEN (n % 4) * 7.5::DOUBLE ELSE greatest(8.0::DOUBLE, n::DOUBLE) END AS period FROM n)
SELECT event_type, user_id, period, CASE WHEN n % 5 > 0 THEN CAST(n % 5 AS BIGINT) ELSE CAST(greatest(3, round_even(period / 10, 0)) AS BIGINT) END AS smooth,
  CASE WHEN n <= 1 THEN 1 ELSE CAST(pow(2, ceil(log2(n))) AS BIGINT) END AS power FROM p"""
)
def resolved_settings(s):
    n = F.col("n")
    f = s.groupBy("event_type", "user_id").agg(F.count("*").alias("n")).withColumn("period", C.resolved_period(None, n % 3 * 20.0, n % 4 * 7.5, n.cast("double")))
    return f.select("event_type", "user_id", "period", C.resolved_window(0, n % 5, F.col("period")).alias("smooth"), C.next_power_of_two("n").alias("power"))


_BAND = "[" + ", ".join(f"{{'low': greatest(1e-6, {a} * f), 'high': CASE WHEN least(49.0, {b} * f) > greatest(1e-6, {a} * f) THEN least(49.0, {b} * f) ELSE least(49.0, 1.5 * greatest(1e-6, {a} * f)) END}}" for a, b in ((0.5, 1.5), (1.5, 3.0), (3.0, 6.0), (6.0, 10.0))) + "]"


@query(
    f""", f AS (SELECT event_type, seq, CASE WHEN event_id % 13 = 0 THEN 0.0::DOUBLE ELSE value / 4 END AS f FROM s), b AS (SELECT event_type, seq, f, list_filter({_BAND}, lambda b: b.high > b.low AND b.low < 50) AS own FROM f)
SELECT event_type, seq, {", ".join(f"round(CASE WHEN f <= 0 THEN 1 + {k} * 11.0 WHEN len(own) > {k} THEN own[{k + 1}].low ELSE 0 END, 6) AS low{k}, round(CASE WHEN f <= 0 THEN 1 + {k + 1} * 11.0 WHEN len(own) > {k} THEN own[{k + 1}].high ELSE 0 END, 6) AS high{k}" for k in range(4))} FROM b"""
)
def relative_bands(s):
    f = s.withColumn("f", F.when(F.col("event_id") % 13 == 0, 0.0).otherwise(F.col("value") / 4)).withColumn("b", C.relative_bands(F.col("f"), F.lit(100.0), 4))
    return f.select(*KEY, "seq", *[r6(F.col("b")[k][c], f"{c}{k}") for k in range(4) for c in ("low", "high")])


@query(
    """ SELECT event_type, seq, 0.5::DOUBLE AS low, least((user_id % 7 + 1) / 2.0::DOUBLE, 2.5::DOUBLE) AS high,
  CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 5 ELSE -1 END AS type, list_filter([trim(event_type), '', 'x'], lambda p: p <> '')[2] AS second FROM s"""
)
def frequency_limits(s):
    low, high = C.frequency_bounds((F.col("user_id") % 7 + 1).cast("double"), 0.1, 2.5, 0.0, 2.0)
    kind = F.when(F.col("event_type") == "click", "stable_single_freq").when(F.col("event_type") == "view", "weak_periodic").otherwise("none")
    second = C.listed(F.concat("event_type", F.lit(" ,, x")))[1]
    return s.select(*KEY, "seq", low.alias("low"), high.alias("high"), C.type_id(kind).alias("type"), second.alias("second"))


@query(
    """, m AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM s GROUP BY event_type)
SELECT event_type, seq, round((value - m) / sd, 6) AS z, round((user_id - user_id) / 1.0, 6) AS flat FROM s JOIN m USING (event_type)"""
)
def standardised_values(s):
    m = s.groupBy(*KEY).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    z = C.standardised("value", F.col("m"), F.col("sd"), 1e-8)
    flat = C.standardised("user_id", F.col("user_id"), F.lit(1e-9), 1e-8)
    return s.join(m, KEY).select(*KEY, "seq", r6(z, "z"), r6(flat, "flat"))


# Weights and losses --------------------------------------------------------------------------------------------------


@query(
    """, v AS (SELECT event_id, zeroed AS x, seq <= 300 AS train FROM s), m AS (SELECT median(x) AS m FROM v WHERE train),
q AS (SELECT quantile_cont(abs(x - m), 0.95) AS far FROM v, m WHERE train), l AS (SELECT quantile_cont(abs(x), 0.9) AS large FROM v WHERE train AND x <> 0)
SELECT event_id, round(pow(greatest(least(abs(x - m) / far, 1), 0), 0.5), 6) AS amp_weight, abs(x) >= large AS active FROM v, m, q, l"""
)
def amplitude_weights(s):
    rows = s.select("event_id", "zeroed", F.when(F.col("seq") <= 300, "train").otherwise("test").alias("split"))
    return X.amplitude_weights(rows, "zeroed", gamma=0.5).select("event_id", r6("amp_weight", "amp_weight"), "active")


@query(
    f"""{_FCAST} SELECT event_type, round(sum(h * w) / greatest(sum(w), 1e-6), 6) AS sample_weighted FROM (SELECT event_type, abs(y) AS w, CASE WHEN abs(p - y) < 1 THEN 0.5 * (p - y) * (p - y) ELSE abs(p - y) - 0.5 END AS h FROM g) GROUP BY event_type"""
)
def sample_weighted_loss(s):
    f = _forecasts(s).withColumn("w", F.abs("y"))
    return FC.losses(f, KEY, "p", "y", weight="w").select(*KEY, r6("sample_weighted", "sample_weighted"))


@query(
    f"""{_WIN}, t AS (SELECT v.event_type, v.start, v.x[32] AS l, v.x[31] AS k, s.seq - v.start - 32 AS h, s.value AS y FROM v JOIN s ON s.event_type = v.event_type AND s.seq > v.start + 32 AND s.seq <= v.start + 40),
d AS (SELECT *, y - lag(y) OVER (PARTITION BY event_type, start ORDER BY h) AS dy FROM t)
SELECT event_type, start, round(avg(abs(l - y)), 6) AS level, round(avg(dy * dy), 6) AS slope, round(any_value((l - k) * (l - k)), 6) AS boundary FROM d GROUP BY event_type, start"""
)
def hybrid_loss_terms(s):
    w = _windows(s).withColumn("pred", FC.persistence(F.col("x"), 8))
    return FC.hybrid_loss(w, [*KEY, "start"]).select(*KEY, "start", *[r6(c, c) for c in ("level", "slope", "boundary")])


@query(
    f"""{_WIN}, t AS (SELECT v.event_type, v.start, v.x[32] AS p, s.seq - v.start - 33 AS h, s.value AS y FROM v JOIN s ON s.event_type = v.event_type AND s.seq > v.start + 32 AND s.seq <= v.start + 40 WHERE v.start < 1600)
SELECT event_type, start // 16 * 8 + h AS index, y AS true, p AS pred FROM t WHERE start // 16 * 8 + h < 100"""
)
def rolling_values(s):
    w = _windows(s).withColumn("pred", FC.persistence(F.col("x"), 8)).where("start < 1600").withColumn("start", F.floor(F.col("start") / 16).cast("long") * 8)
    return FC.rolling_evaluation(w, KEY, 8, 100)


_PEAK = ["target_h_0", "target_h_1", "target_dt_0"]


@query(
    """, w AS (SELECT seq, event_type, value AS target_h_0, user_id::DOUBLE AS target_h_1, t - lag(t, 1, t) OVER (PARTITION BY event_type ORDER BY seq) AS target_dt_0 FROM s),
l AS (SELECT 'height' AS part, target_h_0 AS y, 50.0 AS p, target_h_0 / 2 AS b FROM w UNION ALL SELECT 'height', target_h_1, 50.0, target_h_1 / 2 FROM w UNION ALL SELECT 'interval', target_dt_0, 50.0, target_dt_0 / 2 FROM w),
a AS (SELECT * FROM l UNION ALL SELECT 'all', y, p, b FROM l)
SELECT part, round(avg((p - y) * (p - y)) / 1e6, 4) AS mse, round(avg(abs(p - y)) / 1e3, 4) AS mae, round(avg((b - y) * (b - y)) / 1e6, 4) AS naive_mse, round(corr(b, y), 6) AS naive_pearson FROM a GROUP BY part"""
)
def peak_metrics(s):
    from tidewright.operators.ordered import framed

    w = framed(s, KEY, 1, 0, lambda o: {"target_dt_0": F.col("t") - F.coalesce(F.lag("t").over(o), "t")})
    w = w.withColumns({"target_h_0": F.col("value"), "target_h_1": F.col("user_id").cast("double")})
    w = w.withColumns({f"pred_{c}": F.lit(50.0) for c in _PEAK} | {f"naive_{c}": F.col(c) / 2 for c in _PEAK})
    m = FC.peak_metrics(w, _PEAK)
    part = lambda c, by: F.round(F.col(c) / by, 4).alias(c)
    return m.select("part", part("mse", 1e6), part("mae", 1e3), part("naive_mse", 1e6), r6("naive_pearson", "naive_pearson"))


# Clusters ------------------------------------------------------------------------------------------------------------


@query(
    f"""{VECTORS}, a AS (SELECT label, i, avg(e) AS mean, stddev_pop(e) AS std, count(*) AS n FROM x GROUP BY label, i)
SELECT label, any_value(n) AS n, {", ".join(f"round(max(CASE WHEN i = {i} THEN mean END), 5) AS e{i}_mean, round(max(CASE WHEN i = {i} THEN std END), 5) AS e{i}_std" for i in range(64))} FROM a GROUP BY label""",
    source=vectors,
)
def cluster_summary(e):
    found = G.cluster_summary(e, DIMENSIONS, "label")
    return found.select("label", "n", *[F.round(c, 5).alias(c) for c in found.columns[2:]])


@query(f"{VECTORS} SELECT 'e' || i AS feature, round(stddev_pop(ce), 5) AS spread FROM c GROUP BY i ORDER BY stddev_pop(ce) DESC, feature LIMIT 20", source=vectors)
def separating_features(e):
    return A.separating_features(e, "label", DIMENSIONS).withColumn("spread", F.round("spread", 5))


@query(
    """, k AS (SELECT user_id % 20 + 2 AS k, round(max(value), -1) AS silhouette, min(value) AS davies_bouldin FROM s GROUP BY user_id % 20)
SELECT k FROM k ORDER BY silhouette DESC, davies_bouldin LIMIT 1"""
)
def best_k(s):
    k = s.groupBy((F.col("user_id") % 20 + 2).alias("k")).agg(F.round(F.max("value"), -1).alias("silhouette"), F.min("value").alias("davies_bouldin"))
    return G.best_k(k).select("k")


@query(
    """, w AS (SELECT event_type, user_id % 3 AS channel, value, unnest(CASE WHEN (seq - 1) // 50 = 0 THEN [0] ELSE [(seq - 1) // 50 - 1, (seq - 1) // 50] END) AS win FROM s),
m AS (SELECT event_type, win, channel, avg(value) AS m, max(value) - min(value) AS ptp FROM w GROUP BY ALL), l AS (SELECT event_type, win, avg(m) AS mean, stddev_pop(m) AS channel_mean_std, avg(ptp) AS ptp_mean, max(ptp) AS ptp_max FROM m GROUP BY ALL),
c AS (SELECT w.event_type, w.win, value - m AS c FROM w JOIN m USING (event_type, win, channel)),
f AS (SELECT event_type, win, sqrt(avg(c * c)) AS rms, max(abs(c)) AS max_abs, stddev_pop(c) AS std, avg(c * c * c) / pow(stddev_pop(c), 3) AS skew, avg(c * c * c * c) / pow(stddev_pop(c), 4) AS kurtosis FROM c GROUP BY ALL)
SELECT event_type, CAST(win AS BIGINT) AS win, round(mean, 6) AS mean, round(channel_mean_std, 6) AS channel_mean_std, round(ptp_mean, 6) AS ptp_mean, round(ptp_max, 6) AS ptp_max, round(rms, 6) AS rms, round(max_abs, 6) AS max_abs,
  round(CASE WHEN rms > 1e-12 THEN max_abs / rms ELSE 0 END, 6) AS crest, round(std, 6) AS std, round(CASE WHEN std <= 1e-12 THEN 0 ELSE skew END, 5) AS skew, round(CASE WHEN std <= 1e-12 THEN 0 ELSE kurtosis END, 5) AS kurtosis
FROM l JOIN f USING (event_type, win)"""
)
def window_features(s):
    rows = WN.windowed_rows(s, 100, 50).withColumn("channel", F.col("user_id") % 3)
    f = G.window_features(rows, [*KEY, "win"], "channel", "value", "seq")
    return f.select(*KEY, "win", *[r6(c, c) for c in ("mean", "channel_mean_std", "ptp_mean", "ptp_max", "rms", "max_abs", "crest", "std")], F.round("skew", 5).alias("skew"), F.round("kurtosis", 5).alias("kurtosis"))


# Spectra, envelopes and dynamics -------------------------------------------------------------------------------------


@query(
    """, n AS (SELECT event_type, count(*) AS n, avg(value) AS m FROM s GROUP BY event_type), k AS (SELECT event_type, n, m, unnest(range(1, n // 2 + 1)) AS k FROM n),
f AS (SELECT k.event_type, any_value(n) AS n, k, sqrt(pow(sum((value - m) * cos(2 * pi() * ((k * (seq - 1)) % n) / n)), 2) + pow(sum((value - m) * sin(2 * pi() * ((k * (seq - 1)) % n) / n)), 2)) AS a
  FROM k JOIN s ON s.event_type = k.event_type GROUP BY k.event_type, k)
SELECT event_type, round(arg_max(n / k::DOUBLE, a), 6) AS dominant_period_steps, round(100.0 / arg_max(n / k::DOUBLE, a), 6) AS dominant_frequency_hz, round(arg_max(n / k::DOUBLE, a) / 100.0, 6) AS dominant_period_seconds,
  round(max(a) / sum(a), 6) AS amplitude_share FROM f GROUP BY event_type"""
)
def dominant_period(s):
    from tidewright.plans.profile import periodogram

    p = periodogram(s, KEY, "value", 100.0)
    return p.select(*KEY, *[r6(c, c) for c in ("dominant_frequency_hz", "dominant_period_steps", "dominant_period_seconds", "amplitude_share")])


@query(
    f""", b AS (SELECT event_type, seq, value, value - {_frame("value", 47, 0)} AS d FROM s),
u AS (SELECT *, CASE WHEN lag(d) OVER w < 0 AND d >= 0 THEN seq END AS up FROM b WINDOW w AS (PARTITION BY event_type ORDER BY seq)),
p AS (SELECT *, max(up) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, max(up) OVER (PARTITION BY event_type ORDER BY seq) AS cur FROM u),
g AS (SELECT event_type, seq AS at, 100.0::DOUBLE / (seq - prior) AS f FROM p WHERE up IS NOT NULL AND prior IS NOT NULL),
l AS (SELECT p.event_type, p.seq, value, coalesce(g.f, 100.0 / 24) AS f FROM p LEFT JOIN g ON g.event_type = p.event_type AND g.at = p.cur)
SELECT event_type, seq, round(sqrt({_frame("value * value", 5, 0)}), 6) AS qp_envelope, round({_frame("f", 5, 0)}, 6) AS qp_local_freq, round({_frame("f", 5, 0)} / (100.0 / 24), 6) AS qp_local_freq_ratio,
  round(1 + sin(2 * pi() * (seq - 1) / 24), 6) AS phase_sin_1, round(1 + cos(2 * pi() * (seq - 1) / 24), 6) AS phase_cos_1 FROM l"""
)
def augment_envelope(s):
    from tidewright.plans.augment import augmented

    a = augmented(s.select(*KEY, "seq", "value"), KEY, "value", 24.0, 100.0, ["envelope_freq"])
    # 1 is added to the phase's parts, as a rounded zero may have either sign
    shifted = [r6(1 + F.col(f"qp_phase_{p}"), f"phase_{p}_1") for p in ("sin", "cos")]
    return a.select(*KEY, "seq", *[r6(c, c) for c in ("qp_envelope", "qp_local_freq", "qp_local_freq_ratio")], *shifted)


@query(
    """, c AS (SELECT event_type, seq % 20 AS k, avg(value) / 100 AS divergence FROM s GROUP BY event_type, seq % 20)
SELECT event_type, round(regr_slope(divergence, k), 8) AS slope, round(CASE WHEN regr_slope(divergence, k) > 0 THEN 1 / regr_slope(divergence, k) ELSE NULL END, 3) AS time_steps FROM c WHERE k BETWEEN 2 AND 11 GROUP BY event_type"""
)
def lyapunov_time(s):
    c = s.groupBy(*KEY, (F.col("seq") % 20).alias("k")).agg((F.avg("value") / 100).alias("divergence"))
    out = D.lyapunov(c, 2, 11, 1.0, keys=tuple(KEY))
    return out.select("event_type", F.round("slope", 8).alias("slope"), F.when(F.col("time_steps") < float("inf"), F.round("time_steps", 3)).alias("time_steps"))


@query(
    """, e AS (SELECT event_type, event_id, value, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY seq) < 7200000000 THEN 0 ELSE 1 END AS new FROM s),
g AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY t, event_id) AS g FROM e)
SELECT event_type, count(*) AS n_rows, round(avg(value), 6) AS mean, round(min(t) / 1e6, 3) AS first FROM g GROUP BY event_type, g"""
)
def activity_sessions(s):
    from tidewright.streaming.causal import sessions

    w = sessions(s.withColumn("at", F.col("ts").cast("timestamp")), KEY, "at", "value", "2 hours")
    return w.select(*KEY, "n_rows", r6("mean", "mean"), F.round(F.unix_micros("session_start") / F.lit(1e6), 3).alias("first"))


@query()
def augmented_table(s):
    from tidewright.plans.augment import augmented

    return augmented(s.select(*KEY, "seq", "value"), KEY, "value", 24.0, 100.0)


_BY_TYPE = lambda f: f"CASE event_type WHEN 'click' THEN {f(0)} WHEN 'view' THEN {f(1)} ELSE {f(2)} END"


@query(
    f""", b AS (SELECT event_type, seq, value, {_BY_TYPE(lambda k: _frame("value", (8, 12, 10)[k], 0))} AS m, {_BY_TYPE(lambda k: _frame("value", (4, 6, 5)[k], (4, 6, 5)[k]))} AS c FROM s)
SELECT event_type, seq, round(m, 6) AS qp_main_input, round(c, 6) AS qp_main_target, round(value - m, 6) AS qp_residual, round(sqrt({_BY_TYPE(lambda k: _frame("m * m", (5, 9, 7)[k], 0))}), 6) AS qp_envelope,
  round({_BY_TYPE(lambda k: f"1 + sin(2 * pi() * (seq - 1) / {(24, 40, 32)[k]})")}, 6) AS phase_sin_1, {_BY_TYPE(lambda k: ("0.75::DOUBLE", "0.25::DOUBLE", "0.5::DOUBLE")[k])} AS qp_predictability_score, {_BY_TYPE(lambda k: (0, 5, 0)[k])} AS qp_signal_type_id FROM b"""
)
def augment_by_profile(s):
    """Each segment by its own profile; segments without one by the medians of all."""
    from tidewright.plans.augment import augmented

    found = [("click", 24.0, 9.0, 0.75, "stable_single_freq"), ("view", 40.0, 13.0, 0.25, "weak_periodic")]
    profiles = s.sparkSession.createDataFrame(found, "event_type string, dominant_period_samples double, recommended_smooth_window double, predictability_score double, signal_type string")
    a = augmented(s.select(*KEY, "seq", "value"), KEY, "value", None, 100.0, ["main_residual", "envelope_freq", "predictability"], profiles=profiles)
    names = ("qp_main_input", "qp_main_target", "qp_residual", "qp_envelope")
    return a.select(*KEY, "seq", *[r6(c, c) for c in names], r6(1 + F.col("qp_phase_sin"), "phase_sin_1"), "qp_predictability_score", "qp_signal_type_id")


@query(source=vectors)
def cluster_sweep(e):
    return G.sweep(e, "vec_id", DIMENSIONS, G.k_values("2-4"), [1, 2, 3, 4, 5])["scores"]


@query()
def strongest_bins(s):
    return FC.strongest_bins(_windows(s), "x", 5).select(*KEY, "start", "season", "trend")


@query()
def profile_report(s):
    from tidewright.plans.profile import profile, profile_report as report

    return report(profile(s, KEY, "value", 1.0))


__all__ = ["SAMPLES", "samples"]
