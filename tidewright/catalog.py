"""Named queries of the time-series operators and their DuckDB SQL.

`events` is the sample table: a segment is an event type, seq orders it by
time. Floats are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import columns as C
from tidewright.operators import aggregates as A
from tidewright.operators import dynamics as D
from tidewright.operators import forecast as FC
from tidewright.operators import joins as J
from tidewright.operators import splits as X
from tidewright.operators import windows as WN
from tidewright.operators.ordered import number, runs, sizes

FLAGSHIP = "profile_segments"
KEY = ["event_type"]
#: References and candidates of the divergence and of the false neighbours: the reference's own defaults.
NEIGHBOUR_SAMPLE = (1500, 4000)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

#: The sample table in SQL; gaps are made where event_id divides by 17, zeros where it divides by 29 or 31.
SAMPLES = """
WITH s AS (
  SELECT event_type, user_id, event_id, ts, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS seq,
         epoch_us(ts) / 1e6 AS t, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS gappy,
         CASE WHEN event_id % 29 = 0 OR event_id % 31 = 0 THEN CAST(0 AS DOUBLE) ELSE value END AS zeroed
  FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a long sample table: event_type, seq, t (seconds), value, and the made gaps and zeros."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    rows = number(e, KEY, ["ts", "event_id"], F.to_date("ts"))
    return rows.withColumns(
        {
            "t": F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6),
            "gappy": F.when(F.col("event_id") % 17 == 0, None).otherwise(F.col("value")),
            "zeroed": F.when((F.col("event_id") % 29 == 0) | (F.col("event_id") % 31 == 0), 0.0).otherwise(F.col("value")),
        }
    )


def query(sql: str | None = None, source=samples):
    """Register a function of the sample table (or of another source) under its name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(source(spark, sf_dir)) if source else f(spark, sf_dir)
        if sql:
            _SQL[f.__name__] = (SAMPLES if source is samples else "") + sql
        return f

    return add


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def out(df: DataFrame, **floats) -> DataFrame:
    """event_type, seq and rounded columns."""
    return df.select(*KEY, "seq", *[r6(c, n) for n, c in floats.items()])


def _frame(x: str, before: int, after: int, agg: str = "avg") -> str:
    return f"{agg}({x}) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"


# Windows ---------------------------------------------------------------------------------------------------------


@query(f" SELECT event_type, seq, round({_frame('value', 8, 0)}, 6) AS m FROM s")
def smooth_causal(s):
    return out(WN.frame_mean(s, KEY, F.col("value"), 9, "causal", "m"), m="m")


@query(f" SELECT event_type, seq, round({_frame('sqrt(value)', 99, 0)}, 6) AS m FROM s")
def smooth_causal_wide(s):
    return out(WN.frame_mean(s, KEY, F.sqrt("value"), 100, "causal", "m"), m="m")


@query(f" SELECT event_type, seq, round({_frame('value', 5, 4)}, 6) AS m FROM s")
def smooth_centered_a(s):
    return out(WN.frame_mean(s, KEY, F.col("value"), 10, "A", "m"), m="m")


@query(f" SELECT event_type, seq, round({_frame('value', 4, 5)}, 6) AS m FROM s")
def smooth_centered_b(s):
    return out(WN.frame_mean(s, KEY, F.col("value"), 10, "B", "m"), m="m")


@query(f" SELECT event_type, seq, round({_frame('sqrt(value)', 49, 50)}, 6) AS m FROM s")
def smooth_centered_b_wide(s):
    return out(WN.frame_mean(s, KEY, F.sqrt("value"), 100, "B", "m"), m="m")


_RUNS = """, f AS (SELECT *, CASE WHEN seq = 1 OR (value >= 60) <> (lag(value) OVER w >= 60) THEN 1 ELSE 0 END AS new FROM s
  WINDOW w AS (PARTITION BY event_type ORDER BY seq)),
g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY event_type ORDER BY seq) AS BIGINT) AS run FROM f)"""


@query(f"{_RUNS} SELECT event_type, seq, round(avg(value) OVER (PARTITION BY event_type, run ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS m FROM g")
def smooth_by_run(s):
    return out(WN.smooth_by_run(s.withColumn("high", F.col("value") >= 60), KEY, "high", F.col("value"), 3, "causal", "m"), m="m")


@query(f"{_RUNS} SELECT event_type, run, min(seq) AS first, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY event_type, run")
def run_segments(s):
    marked = runs(s.withColumn("high", F.col("value") >= 60), KEY, "high")
    return marked.groupBy(*KEY, "run").agg(F.min("seq").alias("first"), F.count("*").alias("n"))


@query(f" SELECT event_type, seq, round(sqrt({_frame('value * value', 10, 0)}), 6) AS m FROM s")
def rolling_rms(s):
    return out(WN.moving_rms(s, KEY, F.col("value"), 11, "causal", "m"), m="m")


@query(
    f""", n AS (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, first_value(value) OVER w AS head, last_value(value) OVER w AS tail FROM s
  WINDOW w AS (PARTITION BY event_type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT event_type, seq, round(sqrt(({_frame('value * value', 4, 5, 'sum')} + greatest(5 - seq, 0) * head * head + greatest(seq + 5 - n, 0) * tail * tail) / 10), 6) AS m FROM n"""
)
def local_rms_edge(s):
    return out(WN.edge_rms(s, KEY, "value", 10, "m"), m="m")


@query(f" SELECT event_type, seq, round({_frame('value', 4, 4, 'sum')} / 9, 6) AS m FROM s")
def conv_same(s):
    return out(WN.same_convolution(s, KEY, F.col("value"), 9, "m"), m="m")


@query(
    """, k AS (SELECT *, CASE WHEN gappy IS NOT NULL THEN seq END AS pos FROM s),
c AS (SELECT *, max(pos) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
  min(pos) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM k)
SELECT c.event_type, c.seq, round(CASE WHEN c.a IS NULL THEN y.value WHEN c.b IS NULL OR c.a = c.b THEN x.value
  ELSE x.value + (y.value - x.value) * (c.seq - c.a) / (c.b - c.a) END, 6) AS m
FROM c LEFT JOIN s x ON x.event_type = c.event_type AND x.seq = c.a LEFT JOIN s y ON y.event_type = c.event_type AND y.seq = c.b"""
)
def interp_nonfinite(s):
    return out(WN.interpolate(s, KEY, "gappy", "m"), m="m")


@query(
    """, z AS (SELECT *, max(CASE WHEN zeroed <> 0 THEN seq END) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
  min(CASE WHEN zeroed <> 0 THEN seq END) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM s),
j AS (SELECT z.*, x.zeroed AS u, y.zeroed AS v FROM z LEFT JOIN s x ON x.event_type = z.event_type AND x.seq = z.a LEFT JOIN s y ON y.event_type = z.event_type AND y.seq = z.b),
q AS (SELECT *, coalesce(zeroed = 0 AND b - a - 1 <= 2 AND u >= 5 AND v >= 5, false) AS repaired FROM j)
SELECT event_type, seq, repaired, round(CASE WHEN repaired THEN u + (v - u) * (seq - a) / (b - a) ELSE zeroed END, 6) AS m FROM q"""
)
def zero_gap_repair(s):
    return WN.repair_zero_gaps(s, KEY, "zeroed", "m", 2, 5.0).select(*KEY, "seq", "repaired", r6("m", "m"))


@query(" SELECT event_type, seq, round(value - lag(value) OVER (PARTITION BY event_type ORDER BY seq), 6) AS d FROM s")
def diff(s):
    return out(WN.difference(s, KEY, "value", "d"), d="d")


@query(
    f""", b AS (SELECT event_type, seq, value - {_frame('value', 19, 0)} AS d FROM s),
u AS (SELECT *, CASE WHEN lag(d) OVER w < 0 AND d >= 0 THEN seq END AS up FROM b WINDOW w AS (PARTITION BY event_type ORDER BY seq)),
p AS (SELECT *, max(up) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior,
  max(up) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur FROM u),
g AS (SELECT event_type, seq AS at, 100.0::DOUBLE / (seq - prior) AS f FROM p WHERE up IS NOT NULL AND prior IS NOT NULL)
SELECT p.event_type, p.seq, round(coalesce(g.f, 10.0), 6) AS f FROM p LEFT JOIN g ON g.event_type = p.event_type AND g.at = p.cur"""
)
def zero_cross_freq(s):
    return out(WN.crossing_frequency(s, KEY, "value", 10, 100.0, "f"), f="f")


@query(" SELECT event_type, seq, round(sum(value) OVER (PARTITION BY event_type ORDER BY seq) * 2 * pi() / 1000, 5) AS phase FROM s")
def cumulative_phase(s):
    p = WN.cumulative_phase(s, KEY, F.col("value"), 1000.0, "p")
    return p.select(*KEY, "seq", F.round("p", 5).alias("phase"))


_PEAKS = """, p AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM s WINDOW w AS (PARTITION BY event_type ORDER BY seq))"""


@query(f"{_PEAKS} SELECT event_type, seq, value FROM p WHERE value > a AND value >= b")
def peak_candidates(s):
    return WN.peak_candidates(s, KEY, "value").select(*KEY, "seq", "value")


_PROM = f"""{_PEAKS}, q AS (SELECT *, value - greatest({_frame('value', 4, 0, 'min')}, {_frame('value', 0, 4, 'min')}) AS prominence FROM p)"""


@query(f"{_PROM} SELECT event_type, seq, round(prominence, 6) AS prominence FROM q WHERE value > a AND value >= b AND prominence >= 40")
def peak_prominence_filter(s):
    return out(WN.prominent_peaks(s, KEY, "value", 8, 40.0), prominence="prominence")


@query(
    f"""{_PROM}, r AS (SELECT event_type, t, value, row_number() OVER (PARTITION BY event_type ORDER BY seq) AS rank FROM q WHERE value > a AND value >= b AND prominence >= 40),
l AS (SELECT event_type, rank, lag(value, 1) OVER w AS in_h_0, value AS in_h_1, lag(t, 1) OVER w - lag(t, 2) OVER w AS in_dt_0, t - lag(t, 1) OVER w AS in_dt_1,
  lead(value, 1) OVER w AS target_h_0, lead(t, 1) OVER w - t AS target_dt_0 FROM r WINDOW w AS (PARTITION BY event_type ORDER BY rank))
SELECT event_type, CAST(rank AS BIGINT) AS rank, in_h_0, in_h_1, round(in_dt_0, 3) AS in_dt_0, round(in_dt_1, 3) AS in_dt_1, target_h_0, round(target_dt_0, 3) AS target_dt_0
FROM l WHERE in_dt_0 IS NOT NULL AND target_dt_0 IS NOT NULL"""
)
def peak_lag_samples(s):
    p = WN.prominent_peaks(s, KEY, "value", 8, 40.0)
    ranked = number(p, KEY, ["seq"], F.floor(F.col("seq") / 65536), "rank")
    got = WN.lagged_samples(ranked, KEY, "value", "t", 2, 1)
    return got.select(*KEY, "rank", "in_h_0", "in_h_1", F.round("in_dt_0", 3).alias("in_dt_0"), F.round("in_dt_1", 3).alias("in_dt_1"), "target_h_0", F.round("target_dt_0", 3).alias("target_dt_0"))


@query()
def peak_spacing(s):
    return WN.spaced_peaks(WN.peak_candidates(s, KEY, "value").select(*KEY, "seq", "value"), KEY, "value", 12)


def _starts(need: int) -> str:
    return f" , n AS (SELECT event_type, count(*) AS n FROM s GROUP BY event_type) SELECT event_type, unnest(generate_series(0, n - {need}, 7)) AS start FROM n WHERE n >= {need}"


@query(_starts(64 + 2 + 16))
def window_starts_past(s):
    return WN.window_starts(sizes(s, KEY), "n", 64, 16, 7, 2).select(*KEY, "start")


@query(_starts(64))
def window_starts_center(s):
    return WN.window_starts(sizes(s, KEY), "n", 64, 16, 7, mode="center").select(*KEY, "start")


@query(
    f""", c AS (SELECT event_type, seq, sum(value) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS x,
  sum(value) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN 16 FOLLOWING AND 19 FOLLOWING) AS y, count(*) OVER (PARTITION BY event_type) AS n FROM s)
SELECT event_type, seq - 1 AS start, round(x, 6) AS x, round(y, 6) AS y FROM c WHERE (seq - 1) % 8 = 0 AND seq + 19 <= n"""
)
def window_sums(s):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v), 6)
    return WN.window_arrays(s, KEY, "value", 16, 4, 8).select(*KEY, "start", total("x").alias("x"), total("y").alias("y"))


@query(
    """, e AS (SELECT event_type, seq, value AS e0, lead(value, 3) OVER w AS e1, lead(value, 6) OVER w AS e2, lead(seq, 8) OVER w AS last FROM s WINDOW w AS (PARTITION BY event_type ORDER BY seq))
SELECT event_type, seq, e0, e1, e2 FROM e WHERE last IS NOT NULL"""
)
def delay_embedding(s):
    e = F.col("embedding")
    return WN.delay_embedding(s, KEY, "value", 3, 3, 2).select(*KEY, "seq", e[0].alias("e0"), e[1].alias("e1"), e[2].alias("e2"))


@query(" SELECT event_type, seq, value FROM s WHERE (seq - 1) % 13 = 0")
def downsample_every_k(s):
    return s.where((F.col("seq") - 1) % 13 == 0).select(*KEY, "seq", "value")


# Aggregates ------------------------------------------------------------------------------------------------------


@query(
    """ SELECT event_type, count(*) AS n_rows, count(gappy) AS finite_rows, round(avg(gappy), 6) AS mean, round(stddev_pop(gappy), 6) AS std, min(gappy) AS min, max(gappy) AS max,
  round(count(gappy) / count(*)::DOUBLE, 6) AS finite_ratio, round(median(gappy), 6) AS median FROM s GROUP BY event_type"""
)
def finite_stats(s):
    f = A.finite_stats(s, KEY, "gappy")
    return f.select(*KEY, "n_rows", "finite_rows", r6("mean", "mean"), r6("std", "std"), "min", "max", r6("finite_ratio", "finite_ratio"), r6("median", "median"))


@query(" SELECT event_type, round(quantile_cont(value, 0.01), 6) AS q01, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM s GROUP BY event_type")
def exact_quantiles(s):
    from tidewright.operators.ordered import quantiles

    q = quantiles(s, KEY, "value", {"q01": 0.01, "q50": 0.5, "q95": 0.95})
    return q.select(*KEY, *[r6(c, c) for c in ("q01", "q50", "q95")])


_MAD = """, m AS (SELECT event_type, median(value) AS med FROM s GROUP BY event_type),
d AS (SELECT event_type, any_value(med) AS med, 1.4826 * median(abs(value - med)) AS scale FROM s JOIN m USING (event_type) GROUP BY event_type)"""


@query(
    f"""{_MAD}, b AS (SELECT event_type, greatest(quantile_cont(value, 0.02), any_value(med) - 3 * any_value(scale)) AS lo, least(quantile_cont(value, 0.98), any_value(med) + 3 * any_value(scale)) AS hi
  FROM s JOIN d USING (event_type) GROUP BY event_type)
SELECT event_type, seq, round(greatest(least(value, hi), lo), 6) AS m, greatest(least(value, hi), lo) <> value AS clipped FROM s JOIN b USING (event_type)"""
)
def quantile_clip(s):
    return A.quantile_clip(s, KEY, "value", 0.02, 0.98, 3.0, "m").select(*KEY, "seq", r6("m", "m"), "clipped")


@query(f"{_MAD} SELECT event_type, seq, round((value - med) / scale, 6) AS z FROM s JOIN d USING (event_type)")
def robust_zscore(s):
    return out(A.robust_zscore(s, KEY, "value", "z"), z="z")


@query(
    """, d AS (SELECT event_type, t - lag(t) OVER (PARTITION BY event_type ORDER BY seq) AS dt FROM s)
SELECT event_type, round(1 / median(dt), 6) AS fs FROM d WHERE dt > 0 GROUP BY event_type"""
)
def sample_rate(s):
    return A.sample_rate(s, KEY, "t").select(*KEY, r6("fs", "fs"))


@query(
    """, f AS (SELECT user_id % 7 AS kind, event_type, count(*) AS n, avg(value) AS mean FROM s GROUP BY user_id % 7, event_type)
SELECT kind, count(*) AS segments, round(median(n), 6) AS median_n, round(median(mean), 6) AS median_mean FROM f GROUP BY kind"""
)
def type_summary(s):
    f = s.groupBy((F.col("user_id") % 7).alias("kind"), "event_type").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"))
    t = A.type_summary(f, ["kind"], ["n", "mean"])
    return t.select("kind", "segments", r6("median_n", "median_n"), r6("median_mean", "median_mean"))


@query(
    """, c AS (SELECT event_type, user_id, count(*) AS n, min(seq) AS first FROM s GROUP BY event_type, user_id),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, first) AS k FROM c) SELECT event_type, user_id AS top FROM r WHERE k = 1"""
)
def mode_with_ties(s):
    return A.mode(s, KEY, "user_id", "seq", "top")


@query(
    """, m AS (SELECT event_type, avg(value) AS mu, stddev_pop(value) AS std FROM s GROUP BY event_type)
SELECT event_type, round(any_value(std), 6) AS std, round(avg(pow((value - mu) / std, 3)), 6) AS skew, round(avg(pow((value - mu) / std, 4)), 6) AS kurtosis FROM s JOIN m USING (event_type) GROUP BY event_type"""
)
def moments(s):
    m = A.moments(s, KEY, "value")
    return m.select(*KEY, r6("std", "std"), r6("skew", "skew"), r6("kurtosis", "kurtosis"))


@query(
    """, c AS (SELECT (seq - 1) // 50 AS win, event_type, max(value) - min(value) AS ptp, sum(value * value) AS sq, count(*) AS n, max(abs(value)) AS top FROM s GROUP BY (seq - 1) // 50, event_type),
w AS (SELECT win, avg(ptp) AS ptp_mean, max(ptp) AS ptp_max, sqrt(sum(sq) / sum(n)) AS rms, max(top) AS max_abs FROM c GROUP BY win)
SELECT win, round(ptp_mean, 6) AS ptp_mean, round(ptp_max, 6) AS ptp_max, round(rms, 6) AS rms, max_abs, round(max_abs / rms, 6) AS crest FROM w"""
)
def ptp_crest(s):
    w = A.window_shape(s.withColumn("win", F.floor((F.col("seq") - 1) / 50)), ["win"], "event_type", "value")
    return w.select("win", r6("ptp_mean", "ptp_mean"), r6("ptp_max", "ptp_max"), r6("rms", "rms"), "max_abs", r6("crest", "crest"))


@query(
    """ SELECT event_type, round(corr(value, seq), 6) AS pearson, round(covar_pop(value, user_id), 5) AS covariance, round(regr_slope(value, seq), 6) AS slope, round(regr_intercept(value, seq), 6) AS intercept
FROM s GROUP BY event_type"""
)
def linear_relations(s):
    s = s.withColumn("x", F.col("seq").cast("double"))
    fit = A.line_fit(s, KEY, "x", "value")
    rel = s.groupBy(*KEY).agg(r6(A.pearson("value", "x"), "pearson"), F.round(F.covar_pop("value", "user_id"), 5).alias("covariance"))
    return rel.join(fit, KEY).select(*KEY, "pearson", "covariance", r6("slope", "slope"), r6("intercept", "intercept"))


_FCAST = """, f AS (SELECT event_type, value AS y, lag(value, 2) OVER w AS naive, avg(value) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN 8 PRECEDING AND 2 PRECEDING) AS p FROM s
  WINDOW w AS (PARTITION BY event_type ORDER BY seq)), g AS (SELECT * FROM f WHERE naive IS NOT NULL)"""


def _forecasts(s):
    from tidewright.operators.ordered import framed

    build = lambda w: {"naive": F.lag("value", 2).over(w), "p": F.avg("value").over(w.rowsBetween(-8, -2))}
    return framed(s, KEY, 8, 0, build).where("naive IS NOT NULL").withColumnRenamed("value", "y")


@query(
    f"""{_FCAST} SELECT event_type, round(avg((p - y) * (p - y)), 6) AS mse, round(avg(abs(p - y)), 6) AS mae, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
  round(sqrt(avg((p - y) * (p - y))) / stddev_pop(y), 6) AS nrmse, round(1 - sqrt(avg((p - y) * (p - y))) / sqrt(avg((naive - y) * (naive - y))), 6) AS skill FROM g GROUP BY event_type"""
)
def forecast_errors(s):
    e = A.forecast_errors(_forecasts(s), KEY, "y", "p", "naive")
    return e.select(*KEY, *[r6(c, c) for c in ("mse", "mae", "rmse", "nrmse", "skill")])


@query(
    f"""{_FCAST} SELECT event_type, round(avg(CASE WHEN abs(p - y) < 10 THEN 0.05 * (p - y) * (p - y) ELSE abs(p - y) - 5 END), 6) AS huber,
  round(avg((1 + 0.5 * abs(y)) * (p - y) * (p - y)), 4) AS weighted_mse FROM g GROUP BY event_type"""
)
def huber_and_weighted(s):
    e = FC.losses(_forecasts(s), KEY, "p", "y", beta=10.0, alpha=0.5)
    return e.select(*KEY, r6("huber", "huber"), F.round("weighted_mse", 4).alias("weighted_mse"))


@query(
    """, h AS (SELECT event_type, seq, value < 150 AS ok FROM s)
SELECT event_type, coalesce(min(CASE WHEN NOT ok THEN seq END) - 1, max(seq)) AS horizon FROM h GROUP BY event_type"""
)
def prefix_horizon(s):
    return A.prefix_horizon(s, KEY, "seq", F.col("value") < 150, "horizon")


_WIDE = ", w AS (SELECT seq, max(CASE WHEN event_type = 'click' THEN value END) AS c0, max(CASE WHEN event_type = 'view' THEN value END) AS c1, max(CASE WHEN event_type = 'error' THEN value END) AS c2 FROM s GROUP BY seq), v AS (SELECT * FROM w WHERE c0 IS NOT NULL AND c1 IS NOT NULL AND c2 IS NOT NULL)"


def _wide(s):
    pick = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    return s.groupBy("seq").agg(pick("click").alias("c0"), pick("view").alias("c1"), pick("error").alias("c2")).dropna()


@query(
    f"""{_WIDE}, a AS (SELECT seq, c0 + c1 + c2 AS total, CASE WHEN c0 >= 50 THEN c0 ELSE 0 END + CASE WHEN c1 >= 50 THEN c1 ELSE 0 END + CASE WHEN c2 >= 50 THEN c2 ELSE 0 END AS active,
  CAST(c0 >= 50 AS INT) + CAST(c1 >= 50 AS INT) + CAST(c2 >= 50 AS INT) AS k FROM v)
SELECT seq, round(total, 6) AS q_sum, round(total / 3, 6) AS q_mean, round(active, 6) AS q_active_sum, round(CASE WHEN k > 0 THEN active / k ELSE 0 END, 6) AS q_active_mean FROM a"""
)
def active_mean(s):
    a = A.active_reduce(_wide(s), ["seq"], ["c0", "c1", "c2"], F.lit(50.0), "q")
    return a.select("seq", *[r6(c, c) for c in ("q_sum", "q_mean", "q_active_sum", "q_active_mean")])


@query(f"{_WIDE} SELECT seq, 'c' || k AS channel, CASE k WHEN 0 THEN c0 WHEN 1 THEN c1 ELSE c2 END AS raw, 'rig_c' || k AS segment_id FROM v, (SELECT unnest([0, 1, 2]) AS k)")
def unpivot_channels(s):
    from tidewright.sources.readers import unpivot_channels as unpivot

    return unpivot(_wide(s), ["seq"], "c", "rig")


# Scalars, splits and scaling -------------------------------------------------------------------------------------


@query(
    """ SELECT event_type, seq, round(sign(value - 60) * ln(1 + abs(value - 60)), 6) AS slog, round(greatest(least(value, 90), 20), 6) AS clipped, round(0.5 + 2 * greatest(value - 60, 0), 6) AS weight,
  greatest(round_even(value / 4, 0) * 4, 8) AS quantum, round(sin(2 * pi() * (seq - 1) / 26.3::DOUBLE), 6) AS phase_sin FROM s"""
)
def scalar_functions(s):
    d = F.col("value") - 60
    return s.select(
        *KEY, "seq", r6(C.signed_log1p(d), "slog"), r6(C.clip("value", 20, 90), "clipped"), r6(C.weight(d, 0.5, 2.0), "weight"), C.round_to("value", 4, 8).alias("quantum"), r6(C.cycle_phase("seq", 26.3)[0], "phase_sin")
    )


@query(
    """ SELECT event_id, CASE WHEN x = '' THEN 'item' ELSE x END AS name, substr(md5(event_type || ',' || user_id), 1, 8) AS signature
FROM (SELECT *, trim(regexp_replace(props || event_type, '[^A-Za-z0-9_.-]+', '_', 'g'), '_') AS x FROM events)""",
    source=None,
)
def name_functions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", C.safe_name(F.concat("props", "event_type")).alias("name"), C.signature(F.array("event_type", F.col("user_id").cast("string"))).alias("signature"))


_PARTS = """, f AS (SELECT event_type, user_id, avg(value) AS m, stddev_pop(value) AS sd, count(*) AS n FROM s GROUP BY event_type, user_id),
p AS (SELECT event_type, user_id, m / 200 AS energy, sd / 150 AS entropy, (n % 10) / 10.0::DOUBLE AS acf, (n % 7) / 7.0::DOUBLE AS resid, n % 5 AS multi,
  CASE WHEN n % 3 = 0 THEN NULL ELSE (n % 11) / 11.0::DOUBLE END AS cv, (n % 4) * 0.9::DOUBLE AS prom, (n % 6) / 8.0::DOUBLE AS env FROM f)"""


def _parts(s):
    f = s.groupBy("event_type", "user_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))
    n = F.col("n")
    return f.select(
        "event_type", "user_id", (F.col("m") / 200).alias("dominant_energy_ratio"), (F.col("sd") / 150).alias("spectral_entropy"), (n % 10 / 10).alias("acf_peak"), (n % 7 / 7).alias("residual_energy_ratio"),
        (n % 5).alias("multi_peak_count"), F.when(n % 3 == 0, None).otherwise(n % 11 / 11).alias("peak_interval_cv"), (n % 4 * 0.9).alias("peak_prominence_ratio"), (n % 6 / 8).alias("envelope_cv"),
    )


@query(
    f"""{_PARTS} SELECT event_type, user_id, CASE WHEN energy < 0.08 AND acf < 0.2 THEN 'weak_periodic' WHEN prom >= 2.5 AND coalesce(cv, 999) <= 0.5 THEN 'spike_event' WHEN multi >= 3 AND entropy >= 0.45 THEN 'multi_freq'
  WHEN coalesce(cv, 999) >= 0.2 OR env >= 0.45 THEN 'am_fm_modulated' WHEN resid >= 0.35 OR entropy >= 0.55 THEN 'noisy_single_freq' ELSE 'stable_single_freq' END AS signal_type FROM p"""
)
def classify_signal(s):
    from tidewright.plans.profile import classified

    return _parts(s).select("event_type", "user_id", classified().alias("signal_type"))


@query(f"{_PARTS} SELECT event_type, user_id, round(greatest(least(0.35 * energy + 0.35 * greatest(acf, 0) + 0.15 * (1 - entropy) + 0.15 * (1 - least(resid, 1)), 1), 0), 6) AS score FROM p")
def predictability_score(s):
    c = F.col
    return _parts(s).select("event_type", "user_id", r6(C.predictability_score(c("dominant_energy_ratio"), c("acf_peak"), c("spectral_entropy"), c("residual_energy_ratio")), "score"))


_N = ", n AS (SELECT event_type, seq, count(*) OVER (PARTITION BY event_type) AS n FROM s)"


@query(f"{_N} SELECT event_type, seq, CASE WHEN seq <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN seq <= floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM n")
def split_total(s):
    return X.split_segments(s, KEY, 0.7, 0.1).select(*KEY, "seq", "split")


@query(f"{_N}, m AS (SELECT *, floor(n * 0.7::DOUBLE) AS a FROM n) SELECT event_type, seq, CASE WHEN seq <= a THEN 'train' WHEN seq <= a + floor((n - a) * 0.4::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM m")
def split_legacy(s):
    return X.split_segments(s, KEY, 0.7, 0.4, "legacy_rest").select(*KEY, "seq", "split")


@query(
    f"{_N} SELECT event_type, seq, CASE WHEN seq <= floor(n * 0.3::DOUBLE) THEN 'train' WHEN seq <= floor(n * (0.3::DOUBLE + 0.1::DOUBLE)) THEN 'val' WHEN seq <= floor(n * 0.6::DOUBLE) THEN 'ignore' ELSE 'test' END AS split FROM n"
)
def split_adapt(s):
    n = s.join(sizes(s, KEY), KEY)
    return n.select(*KEY, "seq", X.adapted(F.col("seq"), F.col("n"), 0.3, 0.1, 0.6).alias("split"))


@query(
    """, u AS (SELECT DISTINCT user_id FROM s), k AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS r, count(*) OVER () AS n FROM u)
SELECT user_id, CASE WHEN r <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN r <= floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM k"""
)
def split_by_record(s):
    return X.split_records(s.select("user_id").distinct(), ["user_id"], 0.7, 0.1)


@query(
    f"""{_WIDE}, p AS (SELECT avg(c0) AS m0, stddev_pop(c0) AS s0, avg(c1) AS m1, stddev_pop(c1) AS s1 FROM v WHERE seq <= 1000)
SELECT seq, round((c0 - m0) / s0, 6) AS c0, round((c1 - m1) / s1, 6) AS c1 FROM v, p"""
)
def scale_channel(s):
    w = _wide(s)
    return X.scale(w, X.fit_channel_scaler(w.where("seq <= 1000"), ["c0", "c1"]), ["c0", "c1"]).select("seq", r6("c0", "c0"), r6("c1", "c1"))


@query(
    f"""{_WIDE}, a AS (SELECT c0 AS x FROM v WHERE seq <= 1000 UNION ALL SELECT c1 FROM v WHERE seq <= 1000), p AS (SELECT avg(x) AS m, stddev_pop(x) + 1e-8 AS sd FROM a)
SELECT seq, round((c0 - m) / sd, 6) AS c0, round((c1 - m) / sd, 6) AS c1 FROM v, p"""
)
def scale_global(s):
    w = _wide(s)
    return X.scale(w, X.fit_global_scaler(w.where("seq <= 1000"), ["c0", "c1"]), ["c0", "c1"]).select("seq", r6("c0", "c0"), r6("c1", "c1"))


@query(" SELECT event_type, sum(CASE WHEN seq <= 100 THEN 1 ELSE 0 END)::BIGINT AS train_rows, sum(CASE WHEN seq > 100 AND seq <= 150 THEN 1 ELSE 0 END)::BIGINT AS val_rows, sum(CASE WHEN seq > 150 THEN 1 ELSE 0 END)::BIGINT AS test_rows FROM s GROUP BY event_type")
def split_counts(s):
    return A.split_counts(s.withColumn("split", F.when(F.col("seq") <= 100, "Train").when(F.col("seq") <= 150, "VAL").otherwise("test")), KEY)


# Joins and sets --------------------------------------------------------------------------------------------------


@query(
    """, d AS (SELECT user_id, min(seq) AS first FROM s WHERE event_type = 'purchase' GROUP BY user_id), t AS (SELECT user_id, CASE WHEN first % 2 = 0 THEN 'even' ELSE 'odd' END AS kind FROM d WHERE first % 5 <> 0)
SELECT event_id, coalesce(kind, 'unknown') AS kind FROM s LEFT JOIN t USING (user_id)"""
)
def map_type_left(s):
    d = s.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("seq").alias("first")).where("first % 5 <> 0")
    dim = d.withColumn("kind", F.when(F.col("first") % 2 == 0, "even").otherwise("odd"))
    return J.map_first(s, dim, "user_id", "kind", "first").select("event_id", "kind")


@query(" SELECT event_id FROM s WHERE user_id IN (SELECT user_id FROM s WHERE value > 400)")
def semi_subset(s):
    return J.subset(s, s.where("value > 400").select("user_id").distinct(), "user_id").select("event_id")


@query(
    """, p AS (SELECT user_id, avg(value) AS level FROM s WHERE value > 100 GROUP BY user_id HAVING count(*) > 10), g AS (SELECT median(level) AS level FROM p)
SELECT event_id, round(coalesce(p.level, g.level), 6) AS level FROM s LEFT JOIN p USING (user_id), g"""
)
def profile_fallback(s):
    from tidewright.operators.ordered import quantiles

    p = s.where("value > 100").groupBy("user_id").agg(F.avg("value").alias("level"), F.count("*").alias("n")).where("n > 10").drop("n")
    return J.with_fallback(s.select("event_id", "user_id"), p, "user_id", ["level"], quantiles(p, [], "level", {"level": 0.5})).select("event_id", r6("level", "level"))


@query(
    """, e AS (SELECT event_type, seq - 1 AS i, value AS a, lead(value, 2) OVER (PARTITION BY event_type ORDER BY seq) AS b FROM s), v AS (SELECT * FROM e WHERE b IS NOT NULL),
d AS (SELECT r.event_type, r.i AS start, min({'d2': (r.a - c.a) * (r.a - c.a) + (r.b - c.b) * (r.b - c.b), 'j': c.i}) AS n FROM v r JOIN v c ON r.event_type = c.event_type AND abs(r.i - c.i) > 5 GROUP BY r.event_type, r.i)
SELECT event_type, start, n.j AS neighbour, round(n.d2, 6) AS d2 FROM d"""
)
def nn_theiler(s):
    points = WN.delay_embedding(s, KEY, "value", 2, 2).select(*KEY, (F.col("seq") - 1).alias("start"), "embedding")
    return J.nearest_neighbours(points, points, 5, keys=KEY).select(*KEY, "start", "neighbour", r6("d2", "d2"))


@query(
    """, h AS (SELECT a.event_type, b.seq - a.seq AS horizon, b.value - a.value AS e FROM s a JOIN s b ON a.event_type = b.event_type AND b.seq > a.seq AND b.seq <= a.seq + 12)
SELECT event_type, horizon, round(sqrt(avg(e * e)), 6) AS rmse, count(*) AS n FROM h GROUP BY event_type, horizon"""
)
def shifted_horizons(s):
    h = J.shifted(s, KEY, "value", 12)
    e = F.col("future") - F.col("value")
    return h.groupBy(*KEY, F.col("horizon").cast("long").alias("horizon")).agg(r6(F.sqrt(F.avg(e * e)), "rmse"), F.count("*").alias("n"))


@query(
    """, n AS (SELECT event_type, max(seq) AS n FROM s GROUP BY event_type), g AS (SELECT event_type, unnest(generate_series(0, CAST(floor((n - 1) / 100.0::DOUBLE * 64) AS BIGINT))) AS j FROM n),
p AS (SELECT event_type, j, j * (100.0::DOUBLE / 64) AS x FROM g)
SELECT p.event_type, j, round(a.value + coalesce((b.value - a.value) * (x - floor(x)), 0), 6) AS value FROM p JOIN s a ON a.event_type = p.event_type AND a.seq = floor(x) + 1
LEFT JOIN s b ON b.event_type = p.event_type AND b.seq = floor(x) + 2"""
)
def resample_linear(s):
    return J.resample(s, KEY, "value", 100.0, 64.0).select(*KEY, "j", r6("value", "value"))


@query(
    """, r AS (SELECT event_type, seq AS label, t AS lo, t + 5000 AS hi FROM s WHERE seq % 40 = 1)
SELECT s.event_id, r.label FROM s JOIN r ON s.event_type = r.event_type AND s.t >= r.lo AND s.t <= r.hi"""
)
def range_label_join(s):
    ranges = s.where("seq % 40 = 1").select(*KEY, F.col("seq").alias("label"), F.col("t").alias("lo"), (F.col("t") + 5000).alias("hi"))
    return J.label_ranges(s, ranges, KEY, "t", "lo", "hi", "label", 5000.0).select("event_id", "label")


@query(
    """, a AS (SELECT event_type, seq FROM s WHERE event_id % 7 = 0), b AS (SELECT event_type, seq FROM s WHERE event_id % 11 = 0)
SELECT a.event_type, a.seq, min(abs(a.seq - b.seq)) AS nearest FROM a LEFT JOIN b USING (event_type) GROUP BY a.event_type, a.seq""".replace("LEFT JOIN b USING (event_type)", "LEFT JOIN b ON a.event_type = b.event_type")
)
def nearest_peak(s):
    return J.nearest_in_order(s.where("event_id % 7 = 0"), s.where("event_id % 11 = 0"), KEY, "seq")


@query(
    """ SELECT 'a_' || event_type AS segment_id, seq, value FROM s WHERE value < 60 UNION ALL SELECT 'b_' || event_type, seq, value FROM s WHERE value >= 60"""
)
def union_segments(s):
    t = s.select(F.col("event_type").alias("segment_id"), "seq", "value")
    return J.union_segments({"a": t.where("value < 60"), "b": t.where("value >= 60")})


@query(", k AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY seq) AS n FROM s) SELECT event_type, user_id, seq, value FROM k WHERE n = 1")
def dedup_first(s):
    return J.first_per_key(s.select(*KEY, "user_id", "seq", "value"), [*KEY, "user_id"], "seq")


#: The embeddings in SQL, one row for each vector and dimension.
VECTORS = "WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS e, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(e) AS ce FROM x GROUP BY label, i)"
DIMENSIONS = [f"e{i}" for i in range(64)]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and the 64 dimensions of the embeddings as columns."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(DIMENSIONS)])


@query(
    f"""{VECTORS}, d AS (SELECT vec_id, label, sqrt(sum((e - ce) * (e - ce))) AS distance FROM x JOIN c USING (label, i) GROUP BY vec_id, label),
k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM d) SELECT vec_id, label, round(distance, 5) AS distance, CAST(rank AS INT) AS rank FROM k WHERE rank <= 5""",
    source=vectors,
)
def topk_nearest(e):
    from tidewright.operators.clusters import nearest_examples

    return nearest_examples(e, DIMENSIONS, "label", "vec_id", 5).select("vec_id", "label", F.round("distance", 5).alias("distance"), "rank")


_METRICS = """WITH m AS (SELECT o_orderkey AS run, o_totalprice / 1000 AS mse, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey % 100) / 100.0::DOUBLE END AS pearson FROM orders),
a AS (SELECT o_orderkey AS run, o_orderpriority AS model, o_orderkey % 300 AS pred_len FROM orders WHERE o_orderstatus <> 'F')"""


@query(
    f"""{_METRICS}, j AS (SELECT m.*, model, pred_len FROM m LEFT JOIN a USING (run) WHERE coalesce(pearson, -1e308) >= 0.2 AND mse <= 400), b AS (SELECT run FROM j ORDER BY mse, run LIMIT 1)
SELECT run, round(mse, 6) AS mse, model, run IN (SELECT run FROM b) AS best FROM j""",
    source=None,
)
def best_run(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    n = F.col("o_orderkey")
    m = o.select(n.alias("run"), (F.col("o_totalprice") / 1000).alias("mse"), F.when(n % 9 == 0, None).otherwise(n % 100 / 100).alias("pearson"))
    a = o.where("o_orderstatus <> 'F'").select(n.alias("run"), F.col("o_orderpriority").alias("model"), (n % 300).alias("pred_len"))
    return FC.best_run(m, a, "run", 0.2, 400.0).select("run", r6("mse", "mse"), "model", "best")


# Dynamics and forecasts ------------------------------------------------------------------------------------------

_ACF = """, c AS (SELECT event_type, seq, value - avg(value) OVER (PARTITION BY event_type) AS y FROM s),
l AS (SELECT a.event_type, b.seq - a.seq AS lag, sum(a.y * b.y) AS p FROM c a JOIN c b ON a.event_type = b.event_type AND b.seq >= a.seq AND b.seq <= a.seq + 30 GROUP BY a.event_type, b.seq - a.seq),
f AS (SELECT l.event_type, l.lag, l.p / z.p AS acf FROM l JOIN l z ON l.event_type = z.event_type AND z.lag = 0)"""


@query(f"{_ACF} SELECT event_type, lag, round(acf, 6) AS acf FROM f")
def acf_lags(s):
    return D.acf(s, "value", 30, tuple(KEY)).select(*KEY, F.col("lag").cast("long").alias("lag"), r6("acf", "acf"))


@query(f"{_ACF} SELECT event_type, coalesce(min(CASE WHEN lag >= 1 AND acf <= exp(-1) THEN lag END), min(CASE WHEN lag >= 1 AND acf <= 0 THEN lag END), 6) AS tau FROM f GROUP BY event_type")
def choose_delay(s):
    return D.choose_delay(D.acf(s, "value", 30, tuple(KEY)), 24.0, tuple(KEY)).select(*KEY, F.col("tau").cast("long").alias("tau"))


@query(
    """, x AS (SELECT event_type AS g, seq - 1 AS i, value AS v FROM s), n AS (SELECT g, count(*) AS n FROM x GROUP BY g),
e AS (SELECT a.g, a.i, a.v AS p, b.v AS q FROM x a JOIN x b ON a.g = b.g AND b.i = a.i + 2 JOIN n ON n.g = a.g WHERE a.i + 2 + 6 < n.n),
d AS (SELECT r.g, r.i, min({'d2': (r.p - c.p) * (r.p - c.p) + (r.q - c.q) * (r.q - c.q), 'j': c.i}).j AS j FROM e r JOIN e c ON r.g = c.g AND abs(r.i - c.i) > 4 GROUP BY r.g, r.i),
h AS (SELECT g, i, j, unnest([1, 2, 3, 4, 5, 6]) AS horizon FROM d),
y AS (SELECT h.g, horizon, b.v - a.v AS err, z.v - a.v AS naive FROM h JOIN x a ON a.g = h.g AND a.i = h.i + 2 + horizon JOIN x b ON b.g = h.g AND b.i = h.j + 2 + horizon JOIN x z ON z.g = h.g AND z.i = h.i + 2)
SELECT g AS event_type, CAST(horizon AS INT) AS horizon, round(sqrt(avg(err * err)), 6) AS rmse, round(sqrt(avg(naive * naive)), 6) AS persistence_rmse, round(1 - sqrt(avg(err * err)) / sqrt(avg(naive * naive)), 6) AS skill FROM y GROUP BY g, horizon"""
)
def analog_curve(s):
    c = D.analog_curve(s, "value", 2, 2, 6, 4, 0, 0, keys=tuple(KEY))
    return c.select(*KEY, "horizon", *[r6(n, n) for n in ("rmse", "persistence_rmse", "skill")])


_WIN = ", w AS (SELECT event_type, seq - 1 AS start, list(value) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS x, count(*) OVER (PARTITION BY event_type) AS n FROM s), v AS (SELECT * FROM w WHERE start % 16 = 0 AND start + 40 <= n)"


def _windows(s):
    return WN.window_arrays(s, KEY, "value", 32, 8, 16)


@query(f"{_WIN} SELECT event_type, start, k, round((x[25 + (k - 1) % 8] + x[17 + (k - 1) % 8]) / 2, 6) AS p FROM v, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS k)")
def cycle_template(s):
    w = _windows(s).withColumn("p", FC.cycle_template(F.col("x"), 32, 8, 8, 2))
    return w.select(*KEY, "start", F.posexplode("p").alias("k", "p")).select(*KEY, "start", (F.col("k") + 1).alias("k"), r6("p", "p"))


@query(f"{_WIN} SELECT event_type, start, k, x[32] AS p FROM v, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS k)")
def persistence(s):
    w = _windows(s).withColumn("p", FC.persistence(F.col("x"), 8))
    return w.select(*KEY, "start", F.posexplode("p").alias("k", "p")).select(*KEY, "start", (F.col("k") + 1).alias("k"), "p")


@query(
    f"""{_WIN}, u AS (SELECT event_type, start, x, unnest(x) AS e FROM v), g AS (SELECT event_type, start, avg(e) AS mu, stddev_pop(e) AS sp, stddev_samp(e) AS ss, any_value(x) AS x FROM u GROUP BY event_type, start)
SELECT event_type, start, round((x[1] - mu) / (ss + 1e-5), 6) AS first_unbiased, round((x[1] - mu) / sqrt(sp * sp + 1e-5), 6) AS first_biased FROM g"""
)
def revin_window(s):
    both = FC.instance_norm(FC.instance_norm(_windows(s), "x", True, name="u"), "x", False, name="b")
    return both.select(*KEY, "start", r6(F.col("u")[0], "first_unbiased"), r6(F.col("b")[0], "first_biased"))


@query(
    f"""{_WIN}, t AS (SELECT v.event_type, v.start, v.x[32] AS last, s.value AS y FROM v JOIN s ON s.event_type = v.event_type AND s.seq > v.start + 32 AND s.seq <= v.start + 40),
m AS (SELECT event_type, start, avg((last - y) * (last - y)) AS e FROM t GROUP BY event_type, start) SELECT event_type, round(avg(e), 6) AS mse, count(*) AS windows FROM m GROUP BY event_type"""
)
def window_mse(s):
    w = _windows(s).withColumn("pred", FC.persistence(F.col("x"), 8))
    return FC.window_mse(w, KEY).select(*KEY, r6("mse", "mse"), "windows")


@query(
    f""", m AS (SELECT event_type, seq, value, {_frame('value', 2, 3)} AS m FROM s)
SELECT event_type, count(*) AS n, round(var_pop(value - m) / var_pop(value), 6) AS residual_ratio FROM m GROUP BY event_type"""
)
def segment_energy(s):
    m = WN.frame_mean(s, KEY, F.col("value"), 6, "B", "m")
    return m.groupBy(*KEY).agg(F.count("*").alias("n"), r6(F.var_pop(F.col("value") - F.col("m")) / F.var_pop("value"), "residual_ratio"))


@query(
    f""", b AS (SELECT event_type, seq, value, {_frame('value', 8, 0)} AS m, {_frame('value', 4, 4)} AS c FROM s)
SELECT event_type, seq, round(m, 6) AS qp_main_input, round(c, 6) AS qp_main_target, round(value - m, 6) AS qp_residual, round(abs(value - m), 6) AS qp_abs_residual FROM b"""
)
def augment_main(s):
    from tidewright.plans.augment import main_residual

    names = ("qp_main_input", "qp_main_target", "qp_residual", "qp_abs_residual")
    return out(main_residual(s, KEY, "value", 9), **{n: n for n in names})


# More reshaping, scaling and reports -------------------------------------------------------------------------------


@query(" SELECT event_type, seq FROM s WHERE seq - 1 >= 5 AND seq - 1 < 27")
def seconds_crop(s):
    # at 10 Hz 0.51 s is row 5, and 2.25 s are 22 rows (halves to even)
    return s.where(C.seconds_range("seq", 10.0, 0.51, None, 2.25)).select(*KEY, "seq")


@query(
    """, n AS (SELECT event_type, count(*) AS n FROM s GROUP BY event_type), k AS (SELECT event_type, n, unnest(generate_series(0, 24)) AS k FROM n),
p AS (SELECT DISTINCT event_type, CASE WHEN k = 24 THEN n - 1 ELSE CAST(floor(k * ((n - 1) / 24.0::DOUBLE)) AS BIGINT) END AS i FROM k WHERE n > 25)
SELECT p.event_type, i + 1 AS seq FROM p"""
)
def evenly_spaced(s):
    n = s.join(sizes(s, KEY), KEY)
    return n.where(J.subsample(F.col("n"), F.col("seq") - 1, 25)).select(*KEY, "seq")


@query(
    f"""{_WIN}, u AS (SELECT event_type, start, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS k, x FROM v), f AS (SELECT event_type, start + 32 + k AS target, x[24 + k] AS p FROM u)
SELECT event_type, target - 1 AS target, round(avg(p), 6) AS mean, count(*) AS n FROM f GROUP BY event_type, target"""
)
def overlap_average(s):
    w = _windows(s).withColumn("p", F.slice("x", 25, 8)).withColumn("first", F.col("start") + 32)
    return J.overlap_average(w, KEY, "first", "p").select(*KEY, "target", r6("mean", "mean"), "n")


@query(
    f"""{_WIDE}, p AS (SELECT avg(c0) AS m, stddev_pop(c0) AS sd FROM v WHERE seq <= 800), q AS (SELECT quantile_cont(abs(c0 - m), 0.95) AS q95, quantile_cont(abs(c0), 0.9) AS act FROM v, p WHERE seq <= 800)
SELECT seq, round((c0 - m) / sd, 6) AS z, round(sqrt(greatest(least(abs(c0 - m) / q95, 1), 0)), 6) AS weight, abs(c0) >= act AS active FROM v, p, q"""
)
def target_weights(s):
    from tidewright.operators.ordered import quantiles

    w = _wide(s).withColumn("split", F.when(F.col("seq") <= 800, "train").otherwise("test"))
    train = w.where("split = 'train'")
    mean = train.agg(F.avg("c0").alias("m"))
    spread = train.crossJoin(F.broadcast(mean)).withColumn("d", F.abs(F.col("c0") - F.col("m"))).withColumn("a", F.abs("c0"))
    limits = quantiles(spread, [], "d", {"q95": 0.95}).crossJoin(F.broadcast(quantiles(spread, [], "a", {"act": 0.9})))
    z = X.standardised_target(w.withColumn("raw", F.col("c0")), ["c0"]).crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(limits))
    weight = F.sqrt(C.clip(F.abs(F.col("raw") - F.col("m")) / F.col("q95"), 0.0, 1.0))
    return z.select("seq", r6("c0", "z"), r6(weight, "weight"), (F.abs("raw") >= F.col("act")).alias("active"))


@query(
    """, k AS (SELECT DISTINCT event_type FROM s), c AS (SELECT * FROM (VALUES ('/data/click.csv', 1.0, 2.0), ('view.csv', 3.0, 4.0), ('error', 5.0, 6.0), ('click', 9.0, 9.0)) AS t(name, a, b))
SELECT event_type, CAST(coalesce(x.a, y.a, z.a) AS DOUBLE) AS time_start, CAST(coalesce(x.b, y.b, z.b) AS DOUBLE) AS time_end FROM k LEFT JOIN c x ON x.name = '/data/' || event_type || '.csv'
LEFT JOIN c y ON y.name = event_type || '.csv' LEFT JOIN c z ON z.name = event_type"""
)
def resolve_windows(s):
    from tidewright.sources import readers

    text = '{"windows": {"/data/click.csv": {"time_start": 1, "time_end": 2}, "view.csv": [3, 4], "error": [5, 6], "click": [9, 9]}}'
    files = s.select(*KEY, F.concat(F.lit("/data/"), "event_type", F.lit(".csv")).alias("path")).distinct()
    return readers.resolve_windows(files, readers.window_configs(s.sparkSession, text)).drop("path")


@query(
    """, d AS (SELECT event_type, seq, lead(t) OVER w - t AS dt FROM s WINDOW w AS (PARTITION BY event_type ORDER BY seq))
SELECT event_type, seq, round(sum(dt) OVER (PARTITION BY event_type ORDER BY seq), 2) AS elapsed FROM d WHERE dt IS NOT NULL"""
)
def cumulative_time(s):
    from tidewright.operators.ordered import framed, running_sum

    d = framed(s, KEY, 0, 1, lambda w: {"dt": F.lead("t").over(w) - F.col("t")}).where("dt IS NOT NULL")
    return running_sum(d, KEY, F.col("dt"), "e").select(*KEY, "seq", F.round("e", 2).alias("elapsed"))


@query(
    f"""{_WIN} SELECT event_type, start, k, round((x[4 * k - 3] + x[4 * k - 2] + x[4 * k - 1] + x[4 * k]) / 4, 6) AS pool FROM v, (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS k)"""
)
def multiscale_pools(s):
    w = _windows(s).withColumns(FC.multiscale("x", 32, [4]))
    return w.select(*KEY, "start", F.posexplode("pool_4").alias("k", "pool")).select(*KEY, "start", (F.col("k") + 1).alias("k"), r6("pool", "pool"))


@query(f"{_WIN} SELECT event_type, start, k, x[8 * k - 7] AS first, CASE WHEN k = 4 THEN x[32] ELSE x[8 * k + 8] END AS last FROM v, (SELECT unnest([1, 2, 3, 4]) AS k)")
def patch_unfold(s):
    w = _windows(s).withColumn("p", FC.patches("x", 32, 16, 8))
    p = w.select(*KEY, "start", F.posexplode("p").alias("k", "p"))
    return p.select(*KEY, "start", (F.col("k") + 1).alias("k"), F.col("p")[0].alias("first"), F.col("p")[15].alias("last"))


@query(
    """, b AS (SELECT event_type, seq, value, min(value) OVER (PARTITION BY event_type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM s)
SELECT event_type, seq, best, value = best AND (seq = 1 OR value < coalesce(lag(best) OVER (PARTITION BY event_type ORDER BY seq), 1e308)) AS improved FROM b"""
)
def running_best(s):
    return FC.running_best(s, KEY, "value").select(*KEY, "seq", "best", "improved")


@query(
    """, w AS (SELECT event_type, seq, user_id, value, unnest(CASE WHEN (seq - 1) // 50 = 0 THEN [0] ELSE [(seq - 1) // 50 - 1, (seq - 1) // 50] END) AS win FROM s)
SELECT event_type, CAST(win AS BIGINT) AS win, round(CASE WHEN stddev_pop(sqrt(value)) <= 1e-12 OR stddev_pop(user_id) <= 1e-12 THEN 0 ELSE corr(sqrt(value), user_id) END, 6) AS pq_corr, round(covar_pop(sqrt(value), user_id), 4) AS rayleigh_proxy FROM w GROUP BY event_type, win"""
)
def joint_features(s):
    from tidewright.operators.clusters import joint_features as joint

    rows = WN.windowed_rows(s, 100, 50).withColumn("u", F.col("user_id").cast("double")).withColumn("r", F.sqrt("value"))
    return joint(rows, [*KEY, "win"], "r", "u").select(*KEY, "win", r6("pq_corr", "pq_corr"), F.round("rayleigh_proxy", 4).alias("rayleigh_proxy"))


@query(" SELECT event_type, CAST(least(floor(value / 2.5), 199) AS INT) AS bin, count(*) AS n FROM s WHERE value BETWEEN 0 AND 500 GROUP BY event_type, CAST(least(floor(value / 2.5), 199) AS INT)")
def value_histogram(s):
    from tidewright.sources.sinks import histogram

    return histogram(s, "value", 0.0, 500.0, keys=KEY)


@query(
    """, x AS (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM s WHERE gappy IS NOT NULL)
SELECT CAST((i - 10) // 3 + 1 AS BIGINT) AS seq, value FROM x WHERE i >= 10 AND (i - 10) % 3 = 0"""
)
def scalar_series(s):
    from tidewright.sources.readers import scalar_series as series

    return series(s.withColumn("v", F.col("gappy").cast("string")), "v", "event_id", start=10, every=3, least=20)


@query(" SELECT event_type, user_id % 4 AS signal, count(*) AS n FROM s GROUP BY event_type, user_id % 4")
def list_signals(s):
    from tidewright.sources.readers import list_signals as signals

    return signals(s.withColumn("signal", F.col("user_id") % 4), [*KEY, "signal"])


@query(
    """ SELECT 'lo' AS role, event_id, value FROM s WHERE value < 5 UNION ALL SELECT 'hi', event_id, value FROM s WHERE value > 300"""
)
def tagged_union(s):
    t = s.select("event_id", "value")
    return J.tagged_union({"lo": t.where("value < 5"), "hi": t.where("value > 300")})


# Queries that SQL does not express; tests hold them against definitions or known answers ---------------------------


def _synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewright.sources.synthetic import synthetic

    return synthetic(spark, 3)


@query()
def profile_segments(s):
    from tidewright.plans.profile import profile

    return profile(s, KEY, "value", 1.0)


@query(source=_synthetic)
def profile_synthetic(s):
    from tidewright.plans.profile import profile

    return profile(s, ["segment_id"], "value", 100.0)


@query()
def recommend_configuration(s):
    from tidewright.plans.profile import configuration, experiment_plan, profile

    p = profile(s, KEY, "value", 100.0).withColumn("segment_id", F.col("event_type"))
    return experiment_plan(configuration(p, ["event_type"], 4), "event_type")


@query()
def event_and_band_features(s):
    from tidewright.plans.augment import sequential_features

    return sequential_features(s, KEY, "value", 24.0, 100.0)


@query()
def hilbert_envelope(s):
    from tidewright.plans.augment import hilbert_features

    return hilbert_features(s, KEY, "value", 100.0)


@query()
def dlinear_forecast(s):
    w = _windows(s)
    train = w.join(sizes(s, KEY), KEY).where("start + 40 <= 0.7 * n").drop("n")  # windows within the training rows
    return FC.predict_dlinear(w, FC.fit_dlinear(train, 32, 8, 9), 9)


@query()
def forecast_structure(s):
    f = _forecasts(s)
    return FC.structure_scores(f, KEY, "y", "p", 8)


@query()
def forecast_shape_losses(s):
    w = _windows(s).withColumn("pred", FC.cycle_template(F.col("x"), 32, 8, 8, 2))
    return FC.shape_losses(w, [*KEY, "start"])


@query()
def lyapunov_divergence(s):
    return D.divergence(s, "value", 2, 1, 8, 5, *NEIGHBOUR_SAMPLE, keys=tuple(KEY))


@query()
def spectral_window_features(s):
    from tidewright.operators.clusters import spectral_window_features as features

    return features(WN.windowed_rows(s, 128, 64), [*KEY, "win"], "value", "seq", 100.0, [(1.0, 10.0), (10.0, 50.0)])


@query()
def prepare_records(s):
    from tidewright.plans.prepare import Settings, prepare

    settings = Settings(rate=10.0, min_duration=5.0, min_finite=0.5, min_std=0.01, clip=(0.01, 0.99), target_rate=5.0, smooth=5)
    return prepare(s.select(*KEY, "seq", "gappy"), KEY, "gappy", settings)[0]


@query()
def false_neighbour_dimension(s):
    return D.false_neighbours(s, "value", 1, 4, 0.05, 5, *NEIGHBOUR_SAMPLE, keys=tuple(KEY))


@query(source=vectors)
def kmeans_windows(e):
    from tidewright.operators.clusters import kmeans, standardised_features

    return kmeans(standardised_features(e, DIMENSIONS), DIMENSIONS, 8, [1, 2])[0].select("vec_id", "cluster")


@query(
    f"""{VECTORS}, g AS (SELECT i, avg(e) AS ge FROM x GROUP BY i), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
d AS (SELECT vec_id, label, sum((e - ce) * (e - ce)) AS d2 FROM x JOIN c USING (label, i) GROUP BY vec_id, label), w AS (SELECT label, sum(d2) AS w, avg(sqrt(d2)) AS s FROM d GROUP BY label),
b AS (SELECT label, sum((ce - ge) * (ce - ge)) AS b FROM c JOIN g USING (i) GROUP BY label), k AS (SELECT count(*) AS k, sum(n) AS n FROM n),
p AS (SELECT x.label, y.label AS other, sqrt(sum((x.ce - y.ce) * (x.ce - y.ce))) AS m FROM c x JOIN c y ON x.i = y.i AND x.label <> y.label GROUP BY x.label, y.label),
r AS (SELECT p.label, max((u.s + v.s) / m) AS r FROM p JOIN w u ON u.label = p.label JOIN w v ON v.label = p.other GROUP BY p.label)
SELECT round((SELECT sum(n.n * b.b) FROM b JOIN n USING (label)) * (k.n - k.k) / ((SELECT sum(w) FROM w) * (k.k - 1)), 4) AS calinski_harabasz, round((SELECT avg(r) FROM r), 4) AS davies_bouldin FROM k""",
    source=vectors,
)
def cluster_scores(e):
    from tidewright.operators.clusters import scatter

    found = scatter(e.withColumnRenamed("label", "cluster"), DIMENSIONS)
    return found.select(F.round("calinski_harabasz", 4).alias("calinski_harabasz"), F.round("davies_bouldin", 4).alias("davies_bouldin"))


@query(source=None)
def synthetic_six_types(spark, sf_dir):
    return _synthetic(spark, sf_dir)


@query(
    """WITH RECURSIVE l(seq, value) AS (SELECT CAST(1 AS BIGINT), CAST(0.123 AS DOUBLE) UNION ALL SELECT seq + 1, 4 * value * (1 - value) FROM l WHERE seq < 40)
SELECT seq, round(value, 3) AS value FROM l""",
    source=None,
)
def logistic_map(spark, sf_dir):
    from tidewright.sources.synthetic import logistic_map as generate

    return generate(spark, 40).select("seq", F.round("value", 3).alias("value"))


@query(" SELECT event_type, date_trunc('day', ts) AS window_start, count(*) AS n_rows, round(avg(value), 6) AS mean FROM s GROUP BY event_type, date_trunc('day', ts)")
def windowed_stats(s):
    from tidewright.streaming.causal import windowed_stats as stats

    w = stats(s.withColumn("at", F.col("ts").cast("timestamp")), KEY, "at", "value", "1 day")
    return w.select(*KEY, F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_rows", r6("mean", "mean"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tidewright import catalog_more  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


