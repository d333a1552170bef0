"""Forecasts that need no deep network, and the losses and scores of forecasts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.functions import kernels
from tidewright.operators.aggregates import pearson
from tidewright.operators.ordered import chunk_of
from tidewright.session import ship_package


def persistence(x: Column, pred_len: int) -> Column:
    """The last input for every step."""
    return F.array_repeat(F.element_at(x, -1), pred_len)


def cycle_template(x: Column, seq_len: int, pred_len: int, period: int, cycles: int = 1) -> Column:
    """The last cycle, or the mean of the last `cycles` ones, repeated over pred_len steps."""
    used = max(1, min(cycles, seq_len // period))
    phase = lambda j: F.lit(period - 1) - j % period  # noqa: E731  rows back from the last one
    at = lambda j, c: F.element_at(x, (F.lit(-1) - (phase(j) + c * period)).cast("int"))
    mean = lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(used - 1)), F.lit(0.0), lambda s, c: s + at(j, c)) / used
    return F.transform(F.sequence(F.lit(0), F.lit(pred_len - 1)), mean)


def instance_norm(df: DataFrame, array: str, unbiased: bool, eps: float = 1e-5, name: str = "normed") -> DataFrame:
    """Add the array less its mean, divided by std + eps (unbiased) or by the root of the variance + eps."""
    n = F.size(array)
    mean = F.aggregate(array, F.lit(0.0), lambda s, v: s + v) / n
    df = df.withColumn("__mean", mean)
    square = F.aggregate(array, F.lit(0.0), lambda s, v: s + (v - F.col("__mean")) * (v - F.col("__mean")))
    scale = F.sqrt(square / F.greatest(n - 1, F.lit(1))) + eps if unbiased else F.sqrt(square / n + eps)
    return df.withColumn("__scale", scale).withColumn(name, F.transform(array, lambda v: (v - F.col("__mean")) / F.col("__scale"))).drop("__mean", "__scale")


def patches(array: str, seq_len: int, patch: int, stride: int) -> Column:
    """Patches of an array, every `stride` values; the last value is repeated `stride` times before."""
    padded = F.concat(F.col(array), F.array_repeat(F.element_at(array, -1), stride))
    count = (seq_len + stride - patch) // stride + 1
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.slice(padded, k * stride + 1, patch))


def multiscale(array: str, seq_len: int, scales: Sequence[int]) -> dict[str, Column]:
    """Average pools of an array over `scale` values, whole pools only."""

    def pooled(s: int) -> Column:
        mean = lambda k: F.aggregate(F.slice(array, k * s + 1, s), F.lit(0.0), lambda a, v: a + v) / s
        return F.transform(F.sequence(F.lit(0), F.lit(seq_len // s - 1)), mean)

    return {f"pool_{s}": pooled(s) for s in scales}


def decomposed(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Seasonal part and trend of rows of windows; the trend is a centred mean with repeated ends."""
    left = (width - 1) // 2
    padded = np.pad(x, ((0, 0), (left, width - 1 - left)), mode="edge")
    total = np.cumsum(np.pad(padded, ((0, 0), (1, 0))), axis=1)
    trend = (total[:, width:] - total[:, :-width]) / width
    return x - trend, trend


def fit_dlinear(windows: DataFrame, seq_len: int, pred_len: int, width: int, ridge: float = 1e-3) -> np.ndarray:
    """Weights (2 * seq_len + 1, pred_len) of linear maps from the seasonal part and the trend to the targets.

    The least-squares optimum by normal equations: each task adds up its
    products, and (2 * seq_len + 1)^2 numbers of each come together.
    """
    ship_package(windows.sparkSession)
    d = 2 * seq_len + 1

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.zeros((d, d + pred_len))
        for pdf in batches:
            if len(pdf):
                x, y = np.stack(pdf["x"].to_list()), np.stack(pdf["y"].to_list())
                z = np.hstack([*decomposed(x, width), np.ones((len(x), 1))])
                a += z.T @ np.hstack([z, y])
        yield pd.DataFrame({"row": np.arange(d), "v": list(a)})

    parts = windows.select("x", "y").mapInPandas(products, "row int, v array<double>").select("row", F.posexplode("v").alias("k", "v"))
    total = parts.groupBy("row", "k").agg(F.sum("v").alias("v")).toPandas()
    a = np.zeros((d, d + pred_len))
    a[total["row"], total["k"]] = total["v"]
    return np.linalg.solve(a[:, :d] + ridge * np.eye(d), a[:, d:])


def predict_dlinear(windows: DataFrame, weights: np.ndarray, width: int) -> DataFrame:
    """Windows with `pred`."""
    held = windows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_list())
                z = np.hstack([*decomposed(x, width), np.ones((len(x), 1))])
                yield pdf.assign(pred=list(z @ held.value))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields)
    return windows.mapInPandas(run, f"{fields}, pred array<double>")


def huber(d: Column, beta: float) -> Column:
    return F.when(F.abs(d) < beta, 0.5 * d * d / beta).otherwise(F.abs(d) - 0.5 * beta)


def losses(df: DataFrame, keys: Sequence[str], pred: str, true: str, beta: float = 1.0, alpha: float = 1.0, weight: str | None = None) -> DataFrame:
    """mse, mae, huber, weighted_mse (1 + alpha * |true|), and with a weight column the weighted mean of the Huber loss."""
    d = F.col(pred) - F.col(true)
    aggs = [F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.avg(huber(d, beta)).alias("huber"), F.avg((1 + alpha * F.abs(true)) * d * d).alias("weighted_mse")]
    if weight:
        aggs.append((F.sum(huber(d, beta) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1e-6))).alias("sample_weighted"))
    return df.groupBy(*keys).agg(*aggs)


def _smooth_l1(d: np.ndarray, beta: float) -> float:
    a = np.abs(d)
    return float(np.where(a < beta, 0.5 * d * d / beta, a - 0.5 * beta).mean())


def aligned(windows: DataFrame, pred: str = "pred", true: str = "y") -> DataFrame:
    """windows itself; reading it fails where a prediction and its truth differ in length, instead of comparing a part."""
    same = F.size(pred) == F.size(true)
    message = F.concat(F.lit("a forecast of "), F.size(pred).cast("string"), F.lit(" steps for "), F.size(true).cast("string"))
    return windows.where(F.when(F.coalesce(same, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))


def hybrid_loss(windows: DataFrame, keys: Sequence[str], pred: str = "pred", true: str = "y", inputs: str = "x", derivative: float = 1.0, spectrum: float = 0.1, phase: float = 0.0, boundary: float = 5.0) -> DataFrame:
    """(keys, level, slope, spectrum, boundary, hybrid) of each forecast window, and their weighted sum.

    level is the mean absolute error, slope the mean squared error of the
    steps, spectrum the mean absolute error of the magnitudes (plus `phase`
    times the mean angle between the spectra), boundary the squared difference
    of the first predicted step and the last input step.
    """
    ship_package(windows.sparkSession)
    names = ["level", "slope", "spectrum", "boundary", "hybrid"]

    def terms(p: np.ndarray, t: np.ndarray, x: np.ndarray) -> list[float]:
        fp, ft = np.fft.rfft(p), np.fft.rfft(t)
        own = [np.abs(p - t).mean(), ((np.diff(p) - np.diff(t)) ** 2).mean() if len(p) > 1 else 0.0, np.abs(np.abs(fp) - np.abs(ft)).mean()]
        if phase > 0:
            own[2] += phase * np.abs(np.angle(fp * np.conj(ft))).mean()
        own.append(((p[0] - x[-1]) - (x[-1] - x[-2])) ** 2 if boundary > 0 else 0.0)
        return [*map(float, own), float(own[0] + derivative * own[1] + spectrum * own[2] + boundary * own[3])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                rows = [terms(*(np.asarray(v, float) for v in r)) for r in zip(pdf[pred], pdf[true], pdf[inputs])]
                yield pdf[list(keys)].assign(**dict(zip(names, zip(*rows))))

    fields = ", ".join([f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in keys] + [f"{n} double" for n in names])
    return aligned(windows, pred, true).select(*keys, pred, true, inputs).mapInPandas(run, fields)


def strongest_bins(windows: DataFrame, array: str, k: int) -> DataFrame:
    """windows with `season`, the array's part in the bins that exceed its k-th largest amplitude, and `trend`, the rest."""
    ship_package(windows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            season = [kernels.top_bins(np.asarray(v, float), k) for v in pdf[array]]
            yield pdf.assign(season=season, trend=[np.asarray(v, float) - s for v, s in zip(pdf[array], season)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.schema.fields)
    return windows.mapInPandas(run, f"{fields}, season array<double>, trend array<double>")


def peak_metrics(samples: DataFrame, targets: Sequence[str], pred: str = "pred_", naive: str = "naive_") -> DataFrame:
    """(part, mse, mae, pearson, and naive_ ones) of predicted peaks over all targets, heights (target_h_*) and intervals (target_dt_*)."""
    cells = [F.struct(F.lit(t).alias("t"), *[F.col(c).cast("double").alias(n) for c, n in ((t, "y"), (pred + t, "p"), (naive + t, "b"))]) for t in targets]
    long = samples.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    part = F.when(F.startswith("t", F.lit("target_h_")), "height").when(F.startswith("t", F.lit("target_dt_")), "interval")
    long = long.withColumn("part", F.explode(F.array_compact(F.array(F.lit("all"), part))))
    off = lambda c: F.col(c) - F.col("y")
    own = [f.alias(n + m) for n, c in (("", "p"), ("naive_", "b")) for m, f in (("mse", F.avg(off(c) * off(c))), ("mae", F.avg(F.abs(off(c)))), ("pearson", pearson("y", c)))]
    return long.groupBy("part").agg(*own)


def shape_losses(windows: DataFrame, keys: Sequence[str], pred: str = "pred", true: str = "y", window: int = 9, beta: float = 0.3, pool: int = 9) -> DataFrame:
    """Of each forecast window: derivative, envelope, spectrum, correlation, multi-scale and peak terms, and the event-weighted point loss.

    The peak term compares the largest and the smallest values within `pool`
    steps (made odd) around each step; 0 for a pool of 1.
    """
    ship_package(windows.sparkSession)
    names = ["point", "derivative", "envelope", "spectrum", "correlation", "multiscale", "peak"]
    reach_ = max(1, pool) // 2
    extremes = lambda x: [f(np.lib.stride_tricks.sliding_window_view(np.pad(x, reach_, constant_values=edge), 2 * reach_ + 1), 1) for f, edge in ((np.max, -np.inf), (np.min, np.inf))]

    def terms(p: np.ndarray, t: np.ndarray) -> list[float]:
        amp = np.abs(t - t.mean())
        slope = np.abs(np.diff(t, prepend=t[:1]))
        salience = np.clip(0.5 * amp / max(amp.mean(), 1e-6) + 0.5 * slope / max(slope.mean(), 1e-6), 0, 10)
        d = np.abs(p - t)
        point = (np.where(d < beta, 0.5 * d * d / beta, d - 0.5 * beta) * (1 + salience)).mean()
        left = (window - 1) // 2
        rms = lambda x: np.sqrt(np.convolve(np.pad(x * x, (left, window - 1 - left), mode="edge"), np.ones(window) / window, "valid"))
        log = lambda x: np.log1p(np.abs(np.fft.rfft(x)))
        pc, tc = p - p.mean(), t - t.mean()
        corr = (pc * tc).sum() / np.sqrt(max((pc * pc).sum(), 1e-12) * max((tc * tc).sum(), 1e-12))
        pools = [_smooth_l1(p[: len(p) // s * s].reshape(-1, s).mean(1) - t[: len(t) // s * s].reshape(-1, s).mean(1), 0.3) for s in (2, 4, 8) if len(p) >= 2 * s]
        return [float(point), _smooth_l1(np.diff(p) - np.diff(t), beta), float(np.abs(rms(p) - rms(t)).mean()), float(np.abs(log(p) - log(t)).mean()), float(1 - corr), float(np.mean(pools)) if pools else 0.0,
                float(np.mean([_smooth_l1(a - b, beta) for a, b in zip(extremes(p), extremes(t))])) if reach_ and len(p) > 1 else 0.0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                rows = [terms(np.asarray(p, float), np.asarray(t, float)) for p, t in zip(pdf[pred], pdf[true])]
                yield pdf[list(keys)].assign(**dict(zip(names, zip(*rows))))

    fields = ", ".join(f"`{k}` {windows.schema[k].dataType.simpleString()}" for k in keys)
    return windows.select(*keys, pred, true).mapInPandas(run, ", ".join([fields, *[f"{n} double" for n in names]]))


# The names of the scores.
STRUCTURE = [
    "dominant_period_true_samples", "dominant_period_pred_samples", "dominant_period_error_samples", "dominant_period_relative_error",
    "dominant_energy_ratio_true", "dominant_energy_ratio_pred", "spectral_energy_l1", "envelope_mae", "envelope_relative_mae",
    "peak_count_true", "peak_count_pred", "peak_count_error", "peak_time_mae_samples", "peak_hit_rate",
]


def _peaks(x: np.ndarray, period: float) -> np.ndarray:
    mad = np.median(np.abs(x - np.median(x)))
    scale = 1.4826 * mad if mad > 1e-12 else x.std()
    if scale <= 1e-12:
        return np.zeros(0, np.int64)
    distance = max(1, round(0.35 * period)) if np.isfinite(period) and period > 1 else 1
    return kernels.find_peaks((x - np.median(x)) / scale, distance=distance, prominence=0.5)[0]


def structure(true: np.ndarray, pred: np.ndarray, pred_len: int) -> list[float]:
    """The structure scores of one forecast series, in the order of STRUCTURE."""
    n = min(len(true), len(pred))
    t, p = true[:n], pred[:n]
    (_, pt, et), (_, pp, ep) = kernels.dominant_bin(t), kernels.dominant_bin(p)
    periodic = np.isfinite(pt) and pt > 1
    width = min(max(3, round(pt / 4) if periodic else pred_len), max(3, n))
    left = (width - 1) // 2
    rms = lambda x: np.sqrt(np.maximum(np.convolve(np.pad((x - x.mean()) ** 2, (left, width - 1 - left), mode="edge"), np.ones(width) / width, "valid"), 0))
    a, b = rms(t), rms(p)
    mae = float(np.abs(b - a).mean())
    peaks_t, peaks_p = _peaks(t, pt), _peaks(p, pt)
    near = np.abs(peaks_t[:, None] - peaks_p[None, :]).min(1) if len(peaks_t) and len(peaks_p) else np.zeros(0)
    tolerance = max(1.0, 0.25 * (pt if periodic else pred_len))
    hit = float((near <= tolerance).sum() / len(peaks_t)) if len(peaks_t) else float("nan")
    gap = abs(pp - pt)
    return [
        pt, pp, gap, gap / max(abs(pt), 1e-12), et, ep, float(np.abs(kernels.spectrum(t) - kernels.spectrum(p)).sum()), mae, mae / max(float(a.mean()), 1e-12),
        len(peaks_t), len(peaks_p), len(peaks_p) - len(peaks_t), float(near.mean()) if len(near) else float("nan"), hit,
    ]


#: Rows of a rolling forecast that are scored together.
HORIZON = 2000


def structure_scores(df: DataFrame, keys: Sequence[str], true: str, pred: str, pred_len: int, seq: str = "seq", horizon: int = HORIZON) -> DataFrame:
    """(keys, horizon, scores): structure scores of each rolling horizon of a forecast series, numbered from 0.

    A series of any length is scored in horizons of that many rows by seq;
    one of fewer than 4 rows has NaN scores.
    """
    ship_package(df.sparkSession)
    df = df.withColumn("horizon", F.floor((F.col(seq) - 1) / F.lit(horizon)).cast("long"))
    keys = [*keys, "horizon"]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(seq)
        own = structure(pdf[true].to_numpy(float), pdf[pred].to_numpy(float), pred_len) if len(pdf) >= 4 else [float("nan")] * len(STRUCTURE)
        return pd.DataFrame([[*key, *map(float, own)]], columns=[*keys, *STRUCTURE])

    fields = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"{n} double" for n in STRUCTURE])
    return df.select(*keys, seq, true, pred).groupBy(*keys).applyInPandas(run, fields)


def rolling_evaluation(windows: DataFrame, keys: Sequence[str], pred_len: int, horizon: int, pred: str = "pred") -> DataFrame:
    """(keys, index, true, pred) of windows that follow each other without overlap; the last is cut at the horizon."""
    own = windows.where((F.col("start") % pred_len == 0) & (F.col("start") < horizon))
    long = own.select(*keys, "start", F.posexplode(F.arrays_zip(F.col("y").alias("t"), F.col(pred).alias("p"))).alias("k", "v"))
    return long.where(F.col("start") + F.col("k") < horizon).select(*keys, (F.col("start") + F.col("k")).alias("index"), F.col("v.t").alias("true"), F.col("v.p").alias("pred"))


def window_mse(windows: DataFrame, keys: Sequence[str], pred: str = "pred") -> DataFrame:
    """The mean over windows of each window's mean squared error."""
    error = F.aggregate(F.zip_with("y", pred, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) / F.size("y")
    return windows.groupBy(*keys).agg(F.avg(error).alias("mse"), F.count("*").alias("windows"))


def running_best(df: DataFrame, keys: Sequence[str], loss: str, seq: str = "seq") -> DataFrame:
    """Add `best`, the smallest loss so far, and `improved`, whether this row is the first to reach it (epochs in order)."""
    within = lambda w: F.min(loss).over(w.rowsBetween(W.unboundedPreceding, 0))
    held = df.withColumn("__chunk", chunk_of(seq))
    lows = held.groupBy(*keys, "__chunk").agg(F.min(loss).alias("__low"))
    others = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    far = lows.select(*keys, "__chunk", F.min("__low").over(others).alias("__far"))
    own = W.partitionBy(*keys, "__chunk").orderBy(seq)
    before = F.min(loss).over(own.rowsBetween(W.unboundedPreceding, -1))
    out = held.join(far, [*keys, "__chunk"]).withColumn("best", F.least(within(own), "__far")).withColumn("__before", F.least(before, "__far"))
    return out.withColumn("improved", F.col("__before").isNull() | (F.col(loss) < F.col("__before"))).drop("__chunk", "__far", "__before")


def best_run(metrics: DataFrame, args: DataFrame, on: str, min_pearson: float | None = None, max_mse: float | None = None) -> DataFrame:
    """Metrics with their run's arguments (never dropped for a lack of them), within the limits, in order, the best marked.

    A missing value fails its limit, as does NaN. The order is by data, model,
    pred_len as text, model_id and run; the best has the smallest mse.
    """
    out = metrics.join(args, on, "left")
    if min_pearson is not None:
        out = out.where(~F.isnan("pearson") & (F.coalesce("pearson", F.lit(float("-inf"))) >= min_pearson))
    if max_mse is not None:
        out = out.where(~F.isnan("mse") & (F.coalesce("mse", F.lit(float("inf"))) <= max_mse))
    order = [c for c in ("data", "model", "pred_len", "model_id", on) if c in out.columns]
    best = out.orderBy(F.col("mse").asc_nulls_last(), on).limit(1).select(F.col(on).alias("__best"))
    marked = out.join(F.broadcast(best), out[on] == best["__best"], "left")
    return marked.withColumn("best", F.col("__best").isNotNull()).drop("__best").orderBy(*[F.col(c).cast("string") for c in order])
