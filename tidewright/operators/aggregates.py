"""Grouped statistics of signals. All have partial sums, so a large group is no large task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.functions.columns import clip
from tidewright.operators.ordered import _join, finite, finite_values, framed, medians, quantiles, quantiles_of
from tidewright.session import cut


def finite_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows, finite rows and ratio, counts of NaN and infinities, and mean, population std, min, max and median of the finite values."""
    keys = list(keys)
    x = F.col(value).cast("double")
    ok = F.when(finite(x), x)
    count = lambda c: F.count(F.when(c, 1))
    stats = df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count(ok).alias("finite_rows"),
        count(F.isnan(x)).alias("nan_rows"),
        count(x == float("inf")).alias("posinf_rows"),
        count(x == float("-inf")).alias("neginf_rows"),
        F.avg(ok).alias("mean"),
        F.stddev_pop(ok).alias("std"),
        F.min(ok).alias("min"),
        F.max(ok).alias("max"),
    )
    stats = stats.withColumn("finite_ratio", F.col("finite_rows") / F.greatest("n_rows", F.lit(1)))
    middle = quantiles(df, keys, value, {"median": 0.5})
    return stats.join(middle, keys, "left") if keys else stats.crossJoin(F.broadcast(middle))


def robust_scale(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, median, mad, scale) of the finite values: scale is 1.4826 * mad, or the population std where mad is tiny, or null."""
    return robust_scale_of(finite_values(df, keys, value), keys)


def robust_scale_of(values: DataFrame, keys: Sequence[str], also: dict[str, float] | None = None) -> DataFrame:
    """robust_scale() of a table of values, with further quantiles `also`; the samples are not read again."""
    keys = list(keys)
    middle = quantiles_of(values, keys, {"median": 0.5, **(also or {})})  # read from a small table
    away = _join(values, middle, keys).select(*keys, F.abs(F.col("__v") - F.col("median")).alias("__v"))
    mads = quantiles_of(away, keys, {"mad": 0.5})
    out = _join(_join(middle, mads, keys), values.groupBy(*keys).agg(F.stddev_pop("__v").alias("__std")), keys)
    scale = F.when(F.col("mad") > 1e-12, 1.4826 * F.col("mad")).when(F.col("__std") > 1e-12, F.col("__std"))
    return out.withColumn("scale", scale).drop("__std")


def robust_zscore(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add (x - median) / scale, missing samples counting as the median; 0 in a constant segment."""
    keys = list(keys)
    filled = F.when(finite(F.col(value)), F.col(value)).otherwise(F.col("median"))
    joined = _join(df, robust_scale(df, keys, value).drop("mad"), keys)
    return joined.withColumn(name, F.coalesce((filled - F.col("median")) / F.col("scale"), F.lit(0.0))).drop("median", "scale")


def quantile_clip(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, sigmas: float | None, name: str) -> DataFrame:
    """Add value clipped to its quantiles, and to median +- sigmas robust scales if given, and `clipped`."""
    keys = list(keys)
    values, at = finite_values(df, keys, value), {"__low": low, "__high": high}
    if sigmas:
        out = F.col("scale") * sigmas
        bounds = robust_scale_of(values, keys, at).withColumns(
            {"__low": F.greatest("__low", F.coalesce(F.col("median") - out, "__low")), "__high": F.least("__high", F.coalesce(F.col("median") + out, "__high"))}
        ).drop("median", "scale", "mad")
    else:
        bounds = quantiles_of(values, keys, at)
    joined = _join(df, bounds, keys).withColumn(name, clip(value, F.col("__low"), F.col("__high")))
    return joined.withColumn("clipped", F.col(name) != F.col(value)).drop("__low", "__high")


def sample_rate(df: DataFrame, keys: Sequence[str], time: str, seq: str = "seq") -> DataFrame:
    """(keys, fs): one over the median of the positive finite time steps."""
    steps = framed(df, keys, 1, 0, lambda w: {"__dt": F.col(time) - F.lag(time).over(w)}, seq).where("__dt > 0")
    return quantiles(steps, keys, "__dt", {"__step": 0.5}).select(*keys, (1 / F.col("__step")).alias("fs"))


def mode(df: DataFrame, keys: Sequence[str], value: str, order: str, name: str) -> DataFrame:
    """(keys, name): the most frequent non-null value of each group, ties by the first in `order`."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    best = F.min_by(F.col(value), F.struct(-F.col("__n"), F.col("__first")))
    return counts.groupBy(*keys).agg(best.alias(name))


def type_summary(profiles: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Count of segments and medians of their features by type; a null type is a group."""
    keys = list(keys)
    count = profiles.groupBy(*keys).agg(F.count("*").alias("segments"))
    middle = medians(profiles, keys, columns)
    on = [count[k].eqNullSafe(middle[k]) for k in keys]
    return count.join(middle, on, "left").select(*[count[c] for c in count.columns], *[middle[c].alias(f"median_{c}") for c in columns])


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Population std, skewness and (not excess) kurtosis; 0 where the std is tiny."""
    raw = df.groupBy(*keys).agg(F.stddev_pop(value).alias("std"), F.skewness(value).alias("__skew"), F.kurtosis(value).alias("__kurt"))
    flat = F.col("std") <= 1e-12
    return raw.select(*keys, "std", F.when(flat, 0.0).otherwise(F.col("__skew")).alias("skew"), F.when(flat, 0.0).otherwise(F.col("__kurt") + 3).alias("kurtosis"))


def window_shape(rows: DataFrame, keys: Sequence[str], channel: str, value: str) -> DataFrame:
    """Of windows of several channels: peak-to-peak mean and max over channels, RMS, largest magnitude and crest factor."""
    each = rows.groupBy(*keys, channel).agg(
        (F.max(value) - F.min(value)).alias("__ptp"), F.sum(F.col(value) * F.col(value)).alias("__sq"), F.count(value).alias("__n"), F.max(F.abs(value)).alias("__top")
    )
    out = each.groupBy(*keys).agg(
        F.avg("__ptp").alias("ptp_mean"), F.max("__ptp").alias("ptp_max"), F.sqrt(F.sum("__sq") / F.sum("__n")).alias("rms"), F.max("__top").alias("max_abs")
    )
    return out.withColumn("crest", F.when(F.col("rms") > 1e-12, F.col("max_abs") / F.col("rms")).otherwise(0.0))


def pearson(a: str, b: str, degenerate: float | None = None) -> Column:
    """Correlation of two columns over a group; `degenerate` where one is constant."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.when((F.stddev_pop(x) > 1e-12) & (F.stddev_pop(y) > 1e-12), F.corr(x, y)).otherwise(F.lit(degenerate).cast("double"))


def line_fit(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of the least-squares line."""
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def forecast_errors(df: DataFrame, keys: Sequence[str], true: str, pred: str, naive: str) -> DataFrame:
    """mse, mae, rmse, nrmse (by the population std of the truth) and skill against the naive forecast."""
    d, n = F.col(pred) - F.col(true), F.col(naive) - F.col(true)
    raw = df.groupBy(*keys).agg(
        F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.stddev_pop(true).alias("__std"), F.sqrt(F.avg(n * n)).alias("__naive")
    )
    std = F.when(F.col("__std") > 1e-12, F.col("__std")).otherwise(1.0)
    skill = F.when(F.col("__naive") <= 1e-12, 0.0).otherwise(1 - F.col("rmse") / F.col("__naive"))
    return raw.select(*keys, "mse", "mae", "rmse", (F.col("rmse") / std).alias("nrmse"), skill.alias("skill"))


def prefix_horizon(df: DataFrame, keys: Sequence[str], horizon: str, ok: Column, name: str) -> DataFrame:
    """The length of the prefix of horizons (1, 2, ...) for which ok holds."""
    bad = F.min(F.when(~F.coalesce(ok, F.lit(False)), F.col(horizon)))
    return df.groupBy(*keys).agg(F.coalesce(bad - 1, F.max(horizon)).cast("long").alias(name))


def active_reduce(df: DataFrame, id_cols: Sequence[str], channels: Sequence[str], threshold: Column, name: str) -> DataFrame:
    """Add sum, mean, and the sum and mean over channels of at least `threshold` in magnitude, for each row of a wide table."""
    xs = F.array(*channels)
    on = F.filter(xs, lambda x: F.abs(x) >= threshold)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return df.select(
        *id_cols,
        total(xs).alias(f"{name}_sum"),
        (total(xs) / len(channels)).alias(f"{name}_mean"),
        total(on).alias(f"{name}_active_sum"),
        F.when(F.size(on) > 0, total(on) / F.size(on)).otherwise(0.0).alias(f"{name}_active_mean"),
    )


def split_counts(df: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """Rows of each segment in train, val and test."""
    return df.groupBy(*keys).agg(*[F.count(F.when(F.lower(split) == s, 1)).alias(f"{s}_rows") for s in ("train", "val", "test")])


def separating_features(df: DataFrame, cluster: str, features: Sequence[str], top: int = 20) -> DataFrame:
    """(feature, spread): the features whose cluster means differ most, by population std."""
    means = df.groupBy(cluster).agg(*[F.avg(f).alias(f) for f in features])
    long = means.unpivot([cluster], list(features), "feature", "mean")
    return long.groupBy("feature").agg(F.stddev_pop("mean").alias("spread")).orderBy(F.desc("spread"), "feature").limit(top)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark keeps k of each group before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
