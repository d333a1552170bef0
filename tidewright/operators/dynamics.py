"""Nonlinear dynamics of one series: delay, embedding dimension, divergence and analog forecasts.

Every result is a small table of aggregates; the scalars that decide the next
plan (delay, dimension) are the only things that come to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.operators.aggregates import prefix_horizon
from tidewright.operators.joins import nearest_neighbours, subsample
from tidewright.operators.ordered import chunk_of, known, spread
from tidewright.operators.windows import delay_embedding
from tidewright.session import cut, ship_package


def acf(series: DataFrame, value: str, max_lag: int, keys: tuple[str, ...] = (), seq: str = "seq") -> DataFrame:
    """(keys, lag, acf) for lags 0 to max_lag: sums of lagged products over the sum of squares, of the values less their mean.

    A task gets a chunk and the max_lag rows after it, and returns one sum for
    each lag; missing values count as the mean.
    """
    ship_package(series.sparkSession)
    keys = list(keys)
    mean = series.groupBy(*keys).agg(F.avg(known(F.col(value))).alias("__mean"))
    joined = series.join(mean, keys) if keys else series.crossJoin(F.broadcast(mean))
    centred = joined.select(*keys, F.col(seq).alias("__s"), F.coalesce(known(F.col(value)) - F.col("__mean"), F.lit(0.0)).alias("__y"))
    own = spread(centred, 0, max_lag, "__s").withColumn("__own", (chunk_of("__s") == F.col("__chunk")))

    def sums(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("__s").to_numpy())
        y = table.column("__y").to_numpy()[order]
        n = int(np.count_nonzero(table.column("__own").to_numpy(zero_copy_only=False)))
        out = [float(y[: min(n, len(y) - k)] @ y[k : k + n]) if k < len(y) else 0.0 for k in range(max_lag + 1)]
        out = [v for k, v in enumerate(out) if k < len(y)]
        columns = [pa.array([k.as_py()] * len(out), k.type) for k in key[:-1]]
        return pa.table([*columns, pa.array(range(len(out)), pa.int32()), pa.array(out)], names=[*keys, "lag", "__p"])

    fields = ", ".join([f"`{k}` {series.schema[k].dataType.simpleString()}" for k in keys] + ["lag int", "__p double"])
    sums_ = own.groupBy(*keys, "__chunk").applyInArrow(sums, fields).groupBy(*keys, "lag").agg(F.sum("__p").alias("s"))
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # max_lag + 1 rows of a segment
    zero = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(whole)
    return sums_.select(*keys, "lag", F.when(zero == 0, 1.0).otherwise(F.col("s") / zero).alias("acf"))


def choose_delay(acfs: DataFrame, period: float | None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, tau, tau_1e, tau_zero): the first lag with acf <= 1/e, else <= 0, else a quarter period, else 1; a quarter period at most."""
    quarter = max(1, round(period / 4)) if period else None
    first = lambda level: F.min(F.when((F.col("lag") >= 1) & (F.col("acf") <= level), F.col("lag")))
    out = acfs.groupBy(*keys).agg(first(math.exp(-1)).alias("tau_1e"), first(0.0).alias("tau_zero"))
    tau = F.coalesce("tau_1e", "tau_zero", F.lit(quarter).cast("int"), F.lit(1))
    return out.withColumn("tau", F.greatest(F.least(tau, F.lit(quarter)) if quarter else tau, F.lit(1)))


def theiler_window(period: float | None, tau: int) -> int:
    return max(round(period), 2 * tau) if period else max(10, 2 * tau)


def neighbour_pairs(series: DataFrame, value: str, dim: int, tau: int, future: int, theiler: int, refs: int, candidates: int, seq: str = "seq", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, start, neighbour, d2) of embedded places (0-based) with `future` rows after them; references and candidates are evenly spaced samples of each segment, or all if 0."""
    keys = list(keys)
    points = cut(delay_embedding(series, keys, value, dim, tau, future, seq).select(*keys, (F.col(seq) - 1).alias("start"), "embedding"))
    if refs or candidates:
        n = points.groupBy(*keys).agg(F.count("*").alias("__n"))
        points = points.join(n, keys) if keys else points.crossJoin(F.broadcast(n))
    sample = lambda k: points.where(subsample(F.col("__n"), F.col("start"), k)) if k else points
    return nearest_neighbours(sample(refs), sample(candidates), theiler, keys=keys)


def _values(pairs: DataFrame, series: DataFrame, value: str, offsets: list[int], seq: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Pairs with the values at start + k and neighbour + k: (keys, start, neighbour, d2, k, a, b); equi-joins on the shifted row."""
    keys = list(keys)
    long = pairs.withColumn("k", F.explode(F.array(*[F.lit(k) for k in offsets]))).withColumns({"__i": F.col("start") + F.col("k"), "__j": F.col("neighbour") + F.col("k")})
    at = lambda i, v: series.select(*keys, (F.col(seq) - 1).cast("long").alias(i), F.col(value).alias(v))
    return long.join(at("__i", "a"), [*keys, "__i"]).join(at("__j", "b"), [*keys, "__j"]).drop("__i", "__j")


def false_neighbours(
    series: DataFrame, value: str, tau: int, max_dim: int, threshold: float, theiler: int, refs: int, candidates: int, rtol: float = 10.0, atol: float = 2.0, seq: str = "seq", keys: tuple[str, ...] = ()
) -> DataFrame:
    """(keys, dim, ratio, selected): the share of false neighbours of each dimension from 1, up to the first whose share is threshold at most.

    selected marks that one; a segment without such a dimension has all its
    rows unmarked, and max_dim is its choice (see embedding_dimension()).
    Dimensions that leave a segment eight rows or fewer are left out. All
    segments go through a dimension together, and all dimensions are one plan.
    """
    keys = list(keys)
    series = cut(series.select(*keys, seq, value))
    stats = cut(series.groupBy(*keys).agg(F.stddev_pop(value).alias("__std"), F.count("*").alias("__n")))
    sigma = F.when(F.col("__std") > 1e-12, F.col("__std")).otherwise(1.0)
    held = lambda df: df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))
    curve = None
    for dim in range(1, max_dim):
        rows = held(series).where(F.col("__n") - dim * tau > 8).drop("__n", "__std")
        pairs = neighbour_pairs(rows, value, dim, tau, tau, theiler, refs, candidates, seq, tuple(keys))
        at = held(_values(pairs, series, value, [dim * tau], seq, tuple(keys)))
        base, extra = F.sqrt(F.greatest("d2", F.lit(1e-12))), F.abs(F.col("a") - F.col("b"))
        false = (extra / base > rtol) | (F.sqrt(base * base + extra * extra) / sigma > atol)
        one = at.groupBy(*keys).agg(F.avg(false.cast("double")).alias("ratio")).where("ratio IS NOT NULL").select(*keys, F.lit(dim).alias("dim"), "ratio")
        curve = one if curve is None else curve.union(one)
    if curve is None:
        return stats.where("false").select(*keys, F.lit(1).alias("dim"), F.lit(0.0).alias("ratio"), F.lit(False).alias("selected"))
    # a segment has a row for each dimension: a few
    best = F.min(F.when(F.col("ratio") <= threshold, F.col("dim"))).over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0)))
    return curve.withColumn("__best", best).where("__best IS NULL OR dim <= __best").select(*keys, "dim", "ratio", F.coalesce(F.col("dim") == F.col("__best"), F.lit(False)).alias("selected"))


def embedding_dimension(curve: DataFrame, max_dim: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, dim): the selected dimension of false_neighbours(), max_dim where there is none."""
    return curve.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("selected"), F.col("dim"))), F.lit(max_dim)).alias("dim"))


def divergence(series: DataFrame, value: str, dim: int, tau: int, horizon: int, theiler: int, refs: int, candidates: int, seq: str = "seq", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, k, divergence): mean log distance of neighbours k rows later, for k from 0 to horizon."""
    series = cut(series.select(*keys, seq, value))
    pairs = neighbour_pairs(series, value, dim, tau, horizon, theiler, refs, candidates, seq, keys)
    offsets = sorted({k + j * tau for k in range(horizon + 1) for j in range(dim)})
    at = _values(pairs, series, value, offsets, seq, keys).withColumn("e", F.pow(F.col("a") - F.col("b"), F.lit(2.0)))
    steps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.col("k") - j * tau), lambda s: (s >= 0) & (s <= horizon))
    each = at.withColumn("step", F.explode(steps)).groupBy(*keys, "start", "step").agg(F.sqrt(F.sum("e")).alias("dist"))
    return each.groupBy(*keys, F.col("step").alias("k")).agg(F.avg(F.log(F.greatest("dist", F.lit(1e-12)))).alias("divergence"))


# The range of steps that the line is fitted to.
def fit_range(horizon: int, tau: int, start: int = 1, end: int = 0) -> tuple[int, int]:
    if end <= 0:
        end = min(horizon, max(start + 2, min(horizon // 4, max(8, 2 * tau))))
    return start, max(start + 1, min(horizon, end))


def lyapunov(curve: DataFrame, start: int, end: int, dt: float, period: float | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, slope, intercept, ...): slope of the divergence over [start, end], and the Lyapunov time in steps, seconds and cycles (infinite if it is not positive)."""
    own = curve.where((F.col("k") >= start) & (F.col("k") <= end))
    fit = own.groupBy(*keys).agg(F.regr_slope("divergence", "k").alias("slope"), F.regr_intercept("divergence", "k").alias("intercept"))
    steps = F.when(F.col("slope") > 0, 1 / F.col("slope")).otherwise(float("inf"))
    cycles = steps / F.lit(float(period)) if period else F.lit(None).cast("double")
    return fit.select(*keys, "slope", "intercept", steps.alias("time_steps"), (steps * dt).alias("time_seconds"), cycles.alias("time_cycles"))


def analog_curve(series: DataFrame, value: str, dim: int, tau: int, horizon: int, theiler: int, refs: int, candidates: int, seq: str = "seq", keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, horizon, rmse, persistence_rmse, nrmse, skill) of forecasts by the future of the nearest neighbour."""
    keys = list(keys)
    series = cut(series.select(*keys, seq, value))
    pairs = cut(neighbour_pairs(series, value, dim, tau, horizon, theiler, refs, candidates, seq, tuple(keys)))
    last = (dim - 1) * tau
    at = _values(pairs, series, value, [last + h for h in range(horizon + 1)], seq, tuple(keys)).withColumn("horizon", F.col("k") - last)
    now = at.where("horizon = 0").select(*keys, "start", F.col("a").alias("now"))
    std = series.groupBy(*keys).agg(F.stddev_pop(value).alias("std"))
    rms = lambda c: F.sqrt(F.avg(c * c))
    ahead = at.where("horizon > 0").join(now, [*keys, "start"])
    out = ahead.groupBy(*keys, "horizon").agg(rms(F.col("b") - F.col("a")).alias("rmse"), rms(F.col("now") - F.col("a")).alias("persistence_rmse"))
    skill = F.when(F.col("persistence_rmse") <= 1e-12, 0.0).otherwise(1 - F.col("rmse") / F.col("persistence_rmse"))
    scale = F.when(F.col("std") > 1e-12, F.col("std")).otherwise(1.0)
    joined = out.join(std, keys) if keys else out.crossJoin(F.broadcast(std))
    return joined.select(*keys, "horizon", "rmse", "persistence_rmse", (F.col("rmse") / scale).alias("nrmse"), skill.alias("skill"))


def horizon_summary(curve: DataFrame) -> DataFrame:
    """One row: how far the error stays below, and the skill above, six thresholds."""
    out = None
    tests = {f"horizon_nrmse_le_{t:.2f}".replace(".", "_"): F.col("nrmse") <= t for t in (0.1, 0.2, 0.5, 1.0)}
    tests |= {f"horizon_skill_ge_{t:.2f}".replace(".", "_"): F.col("skill") >= t for t in (0.2, 0.0)}
    for name, ok in tests.items():
        one = prefix_horizon(curve, [], "horizon", ok, name)
        out = one if out is None else out.crossJoin(F.broadcast(one))
    return out
