"""Lookups, nearest neighbours, shifted and interval joins, unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.neighbours import nearest_neighbours  # noqa: F401
from tidewright.operators.ordered import framed


def first_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key by `order`: an aggregation with partial minima, no window over a key's rows."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.col(order)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(df.columns)


def map_first(df: DataFrame, dim: DataFrame, key: str, value: str, order: str, default: str = "unknown") -> DataFrame:
    """Add value of the first row of dim with the key, compared as text; `default` where there is none."""
    table = first_per_key(dim.select(F.col(key).cast("string").alias("__key"), F.col(value).alias("__value"), F.col(order).alias("__order")), ["__key"], "__order")
    return df.join(table.drop("__order"), df[key].cast("string") == table["__key"], "left").withColumn(value, F.coalesce("__value", F.lit(default))).drop("__key", "__value")


def subset(df: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Rows whose key, as text, is in keep."""
    table = keep.select(F.col(key).cast("string").alias("__key"))
    return df.join(table, df[key].cast("string") == table["__key"], "left_semi")


def with_fallback(df: DataFrame, profile: DataFrame, key: str, columns: Sequence[str], fallback: DataFrame) -> DataFrame:
    """Add the columns of the key's profile row; those of the one-row fallback where the key has no row or a null."""
    named = profile.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    held = df.join(named, key, "left").crossJoin(F.broadcast(fallback.select(*[F.col(c).alias(f"__all_{c}") for c in columns])))
    return held.select(*df.columns, *[F.coalesce(f"__{c}", f"__all_{c}").alias(c) for c in columns])


def subsample(n: Column, i: Column, most: int) -> Column:
    """Whether 0-based row i of n is one of the `most` evenly spaced rows trunc(k * (n - 1) / (most - 1))."""
    if most <= 0:
        return F.lit(True)
    if most == 1:
        return i == 0
    # the k-th place is the truncation of a double product, as in linspace
    step = (n - 1) / F.lit(float(most - 1))
    near = F.greatest(F.floor(i / step) - 1, F.lit(0))
    # the last place is set to n - 1 itself
    hit = F.exists(F.sequence(near.cast("long"), F.least(near + 3, F.lit(most - 1)).cast("long")), lambda k: F.floor(F.when(k == most - 1, (n - 1).cast("double")).otherwise(k * step)) == i)
    return (n <= most) | hit


def nearest_in_order(points: DataFrame, others: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Points with `nearest`, the least distance to a row of others in the same group; null where there is none.

    Both sides are put in one order, and the neighbours before and after a
    point are carried to it, so no pairs are made.
    """
    from tidewright.operators.ordered import number, swept

    cols = [*keys, at]
    both = points.select(*cols, F.lit(1).alias("__own")).union(others.select(*cols, F.lit(0).alias("__own")))
    # rows that tie are alike, so their order makes no difference
    both = number(both, keys, [at, "__own"], F.floor(F.col(at) / (1 << 20)), "__seq")
    here = F.when(F.col("__own") == 0, F.col(at))
    held = swept(both, keys, lasts={"__a": here}, nexts={"__b": here}, seq="__seq").where("__own = 1")
    near = F.least(F.col(at) - F.col("__a"), F.col("__b") - F.col(at))
    return held.withColumn("nearest", near).select(*cols, "nearest")


def shifted(df: DataFrame, keys: Sequence[str], value: str, horizons: int, seq: str = "seq") -> DataFrame:
    """(keys, seq, value, horizon, future) for horizons 1 to `horizons`, those within the segment."""
    ahead = lambda w: {"__ahead": F.collect_list(value).over(w.rowsBetween(1, horizons))}
    out = framed(df, keys, 0, horizons, ahead, seq)
    return out.select(*keys, seq, value, F.posexplode("__ahead").alias("horizon", "future")).withColumn("horizon", F.col("horizon") + 1)


def resample(df: DataFrame, keys: Sequence[str], value: str, rate: float, target: float, seq: str = "seq") -> DataFrame:
    """(keys, j, time, value): linear interpolation onto a grid of `target` Hz, up to the last sample.

    Each interval between two samples makes its own grid points, so no join is
    needed; the trailing part of an interval is dropped.
    """
    ahead = lambda w: {"__next": F.lead(value).over(w)}
    step = rate / target
    at = (F.col(seq) - 1).cast("double")
    # grid points with floor(j * step) = seq - 1, tested exactly
    low, high = F.greatest(F.floor(at / step) - 1, F.lit(0)), F.floor((at + 1) / step) + 1
    spread = framed(df, keys, 0, 1, ahead, seq).withColumn("j", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    place = F.col("j") * F.lit(step)
    own = spread.where((F.floor(place) == F.col(seq) - 1) & (F.col("__next").isNotNull() | (place == at)))
    part = place - at
    out = F.when(part == 0, F.col(value)).otherwise(F.col(value) + (F.col("__next") - F.col(value)) * part)
    return own.select(*keys, "j", (F.col("j") / F.lit(target)).alias("time"), out.alias(value))


def label_ranges(samples: DataFrame, ranges: DataFrame, keys: Sequence[str], time: str, low: str, high: str, label: str, width: float) -> DataFrame:
    """Samples with each label whose range [low, high] holds their time; equi-join on buckets of `width`."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(width))).cast("long")
    spread = ranges.select(*keys, F.col(low).alias("__low"), F.col(high).alias("__high"), label, F.explode(F.sequence(bucket(low), bucket(high))).alias("__bucket"))
    held = samples.withColumn("__bucket", bucket(time)).join(spread, [*keys, "__bucket"])
    return held.where((F.col(time) >= F.col("__low")) & (F.col(time) <= F.col("__high"))).drop("__bucket", "__low", "__high")


def overlap_average(df: DataFrame, keys: Sequence[str], start: str, values: str, name: str = "mean") -> DataFrame:
    """(keys, target, mean, n): the average of all predictions for a row, from arrays that begin at start."""
    long = df.select(*keys, F.col(start).alias("__s"), F.posexplode(values).alias("__k", "__v"))
    return long.groupBy(*keys, (F.col("__s") + F.col("__k")).alias("target")).agg(F.avg("__v").alias(name), F.count("*").alias("n"))


def union_segments(parts: dict[str, DataFrame], segment: str = "segment_id") -> DataFrame:
    """All rows of tables with equal columns; segments are named {stem}_{segment}, or {stem} where there are none."""
    heads = {tuple(p.columns) for p in parts.values()}
    if len(heads) > 1:
        raise ValueError("the tables differ in their columns")
    out = None
    for stem, part in parts.items():
        named = F.concat(F.lit(f"{stem}_"), F.col(segment).cast("string")) if segment in part.columns else F.lit(stem)
        part = part.withColumn(segment, F.coalesce(named, F.lit(stem)))
        out = part if out is None else out.unionByName(part)
    return out


def tagged_union(parts: dict[str, DataFrame], name: str = "role") -> DataFrame:
    """All rows with the role of their table."""
    out = None
    for role, part in parts.items():
        part = part.withColumn(name, F.lit(role))
        out = part if out is None else out.unionByName(part)
    return out
