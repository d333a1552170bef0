"""From raw records to the canonical long table: crop, gates, repair, clip, resample, split, smooth."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.columns import seconds_range, transform
from tidewright.operators.aggregates import quantile_clip
from tidewright.operators.joins import resample
from tidewright.operators.ordered import finite
from tidewright.operators.splits import split_records, split_segments
from tidewright.operators.windows import frame_mean, interpolate, smooth_by_run
from tidewright.session import cut


@dataclass
class Settings:
    rate: float
    start: float = 0.0
    end: float | None = None
    duration: float | None = None
    min_duration: float = 0.0
    min_finite: float = 0.0
    min_std: float = 0.0
    clip: tuple[float, float] | None = None
    sigmas: float | None = None
    target_rate: float | None = None
    transform: str = "none"
    smooth: int = 5
    train: float = 0.7
    val: float = 0.1
    policy: str = "chronological"


def gate_status(quality: DataFrame, s: Settings) -> DataFrame:
    """Add status (ok or skipped) and reason; the first gate that a record fails is its reason."""
    fail = [
        (F.lit(not s.rate > 0), "sample rate is unknown"),
        (F.col("n_rows") / s.rate < s.min_duration, "shorter than the minimal duration"),
        (F.col("finite_ratio") < s.min_finite, "too few finite samples"),
        (F.coalesce("std", F.lit(0.0)) < s.min_std, "standard deviation too small"),
    ]
    if s.target_rate:
        kept = F.floor((F.col("n_rows") - 1) / s.rate * s.target_rate) + 1
        fail.append((kept / s.target_rate < s.min_duration, "shorter than the minimal duration after resampling"))
    reason = F.coalesce(*[F.when(c, r) for c, r in fail])
    return quality.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("status", F.when(reason.isNull(), "ok").otherwise("skipped"))


def prepare(records: DataFrame, keys: Sequence[str], value: str, s: Settings, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The long table (keys, seq, time, raw, input_smooth, target_smooth, split) of the records that pass, and the quality table.

    Order: crop, duration and finite gates, interpolation, clipping, deviation
    gate, resampling, second duration gate. Splits by record rank what passed.
    Smoothing works on the transformed values and stays within a split.
    """
    keys = list(keys)
    cropped = records.where(seconds_range(seq, s.rate, s.start, s.end, s.duration))
    if s.start > 0:
        cropped = cropped.withColumn(seq, F.col(seq) - int(round(s.start * s.rate)))
    filled = interpolate(cropped, keys, value, "__x", seq).drop(value).withColumnRenamed("__x", value)
    if s.clip:
        filled = quantile_clip(filled, keys, value, *s.clip, s.sigmas, "__x").drop(value, "clipped").withColumnRenamed("__x", value)
    filled = cut(filled)
    ok = F.when(finite(F.col(value)), 1)
    before = cropped.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count(ok).alias("finite_rows"), (F.count(ok) / F.count("*")).alias("finite_ratio"))
    after = filled.groupBy(*keys).agg(F.stddev_pop(value).alias("std"))
    quality = gate_status(before.join(after, keys, "left"), s).withColumn("repaired_rows", F.col("n_rows") - F.col("finite_rows"))
    good = filled.where(finite(F.col(value))).join(quality.where("status = 'ok'").select(*keys), keys, "left_semi")
    rate = s.target_rate or s.rate
    if s.target_rate:
        good = resample(good, keys, value, s.rate, s.target_rate, seq).withColumn(seq, F.col("j") + 1).drop("j", "time")
    good = good.select(*keys, seq, transform(value, s.transform).alias("raw"))
    if s.policy == "by_record":
        labels = split_records(quality.where("status = 'ok'").select(*keys), keys, s.train, s.val)
        split = good.join(labels, keys)
    else:
        split = split_segments(good, keys, s.train, s.val, seq=seq)
    split = cut(split)
    causal = smooth_by_run(split, keys, "split", F.col("raw"), s.smooth, "causal", "input_smooth").drop("seq_in_run")
    # runs of a split are known by now; the centred mean shares them
    causal = cut(causal)
    first = causal.groupBy(*keys, "run").agg(F.min(seq).alias("__first"))
    both = causal.join(first, [*keys, "run"]).withColumn("__in", F.col(seq) - F.col("__first") + 1)
    smooth = frame_mean(both, [*keys, "run"], F.col("raw"), s.smooth, "A", "target_smooth", "__in")
    out = smooth.select(*keys, seq, ((F.col(seq) - 1) / rate).alias("time"), "raw", "input_smooth", "target_smooth", "split", F.lit(float(rate)).alias("fs"))
    return out, quality
