"""Writers of signal tables and reports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_long(df: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = ("split",)) -> None:
    """A long table as Parquet or CSV, in a folder for each value of `by`."""
    writer = df.write.partitionBy(*by).mode("errorifexists")
    writer.csv(path, header=True) if kind == "csv" else writer.parquet(path)


def write_by_type(df: DataFrame, profiles: DataFrame, path: str, kind: str = "signal_type") -> DataFrame:
    """Samples and profiles in a folder for each type; returns the manifest (type, segments, rows) of what was written."""
    df.write.partitionBy(kind).parquet(f"{path}/samples")
    profiles.write.partitionBy(kind).parquet(f"{path}/profiles")
    back = df.sparkSession.read.parquet(f"{path}/samples")
    return back.groupBy(kind).agg(F.countDistinct("segment_id").alias("segments"), F.count("*").alias("rows"))


def ordered_report(parts: Sequence[DataFrame], preferred: Sequence[str]) -> DataFrame:
    """The union of reports with different columns: preferred ones first, the others by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    first = [c for c in preferred if c in out.columns]
    return out.select(*first, *sorted(c for c in out.columns if c not in first))


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as JSON text."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def write_sidecar(df: DataFrame, path: str, settings: dict) -> None:
    """Settings as a one-row JSON file beside a table; written by Spark, so the path may be in any store."""
    df.sparkSession.createDataFrame([(json.dumps(settings, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int = 200, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, n): counts of equal bins of [low, high], for each group; the last includes its end."""
    at: Column = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)).cast("int"), F.lit(bins - 1))
    return df.where(F.col(value).between(low, high)).groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def wide_table(df: DataFrame, header: Sequence[str], derived: dict[str, Column], split: str = "split") -> DataFrame:
    """The original columns in their order, the split, then the derived columns."""
    if clash := set(derived) & {*header, split}:
        raise ValueError(f"columns that are there already: {', '.join(sorted(clash))}")
    return df.select(*[F.col(c) for c in header], F.col(split), *[c.alias(n) for n, c in derived.items()])


def write_scaler(scaler: DataFrame, path: str) -> None:
    """The one row of a fitted scaler (see operators.splits) as Parquet."""
    scaler.coalesce(1).write.parquet(path)


def read_scaler(df: DataFrame, path: str) -> DataFrame:
    """A written scaler, for splits.scale()."""
    return df.sparkSession.read.parquet(path)
