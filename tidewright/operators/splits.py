"""Leakage-free splits and scalers that are fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.operators.ordered import quantiles, sizes


def _cut(n: Column, ratio: float) -> Column:
    """int(n * ratio) with the ratio as a double, as computed by the caller."""
    return F.floor(n.cast("double") * F.lit(float(ratio)))


def chronological(seq: Column, n: Column, train: float, val: float, mode: str = "total") -> Column:
    """train, val or test of 1-based row seq of n; legacy_rest takes val as a part of what training leaves."""
    if not 0 < train < 1 or not 0 <= val < 1 or (mode == "total" and train + val >= 1):
        raise ValueError("ratios out of range")
    first = _cut(n, train)
    second = _cut(n, train + val) if mode == "total" else first + _cut(n - first, val)
    return F.when(seq <= first, "train").when(seq <= second, "val").otherwise("test")


def split_segments(df: DataFrame, keys: Sequence[str], train: float, val: float, mode: str = "total", seq: str = "seq") -> DataFrame:
    """Add `split` by the place of each row in its segment."""
    out = df.join(sizes(df, keys, "__n"), list(keys))
    return out.withColumn("split", chronological(F.col(seq), F.col("__n"), train, val, mode)).drop("__n")


def split_records(records: DataFrame, order: Sequence[str], train: float, val: float, within: Sequence[str] = ()) -> DataFrame:
    """Add `split` to a table with a row for each record (that passed the gates), by its rank, within a type if given."""
    ranked = records.withColumn("__r", F.row_number().over(W.partitionBy(*within).orderBy(*order))).withColumn("__n", F.count("*").over(W.partitionBy(*within)))
    return ranked.withColumn("split", chronological(F.col("__r"), F.col("__n"), train, val)).drop("__r", "__n")


def adapted(seq: Column, n: Column, train: float, val: float, test_start: float) -> Column:
    """train and val at the front, test from test_start on, ignore between."""
    first, second, third = _cut(n, train), _cut(n, train + val), _cut(n, test_start)
    return F.when(seq <= first, "train").when(seq <= second, "val").when(seq <= third, "ignore").otherwise("test")


def train_val(seq: Column, n: Column, train: float) -> Column:
    return F.when(seq <= _cut(n, train), "train").otherwise("val")


def in_split(split: Column, *names: str) -> Column:
    """Whether a split label is one of the names, whatever its case."""
    return F.lower(split).isin(*[n.lower() for n in names])


def require_splits(counts: DataFrame, *names: str) -> None:
    """Raise if a split has no row; counts has a row for each split."""
    found = {r[0] for r in counts.select(F.lower("split")).distinct().limit(16).collect()}
    if missing := [n for n in names if n not in found]:
        raise ValueError(f"empty splits: {', '.join(missing)}")


def fit_channel_scaler(train: DataFrame, columns: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """One row: mean and std of each column, the std `eps` at least."""
    aggs = [F.avg(c).alias(f"mean_{c}") for c in columns] + [F.greatest(F.stddev_pop(c), F.lit(eps)).alias(f"std_{c}") for c in columns]
    return train.agg(*aggs)


def fit_global_scaler(train: DataFrame, columns: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """One row: mean and std over all columns together, the same for each; scaling divides by std + eps."""
    # merged from sums of each column, without a row for each value
    n, s, q = (sum((f(c) for c in columns), F.lit(0.0)) for f in (lambda c: F.count(c), lambda c: F.sum(c), lambda c: F.var_pop(c) * F.count(c)))
    mean = s / n
    between = sum((F.count(c) * F.pow(F.avg(c) - mean, F.lit(2.0)) for c in columns), F.lit(0.0))
    std = F.sqrt((q + between) / n)
    return train.agg(*[mean.alias(f"mean_{c}") for c in columns], *[(std + eps).alias(f"std_{c}") for c in columns])


def scale(df: DataFrame, scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns less their mean, divided by their std; the scaler is one row."""
    joined = df.crossJoin(F.broadcast(scaler))
    return joined.withColumns({c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in columns}).select(df.columns)


def unscale(x: Column, mean: Column, std: Column, eps: float = 0.0) -> Column:
    """Back to the original values; of a global scaler, single channels are multiplied by the std without eps."""
    return x * (std - eps) + mean


def standardised_target(df: DataFrame, columns: Sequence[str], split: str = "split") -> DataFrame:
    """Columns standardised by their training rows' mean and population std; a tiny std counts as 1."""
    train = df.where(in_split(F.col(split), "train"))
    std = lambda c: F.when(F.stddev_pop(c) <= 1e-12, 1.0).otherwise(F.stddev_pop(c))
    return scale(df, train.agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], *[std(c).alias(f"std_{c}") for c in columns]), columns)


def eval_stride(option: int, pred_len: int, stride: int, has_split: bool = True) -> int:
    """-1 is pred_len, 0 the training stride, else the option; without a split column always pred_len."""
    return pred_len if not has_split or option == -1 else stride if option == 0 else option


def amplitude_weights(df: DataFrame, value: str, split: str = "split", high: float = 0.95, gamma: float = 1.0, active: float = 0.9) -> DataFrame:
    """df with `amp_weight` and `active`, by limits of the training rows.

    The weight is the distance from the training median as a part of its
    `high` quantile, 0 to 1, to the power gamma; active rows are as far from 0
    as the `active` quantile of the training rows that are not 0.
    """
    train = df.where(in_split(F.col(split), "train"))
    middle = quantiles(train, [], value, {"__middle": 0.5})
    far = train.crossJoin(F.broadcast(middle)).select(F.abs(F.col(value) - F.col("__middle")).alias("__d"))
    large = train.select(F.nullif(F.abs(F.col(value)), F.lit(0.0)).alias("__a"))
    limits = middle.crossJoin(F.broadcast(quantiles(far, [], "__d", {"__far": high}))).crossJoin(F.broadcast(quantiles(large, [], "__a", {"__large": active})))
    scale = F.when(F.col("__far") > 1e-12, F.col("__far")).otherwise(1.0)
    part = F.greatest(F.least(F.abs(F.col(value) - F.col("__middle")) / scale, F.lit(1.0)), F.lit(0.0))
    held = df.crossJoin(F.broadcast(limits))
    return held.withColumns({"amp_weight": F.pow(part, F.lit(float(max(gamma, 1e-12)))), "active": F.abs(F.col(value)) >= F.col("__large")}).drop("__middle", "__far", "__large")
