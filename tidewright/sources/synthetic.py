"""Seeded synthetic signals: six types of waves, and the logistic map."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tidewright.functions.columns import TYPE_IDS
from tidewright.session import ship_package


def wave(kind: str, rate: float, period: float, cycles: int, rng: np.random.Generator) -> np.ndarray:
    """One record of a type, mean 0 and deviation 1."""
    n = max(16, round(cycles * period * rate))
    t, f, tau = np.arange(n) / rate, 1 / period, 2 * np.pi
    span = cycles * period
    shift, jitter = rng.uniform(0, tau), lambda w: f * rng.uniform(1 - w, 1 + w)
    noise = rng.standard_normal(n)
    if kind == "stable_single_freq":
        a = tau * jitter(0.04) * t + shift
        x = np.sin(a) + 0.18 * np.sin(2 * a + 0.4) + 0.03 * noise
    elif kind == "noisy_single_freq":
        a = tau * jitter(0.06) * t + shift
        x = np.sin(a) + 0.12 * np.sin(2 * a) + 0.42 * noise + 0.1 * np.sin(tau * 8 * f * t)
    elif kind == "am_fm_modulated":
        slow = lambda part: tau * t / max(span * part, period) + rng.uniform(0, tau)
        local = np.maximum(f * (1 + 0.28 * np.sin(slow(0.55))), 0.35 * f)
        x = (1 + 0.42 * np.sin(slow(0.75))) * np.sin(shift + tau * np.cumsum(local) / rate) + 0.05 * noise
    elif kind == "spike_event":
        x = 0.22 * np.sin(tau * jitter(0.04) * t + shift) + 0.04 * noise
        width, at = max(0.035 * period, 1 / rate), rng.uniform(0.2, 0.8) * period
        while at < span:
            x += rng.normal(1.4, 0.18) * np.exp(-0.5 * ((t - at) / width) ** 2)
            at += period * max(0.2, rng.normal(1, 0.06))
    elif kind == "multi_freq":
        gate = 1 / (1 + np.exp(-(np.arange(n) - n // 2) / max(8, 0.04 * n)))
        a, b = tau * jitter(0.08) * t + shift, tau * f * rng.uniform(1.65, 2.35) * t + rng.uniform(0, tau)
        x = (1 - gate) * np.sin(a) + 0.95 * gate * np.sin(b) + 0.35 * np.sin(a + 0.25 * b) + 0.05 * noise
    elif kind == "weak_periodic":
        parts = [rng.uniform(0.05, 0.18) * np.sin(tau * f * rng.uniform(0.35, 5.5) * t + rng.uniform(0, tau)) for _ in range(8)]
        x = 0.18 * np.sin(tau * f * t + shift) + sum(parts) + np.cumsum(0.025 * rng.standard_normal(n)) + 0.55 * noise
    else:
        raise ValueError(f"no such type: {kind}")
    x = x - x.mean()
    return x / x.std() if x.std() > 1e-12 else x


def synthetic(spark: SparkSession, records: int, cycles: int = 40, rate: float = 100.0, period: float = 1.0, seed: int = 7, types: tuple[str, ...] = tuple(TYPE_IDS)) -> DataFrame:
    """(segment_id, signal_type, seq, time, value, expected_period_samples): `records` of each type.

    Each record has a generator of its own, seeded by seed and record, so any
    number of tasks makes the same table.
    """
    ship_package(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"].tolist():
                kind = types[i % len(types)]
                x = wave(kind, rate, period, cycles, np.random.default_rng([seed, i]))
                yield pd.DataFrame({"segment_id": f"{kind}_{i // len(types)}", "signal_type": kind, "seq": np.arange(1, len(x) + 1), "time": np.arange(len(x)) / rate, "value": x, "expected_period_samples": rate * period})

    n = records * len(types)
    ids = spark.range(0, n, 1, max(1, min(n, 8 * spark.sparkContext.defaultParallelism)))
    return ids.mapInPandas(run, "segment_id string, signal_type string, seq long, time double, value double, expected_period_samples double")


def logistic_map(spark: SparkSession, n: int, r: float = 4.0, start: float = 0.123) -> DataFrame:
    """(seq, value) of x' = r * x * (1 - x); a recurrence, so one task makes it, value by value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _ in range(len(pdf)):
                x, at = start, 0
                while at < n:
                    part = np.empty(min(65536, n - at))
                    for i in range(len(part)):
                        part[i] = x
                        x = r * x * (1 - x)
                    yield pd.DataFrame({"seq": np.arange(at + 1, at + len(part) + 1), "value": part})
                    at += len(part)

    return spark.range(1).coalesce(1).mapInPandas(run, "seq long, value double")
