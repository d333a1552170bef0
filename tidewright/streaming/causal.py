"""Structured Streaming forms of the causal operators. All take and return streaming (or batch) tables with an event time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.operators.ordered import finite
from tidewright.session import ship_package


def event_time(df: DataFrame, time: str, late: str) -> DataFrame:
    """df with a TIMESTAMP event time and a watermark; rows later than that are dropped by stateful operators."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def windowed_stats(df: DataFrame, keys: Sequence[str], time: str, value: str, width: str, slide: str | None = None) -> DataFrame:
    """Rows, finite rows, mean, population std, min and max by event-time window and segment."""
    ok = F.when(finite(F.col(value)), F.col(value))
    out = df.groupBy(F.window(time, width, slide) if slide else F.window(time, width), *keys).agg(
        F.count("*").alias("n_rows"), F.count(ok).alias("finite_rows"), F.avg(ok).alias("mean"), F.stddev_pop(ok).alias("std"), F.min(ok).alias("min"), F.max(ok).alias("max")
    )
    return out.select(F.col("window.start").alias("window_start"), *keys, "n_rows", "finite_rows", "mean", "std", "min", "max")


def sessions(df: DataFrame, keys: Sequence[str], time: str, value: str, gap: str) -> DataFrame:
    """Activity runs of a segment that a gap in event time ends."""
    out = df.groupBy(F.session_window(time, gap).alias("s"), *keys).agg(F.count("*").alias("n_rows"), F.avg(value).alias("mean"))
    return out.select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *keys, "n_rows", "mean")


def causal_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int, sections: list | None = None) -> DataFrame:
    """keys, order, value with the causal mean and RMS over `width` rows, and the band-pass of second-order sections if given.

    The state of a segment is its last width - 1 values and two numbers of
    each section. Rows of a micro-batch are put in order; a row that comes in
    a later batch than its successors is taken as the newest. Missing values
    leave the frame as null does in batch.
    """
    ship_package(df.sparkSession)
    keys, order = list(keys), list(order)
    names = ["causal_mean", "causal_rms"] + ["band"] * bool(sections)
    fields = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, *order]] + [f"`{value}` double"] + [f"{n} double" for n in names])

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        from tidewright.functions.kernels import filtered

        own = [p for p in batches if len(p)]
        if not own:
            return
        pdf = pd.concat(own).sort_values(order)
        tail, memory = state.get if state.exists else ([], [])
        x = pdf[value].to_numpy(float)
        both = np.concatenate([np.asarray(tail, float), x])
        known = np.isfinite(both)
        flat = np.where(known, both, 0.0)
        sums = [np.concatenate(([0.0], np.cumsum(v))) for v in (flat, flat * flat, known.astype(float))]
        end = np.arange(len(tail) + 1, len(both) + 1)
        start = np.maximum(end - width, 0)
        total, square, count = (s[end] - s[start] for s in sums)
        with np.errstate(invalid="ignore", divide="ignore"):
            out = pdf[[*keys, *order]].assign(**{value: x, "causal_mean": total / count, "causal_rms": np.sqrt(np.maximum(square / count, 0))})
        memory = list(memory)
        if sections:
            states = list(zip(memory[::2], memory[1::2])) or None
            band, states = filtered(sections, flat[len(tail) :], states)
            memory = [float(v) for s in states for v in s]
            out["band"] = band
        state.update((both[max(0, len(both) - width + 1) :].tolist() if width > 1 else [], memory))
        yield out

    picked = df.select(*keys, *order, F.col(value).cast("double").alias(value))
    return picked.groupBy(*keys).applyInPandasWithState(step, fields, "tail array<double>, memory array<double>", "append", GroupStateTimeout.NoTimeout)


def _mean_of_finite(both: np.ndarray, first: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Causal means and mean squares over `width` values of both, for those from place `first` on; NaN where there is no finite one."""
    fine = np.isfinite(both)
    flat = np.where(fine, both, 0.0)
    end = np.arange(first + 1, len(both) + 1)
    start = np.maximum(end - width, 0)
    total, square, count = ((c := np.concatenate(([0.0], np.cumsum(v))))[end] - c[start] for v in (flat, flat * flat, fine.astype(float)))
    with np.errstate(invalid="ignore", divide="ignore"):
        return total / count, np.maximum(square / count, 0)


def _advance(x: np.ndarray, carry: dict, width: int, period: float, rate: float, sections: list | None) -> tuple[dict[str, np.ndarray], dict]:
    """The features of a segment's next values in order, and what is carried on."""
    from tidewright.functions.kernels import filtered

    trend = max(3, round(2 * period))
    keep = max(width, trend) - 1
    both = np.concatenate([carry["tail"], x])
    mean, square = _mean_of_finite(both, len(carry["tail"]), width)
    centred = x - _mean_of_finite(both, len(carry["tail"]), trend)[0]
    before = np.concatenate(([carry["last"]], centred[:-1]))
    frequency, now, cross = np.empty(len(x)), carry["frequency"], carry["cross"]
    at = 0
    for i in np.flatnonzero((before < 0) & (centred >= 0)).tolist():  # NaN is neither
        frequency[at:i], at = now, i
        place = carry["rows"] + i
        now, cross = (rate / (place - cross) if cross >= 0 else now), place
    frequency[at:] = now
    out = {"causal_mean": mean, "causal_rms": np.sqrt(square), "crossing_frequency": frequency}
    memory = carry["memory"]
    if sections:
        out["band"], states = filtered(sections, np.where(np.isfinite(x), x, 0.0), list(zip(memory[::2], memory[1::2])) or None)
        memory = [float(v) for s in states for v in s]
    return out, {"tail": both[max(0, len(both) - keep) :], "last": float(centred[-1]), "frequency": now, "cross": cross, "rows": carry["rows"] + len(x), "memory": memory}


def ordered_features(
    df: DataFrame, keys: Sequence[str], time: str, value: str, width: int, period: float, rate: float, sections: list | None = None, tie: str | None = None, idle: str = "1 day"
) -> DataFrame:
    """(keys, time, seq, value, causal_mean, causal_rms, crossing_frequency, and band with sections) of streamed rows, whatever order they come in.

    df has a watermark on `time` (see event_time()). A segment's rows wait in
    its state until the watermark has passed them, and then go on in order of
    time (and of `tie`, a whole number, where times are equal); a timer sees to
    rows that no later row of their segment follows. So the results are those
    of the batch operators, and rows that are later than the watermark are
    dropped, as everywhere. After `idle` event time without a row a segment's
    state is removed; should it come back, it begins anew. Rows without a time
    are left out. The state holds the rows of the watermark's delay and one
    frame of values.
    """
    spark = df.sparkSession
    ship_package(spark)
    keys = list(keys)
    names = ["causal_mean", "causal_rms", "crossing_frequency"] + ["band"] * bool(sections)
    fields = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"`{time}` timestamp, seq long, `{value}` double"] + [f"{n} double" for n in names])
    state_fields = "times array<long>, ties array<long>, waiting array<double>, tail array<double>, numbers array<double>, memory array<double>, newest long"
    wait = int(spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00 UTC' + INTERVAL {idle})").first()[0])

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ties, waiting, tail, numbers, memory, newest = state.get if state.exists else ([], [], [], [], [float("nan"), rate / period, -1.0, 0.0], [], 0)
        held = [np.asarray(times, np.int64)], [np.asarray(ties, np.int64)], [np.asarray(waiting, float)]
        for pdf in batches:
            for part, c in zip(held, ("__t", "__tie", value)):
                part.append(pdf[c].to_numpy(float if c == value else np.int64))
        t, tied, x = (np.concatenate(part) for part in held)
        order = np.lexsort((tied, t))
        t, tied, x = t[order], tied[order], x[order]
        newest = max(newest, int(t[-1])) if len(t) else newest
        passed = state.getCurrentWatermarkMs() * 1000
        n = int(np.searchsorted(t, passed, side="right"))
        carry = {"tail": np.asarray(tail, float), "memory": list(memory)} | dict(zip(("last", "frequency", "cross", "rows"), numbers))
        if n:
            out, carry = _advance(x[:n], carry, width, period, rate, sections)
            rows = pd.DataFrame({time: pd.to_datetime(t[:n], unit="us"), "seq": np.arange(n) + int(carry["rows"]) - n + 1, value: x[:n]})
            for k, v in zip(keys, key):
                rows[k] = v
            yield rows.assign(**out)[[*keys, time, "seq", value, *names]]
        if n == len(t) and passed >= newest + wait:
            state.remove()
            return
        state.update((t[n:].tolist(), tied[n:].tolist(), x[n:].tolist(), carry["tail"].tolist(), [float(carry[c]) for c in ("last", "frequency", "cross", "rows")], carry["memory"], newest))
        due = int(t[n]) if n < len(t) else newest + wait
        state.setTimeoutTimestamp(max(-(-due // 1000), state.getCurrentWatermarkMs() + 1))

    rows = df.where(F.col(time).isNotNull()).select(*keys, time, F.unix_micros(time).alias("__t"), (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("__tie"), F.col(value).cast("double").alias(value))
    return rows.groupBy(*keys).applyInPandasWithState(step, fields, state_fields, "append", GroupStateTimeout.EventTimeTimeout)
