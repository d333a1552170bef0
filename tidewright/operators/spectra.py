"""Discrete Fourier transforms of segments of any length, and what is read from them.

A segment of up to LIMIT samples is one transform of a task. A longer one is
laid out as a matrix: its columns are transformed in one exchange and its rows
in another, a few of them in each task. A length without such factors is a
convolution with a chirp, at a power of two. All give the same numbers but for
rounding, so no result depends on LIMIT.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import kernels
from tidewright.operators.aggregates import robust_scale
from tidewright.operators.ordered import known, sizes
from tidewright.session import cut, ship_package

#: Samples of a transform that one task makes.
LIMIT = 1 << 20
#: Rows that leave a transform's task at once.
PORTION = 1 << 16
#: Samples of a block of Welch's estimate.
WELCH = 8192


def divided(n: int, limit: int) -> tuple[int, int]:
    """Two factors of n, as alike as can be and neither above limit; (0, 0) if there are none."""
    for a in range(math.isqrt(n), 0, -1):
        if n % a == 0:
            return (a, n // a) if n // a <= limit else (0, 0)
    return 0, 0


def _kinds(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]


def _heads(key: tuple, count: int, n: int) -> list[pa.Array]:
    return [pa.repeat(k, n) for k in key[:count]]


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with their places and complex values."""
    for batch in batches:
        i, re, im = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__i", "__re", "__im"))
        yield batch, i, re + 1j * im


def _portions(key: tuple, keys: list[str], z: np.ndarray, place, fixed: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Rows (keys, i, re, im, fixed) of an array, PORTION at a time; place gives i for places in the flat array."""
    flat = z.reshape(-1)
    for low in range(0, len(flat), PORTION):
        own = flat[low : low + PORTION]
        n = len(own)
        columns = [pa.array(place(np.arange(low, low + n))), pa.array(own.real.copy()), pa.array(own.imag.copy()), *[pa.repeat(pa.scalar(v, pa.int64()), n) for v in fixed.values()]]
        yield pa.RecordBatch.from_arrays([*_heads(key, len(keys), n), *columns], [*keys, "__i", "__re", "__im", *fixed])


def _whole(rows: DataFrame, keys: list[str], work) -> DataFrame:
    """(keys, i, re, im) of work(complex values in order), a segment at once."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = None
        for batch, i, x in _samples(batches):
            z = np.zeros(batch.column("__n")[0].as_py(), complex) if z is None else z
            z[i] = x
        yield from _portions(key, keys, work(z), lambda at: at, {})

    return rows.groupBy(*keys).applyInArrow(run, ", ".join([*_kinds(rows, keys), "__i long, __re double, __im double"]))


def _steps(rows: DataFrame, keys: list[str], sign: int) -> DataFrame:
    """(keys, i, re, im) of the transform of rows (keys, i, re, im, a, b) of length a * b; rows that lack are zeros."""
    limit = LIMIT
    ints = F.col("__i").cast("long")

    def columns(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = None
        for batch, i, x in _samples(batches):
            if z is None:
                a, b, g = batch.column("__a")[0].as_py(), batch.column("__b")[0].as_py(), key[len(keys)].as_py()
                each = max(1, limit // a)
                first, width = g * each, min(each, b - g * each)
                z = np.zeros((a, width), complex)
            z[i // b, i % b - first] = x
        z = np.fft.fft(z, axis=0) if sign < 0 else np.fft.ifft(z, axis=0) * a
        j = np.arange(first, first + width)
        for k in range(a):
            z[k] *= np.exp(sign * 2j * np.pi * (k * j) / (a * b))
        yield from _portions(key, keys, z, lambda at: at // width * b + at % width + first, {"__a": a, "__b": b})

    def lines(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = None
        for batch, i, x in _samples(batches):
            if z is None:
                a, b, g = batch.column("__a")[0].as_py(), batch.column("__b")[0].as_py(), key[len(keys)].as_py()
                each = max(1, limit // b)
                first, height = g * each, min(each, a - g * each)
                z = np.zeros((height, b), complex)
            z[i // b - first, i % b] = x
        z = np.fft.fft(z, axis=1) if sign < 0 else np.fft.ifft(z, axis=1) * b
        yield from _portions(key, keys, z, lambda at: first + at // b + a * (at % b), {})

    heads = _kinds(rows, keys)
    part = lambda at, other: F.floor(at / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col(other)))).alias("__g")
    own = [*keys, "__i", "__re", "__im", "__a", "__b"]
    wide = rows.select(*own, part(ints % F.col("__b"), "__a")).groupBy(*keys, "__g").applyInArrow(columns, ", ".join([*heads, "__i long, __re double, __im double, __a long, __b long"]))
    return wide.select(*own, part(F.floor(ints / F.col("__b")), "__b")).groupBy(*keys, "__g").applyInArrow(lines, ", ".join([*heads, "__i long, __re double, __im double"]))


def _product(x: tuple[Column, Column], y: tuple[Column, Column]) -> list[Column]:
    return [(x[0] * y[0] - x[1] * y[1]).alias("__re"), (x[0] * y[1] + x[1] * y[0]).alias("__im")]


def _by_chirp(rows: DataFrame, keys: list[str], sign: int) -> DataFrame:
    """(keys, i, re, im) of the transform of rows (keys, i, re, im, n), as a convolution at a power of two."""
    n, i = F.col("__n"), F.col("__i")
    # the square is taken modulo 2n in whole numbers
    angle = lambda k: F.lit(math.pi) * ((k * k) % (2 * n)) / n
    chirp = lambda k, s: (F.cos(angle(k)), F.sin(angle(k)) * s)
    power = F.ceil(F.log2((2 * n - 1).cast("double")))
    shape = {"__a": F.pow(F.lit(2.0), F.floor(power / 2)).cast("long"), "__b": F.pow(F.lit(2.0), F.ceil(power / 2)).cast("long")}
    a = rows.select(*keys, "__i", "__n", *_product((F.col("__re"), F.col("__im")), chirp(i, sign))).withColumns(shape)
    lengths = cut(rows.groupBy(*keys).agg(F.max("__n").alias("__n")).withColumns(shape))
    m = F.col("__a") * F.col("__b")
    half = lengths.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    re, im = chirp(i, -sign)
    both = half.withColumn("j", F.explode(F.when(i == 0, F.array(i)).otherwise(F.array(i, m - i))))
    b = both.select(*keys, F.col("j").alias("__i"), re.alias("__re"), im.alias("__im"), "__a", "__b")
    fa, fb = cut(_steps(a, keys, -1)), cut(_steps(b, keys, -1).withColumnsRenamed({"__re": "__re2", "__im": "__im2"}))
    c = fa.join(fb, [*keys, "__i"]).join(lengths, keys) if keys else fa.join(fb, "__i").crossJoin(F.broadcast(lengths))
    c = c.select(*keys, "__i", *_product((F.col("__re"), F.col("__im")), (F.col("__re2"), F.col("__im2"))), "__a", "__b")
    back = _steps(c, keys, 1)
    back = back.join(lengths, keys) if keys else back.crossJoin(F.broadcast(lengths))
    return back.where(i < n).select(*keys, "__i", *_product((F.col("__re") / m, F.col("__im") / m), chirp(i, sign)))


def transform(rows: DataFrame, keys: Sequence[str], inverse: bool = False) -> DataFrame:
    """(keys, i, re, im), the discrete Fourier transform of rows (keys, i from 0, re, im) with the length n of each segment; rows that lack are zeros.

    inverse divides by the length, so that it undoes the transform.
    """
    ship_package(rows.sparkSession)
    keys, sign, limit = list(keys), 1 if inverse else -1, LIMIT
    lengths = rows.groupBy(*keys).agg(F.max("__n").alias("__n"))

    def factors(batches):
        for batch in batches:
            two = [divided(n, limit) if n > limit else (0, 0) for n in batch.column("__n").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], *(pa.array([t[j] for t in two], pa.int64()) for j in (0, 1))], [*keys, "__a", "__b"])

    shapes = cut(lengths.mapInArrow(factors, ", ".join([*_kinds(rows, keys), "__a long, __b long"])))
    held = rows.join(shapes, keys) if keys else rows.crossJoin(F.broadcast(shapes))
    work = (lambda z: np.fft.ifft(z)) if inverse else np.fft.fft
    small = F.col("__n") <= limit
    out = _whole(held.where(small).select(*keys, "__i", "__re", "__im", "__n"), keys, work)
    big = lengths.where(~small)
    if big.isEmpty():
        return out
    scale = lambda df: df.join(lengths, keys) if keys else df.crossJoin(F.broadcast(lengths))
    for part in (_steps(held.where(~small & (F.col("__a") > 0)), keys, sign), _by_chirp(held.where(~small & (F.col("__a") == 0)).drop("__a", "__b"), keys, sign)):
        if inverse:
            part = scale(part).select(*keys, "__i", (F.col("__re") / F.col("__n")).alias("__re"), (F.col("__im") / F.col("__n")).alias("__im"))
        out = out.union(part)
    return out


def _rows(df: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    n = sizes(df, keys, "__n")
    own = df.select(*keys, (F.col(seq) - 1).cast("long").alias("__i"), F.col(value).cast("double").alias("__re"), F.lit(0.0).alias("__im"))
    return own.join(n, keys) if keys else own.crossJoin(F.broadcast(n))


def analytic(df: DataFrame, keys: Sequence[str], value: str, seq: str = "seq") -> DataFrame:
    """(keys, seq, re, im) of the analytic signal: negative frequencies removed, positive ones doubled."""
    keys = list(keys)
    rows = _rows(df, keys, value, seq)
    lengths = cut(sizes(df, keys, "__n"))
    small = F.col("__n") <= LIMIT
    out = _whole(rows.where(small), keys, lambda z: kernels.analytic(z.real))
    if not lengths.where(~small).isEmpty():
        f = transform(rows.where(~small), keys)
        f = f.join(lengths, keys) if keys else f.crossJoin(F.broadcast(lengths))
        factor = F.when((F.col("__i") == 0) | (2 * F.col("__i") == F.col("__n")), 1.0).when(2 * F.col("__i") < F.col("__n"), 2.0)
        half = f.withColumn("__f", factor).where("__f IS NOT NULL")
        out = out.union(transform(cut(half.select(*keys, "__i", (F.col("__re") * F.col("__f")).alias("__re"), (F.col("__im") * F.col("__f")).alias("__im"), "__n")), keys, True))
    return out.select(*keys, (F.col("__i") + 1).alias(seq), F.col("__re").alias("re"), F.col("__im").alias("im"))


def amplitudes(df: DataFrame, keys: Sequence[str], value: str, seq: str = "seq") -> DataFrame:
    """(keys, bin, amplitude) of the bins 1 to n // 2 of each segment."""
    keys = list(keys)
    rows = cut(_rows(df, keys, value, seq))
    f = transform(rows, keys)
    n = rows.groupBy(*keys).agg(F.max("__n").alias("__n"))
    held = f.join(n, keys) if keys else f.crossJoin(F.broadcast(n))
    return held.where((F.col("__i") > 0) & (2 * F.col("__i") <= F.col("__n"))).select(*keys, F.col("__i").alias("bin"), F.hypot("__re", "__im").alias("amplitude"))


def welch_period(df: DataFrame, keys: Sequence[str], value: str, rate: Column, seq: str = "seq", length: int = WELCH) -> DataFrame:
    """(keys, estimated_period): samples of a cycle at the largest bin of Welch's power density over all samples; 0 for fewer than 8 samples, no variance or no power.

    Blocks of `length` samples (or the segment's, if shorter) overlap by half;
    their powers are added up by bin, so no segment is in one task. Missing
    samples count as the median.
    """
    ship_package(df.sparkSession)
    keys = list(keys)
    join = lambda a, b: a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))
    middle = robust_scale(df, keys, value).select(*keys, F.col("median").alias("__median"))
    rows = join(df.select(*keys, (F.col(seq) - 1).alias("__i"), F.col(value).alias("__x"), rate.alias("__r")), middle).withColumn("__x", F.coalesce(known(F.col("__x")), "__median"))
    stats = cut(rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.stddev_pop("__x").alias("std"), F.first("__r").alias("rate")))
    size = F.least(F.col("__n"), F.lit(length))
    step = size - F.floor(size / 2)
    fit = join(rows, stats.where((F.col("__n") >= 8) & (F.col("std") > 1e-12) & (F.col("rate") > 0)))
    low = F.greatest(F.ceil((F.col("__i") - size + 1) / step), F.lit(0))
    high = F.least(F.floor(F.col("__i") / step), F.floor((F.col("__n") - size) / step))
    dealt = fit.where(low <= high).select(*keys, "__i", "__x", "rate", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("__b"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = _column(table, "__x")[np.argsort(_column(table, "__i"))]
        _, power = kernels.welch(x, float(_column(table, "rate")[0]), len(x))
        return pa.table([*_heads(key, len(keys), len(power)), pa.array(np.arange(len(power))), pa.array(power)], [*keys, "__k", "__p"])

    bins = dealt.groupBy(*keys, "__b").applyInArrow(run, ", ".join([*_kinds(df, keys), "__k long, __p double"])).where("__k > 0").groupBy(*keys, "__k").agg(F.sum("__p").alias("__p"))
    best = bins.groupBy(*keys).agg(F.max_by("__k", F.struct("__p", -F.col("__k"))).alias("__k"), F.sum("__p").alias("total"))
    held = stats.join(best, keys, "left") if keys else stats.join(F.broadcast(best), how="left")
    return held.select(*keys, F.when(F.col("total") > 1e-20, size / F.col("__k")).otherwise(0.0).alias("estimated_period"))
