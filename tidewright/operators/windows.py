"""Row-frame operators: smoothing, gaps, runs, crossings, peaks, windows and embeddings.

All work on long tables with a segment (`keys`), a gapless 1-based `seq` and a
value. Null, NaN and infinite values count as missing. The frames are exact at
the ends of a segment; segments of any length are spread over tasks (see
operators.ordered).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.operators.ordered import chunk_of, chunk_size, finite, framed, known, running_sum, runs, spread, swept

#: From this width on, frames are differences of prefix sums in a chunk.
PREFIX_WIDTH = 64

#: Values of the windows that leave a task at once, about.
PORTION = 1 << 18


def reach(width: int, kind: str) -> tuple[int, int]:
    """Rows before and after a row in its frame: causal, or centred by convention A or B (mirror images for even widths)."""
    if width < 1:
        raise ValueError("a window has one row at least")
    left = {"causal": width - 1, "A": width // 2, "B": (width - 1) // 2}[kind]
    return left, width - 1 - left


def frame_mean(df: DataFrame, keys: Sequence[str], value: Column, width: int, kind: str, name: str, seq: str = "seq") -> DataFrame:
    """Add the mean of the finite values in each row's frame; at the ends the frame is what there is of it.

    Narrow frames are Spark's own. A sliding frame costs its width for every
    row, so wide ones are the difference of two prefix sums of the chunk.
    """
    before, after = reach(width, kind)
    df = df.withColumn("__x", known(value))
    if width < PREFIX_WIDTH:
        return framed(df, keys, before, after, lambda w: {name: F.avg("__x").over(w.rowsBetween(-before, after))}, seq).drop("__x")

    def build(w):
        up = w.rowsBetween(W.unboundedPreceding, 0)
        return {"__sum": F.coalesce(F.sum("__x").over(up), F.lit(0.0)), "__count": F.count("__x").over(up)}

    def differences(w):
        # the last row of the chunk's data stands for rows after the end
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        upto = lambda c: F.coalesce(F.lead(c, after).over(w), F.last(c).over(whole)) if after else F.col(c)
        below = lambda c: F.coalesce(F.lag(c, before + 1).over(w), F.lit(0))
        n = upto("__count") - below("__count")
        return build(w), {name: F.when(n > 0, (upto("__sum") - below("__sum")) / n)}

    # the frame of an own row lies within its chunk's rows, one more before for the difference
    return _two_steps(df, keys, before + 1, after, differences, seq).drop("__x", "__sum", "__count")


def _two_steps(df, keys, before, after, build, seq):
    first, second = build(W.partitionBy(*keys, "__chunk").orderBy(seq))
    held = spread(df, before, after, seq).withColumns(first).withColumns(second)
    return held.where(chunk_of(seq) == F.col("__chunk")).drop("__chunk")


def moving_rms(df: DataFrame, keys: Sequence[str], value: Column, width: int, kind: str, name: str, seq: str = "seq") -> DataFrame:
    """Add the root of the mean square of the finite values in each row's frame; null where there is none."""
    out = frame_mean(df, keys, known(value) * known(value), width, kind, name, seq)
    return out.withColumn(name, F.sqrt(F.when(F.col(name).isNotNull(), F.greatest(F.col(name), F.lit(0.0)))))


def frames(df: DataFrame, keys: Sequence[str], made: dict[str, tuple[Column, int | Column, str, str]], seq: str = "seq") -> DataFrame:
    """Add for each name the (value, width, kind, "mean" or "rms") of its frame; a width may be a column that is one in a segment.

    Frames of a given width are frame_mean() and moving_rms(). Others are made
    together: a chunk gets the rows that its segment's widest frame reaches,
    and takes differences of prefix sums at two places.
    """
    from tidewright.session import ship_package

    if all(isinstance(width, int) for _, width, _, _ in made.values()):
        for name, (value, width, kind, how) in made.items():
            df = (frame_mean if how == "mean" else moving_rms)(df, keys, value, width, kind, name, seq)
        return df
    ship_package(df.sparkSession)
    names, keys = list(made), list(keys)
    kinds_ = [(kind, how) for _, _, kind, how in made.values()]
    wide = [width if isinstance(width, Column) else F.lit(width) for _, width, _, _ in made.values()]
    left = [{"causal": w - 1, "A": F.floor(w / 2), "B": F.floor((w - 1) / 2)}[kind].cast("long") for w, (kind, _) in zip(wide, kinds_)]
    most = lambda cs: F.greatest(*cs, F.lit(0)) if len(cs) else F.lit(0)
    held = df.withColumns({f"__f{k}": F.coalesce(known(v), F.lit(float("nan"))) for k, (v, _, _, _) in enumerate(made.values())} | {f"__w{k}": w.cast("long") for k, w in enumerate(wide)} | {f"__l{k}": c for k, c in enumerate(left)})
    dealt = spread(held, most([F.col(f"__l{k}") for k in range(len(names))]), most([F.col(f"__w{k}") - 1 - F.col(f"__l{k}") for k in range(len(names))]), seq)
    size, held_names = chunk_size(), df.columns

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column(seq).to_numpy())))
        at, n = np.arange(table.num_rows), table.num_rows
        columns = []
        for k, (_, how) in enumerate(kinds_):
            x, width, before = table.column(f"__f{k}").to_numpy(), table.column(f"__w{k}")[0].as_py(), table.column(f"__l{k}")[0].as_py()
            fine = np.isfinite(x)
            x = np.where(fine, x * x if how == "rms" else x, 0.0)
            total, count = (np.concatenate(([0], np.cumsum(v))) for v in (x, fine))
            a, b = np.maximum(at - before, 0), np.minimum(at + width - before, n)
            some = count[b] - count[a]
            mean = (total[b] - total[a]) / np.maximum(some, 1)
            columns.append(pa.array(np.sqrt(np.maximum(mean, 0)) if how == "rms" else mean, mask=some == 0))
        own = pa.array((table.column(seq).to_numpy() - 1) // size == key[len(keys)].as_py())
        out = table.select(held_names)
        for name, c in zip(names, columns):
            out = out.append_column(name, c)
        return out.filter(own)

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` double" for n in names])
    return dealt.groupBy(*keys, "__chunk").applyInArrow(run, fields)


def edge_rms(df: DataFrame, keys: Sequence[str], value: str, width: int, name: str, seq: str = "seq") -> DataFrame:
    """Add the local root mean square over frames of `width` rows, the first and last value standing for rows beyond the ends; a missing sample is 0."""
    left, right = (width - 1) // 2, width - 1 - (width - 1) // 2
    x = F.coalesce(known(F.col(value)), F.lit(0.0))
    ends = df.groupBy(*keys).agg(F.min_by(x, seq).alias("__head"), F.max_by(x, seq).alias("__tail"), F.count("*").alias("__n"))
    sums = framed(df, keys, left, right, lambda w: {"__s": F.sum(x * x).over(w.rowsBetween(-left, right))}, seq)
    joined = sums.join(ends, list(keys))
    missing_head = F.greatest(F.lit(left + 1) - F.col(seq), F.lit(0))
    missing_tail = F.greatest(F.col(seq) + right - F.col("__n"), F.lit(0))
    total = F.col("__s") + missing_head * F.pow("__head", F.lit(2.0)) + missing_tail * F.pow("__tail", F.lit(2.0))
    return joined.withColumn(name, F.sqrt(F.greatest(total / width, F.lit(0.0)))).drop("__head", "__tail", "__n", "__s")


def same_convolution(df: DataFrame, keys: Sequence[str], value: Column, width: int, name: str, seq: str = "seq") -> DataFrame:
    """Add the mean over frames of `width` rows, zeros standing for rows beyond the ends and for missing samples."""
    before, after = reach(width, "A")
    return framed(df, keys, before, after, lambda w: {name: F.sum(F.coalesce(known(value), F.lit(0.0))).over(w.rowsBetween(-before, after)) / width}, seq)


def smooth_by_run(df: DataFrame, keys: Sequence[str], label: str, value: Column, width: int, kind: str, name: str) -> DataFrame:
    """Add the frame mean within each run of equal labels."""
    numbered = runs(df, keys, label, place="seq_in_run")
    return frame_mean(numbered, [*keys, "run"], value, width, kind, name, "seq_in_run")


def interpolate(df: DataFrame, keys: Sequence[str], value: str, name: str, seq: str = "seq") -> DataFrame:
    """Add value with missing samples interpolated linearly by seq, the ends held; null where a segment has no sample at all."""
    point = F.when(finite(F.col(value)), F.struct(F.col(seq).alias("s"), F.col(value).cast("double").alias("v")))
    both = swept(df, keys, lasts={"__a": point}, nexts={"__b": point}, seq=seq)
    a, b = F.col("__a"), F.col("__b")
    share = (F.col(seq) - a["s"]) / F.nullif(b["s"] - a["s"], F.lit(0))
    between = F.when(b["s"] == a["s"], a["v"]).otherwise(a["v"] + share * (b["v"] - a["v"]))
    return both.withColumn(name, F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(between)).drop("__a", "__b")


def repair_zero_gaps(df: DataFrame, keys: Sequence[str], value: str, name: str, longest: int, threshold: float, seq: str = "seq") -> DataFrame:
    """Fill inner runs of exact zeros, `longest` rows at most, between values of `threshold` or more in magnitude, linearly.

    Also adds `repaired`. Only gaps up to `longest` are filled, so frames that
    reach that far are enough.
    """
    other = F.when(F.col(value) != 0, F.struct(F.col(seq).alias("s"), F.col(value).alias("v")))

    def build(w):
        return {
            "__a": F.last(other, ignorenulls=True).over(w.rowsBetween(-longest - 1, 0)),
            "__b": F.first(other, ignorenulls=True).over(w.rowsBetween(0, longest + 1)),
        }

    out = framed(df, keys, longest + 1, longest + 1, build, seq)
    a, b = F.col("__a"), F.col("__b")
    gap = (F.col(value) == 0) & a.isNotNull() & b.isNotNull() & (b["s"] - a["s"] - 1 <= longest)
    fit = gap & (F.abs(a["v"]) >= threshold) & (F.abs(b["v"]) >= threshold)
    filled = a["v"] + (b["v"] - a["v"]) * (F.col(seq) - a["s"]) / (b["s"] - a["s"])
    repaired = F.coalesce(fit, F.lit(False))
    return out.withColumn("repaired", repaired).withColumn(name, F.when(F.col("repaired"), filled).otherwise(F.col(value))).drop("__a", "__b")


def difference(df: DataFrame, keys: Sequence[str], value: str, name: str, seq: str = "seq") -> DataFrame:
    """Add value minus the row before's; null in the first row."""
    return framed(df, keys, 1, 0, lambda w: {name: F.col(value) - F.lag(value).over(w)}, seq)


def crossing_frequency(df: DataFrame, keys: Sequence[str], value: str, period: float | Column, rate: float | Column, name: str, seq: str = "seq") -> DataFrame:
    """Add the local frequency from upward zero crossings of value less its causal mean over two periods (three rows at least).

    period and rate may be columns that are one in a segment. A crossing sets rate / (rows since the one before) from its own row on;
    before the second crossing the frequency is rate / period.
    """
    x = known(F.col(value))
    width = max(3, round(2 * period)) if not isinstance(period, Column) else F.greatest(F.bround(2 * F.greatest(period, F.lit(1.0)), 0), F.lit(3.0)).cast("long")
    period, rate = (c if isinstance(c, Column) else F.lit(float(c)) for c in (period, rate))
    base = frames(df, keys, {"__mean": (x, width, "causal", "mean")}, seq).withColumn("__d", x - F.col("__mean"))
    up = lambda w: {"__up": (F.lag("__d").over(w) < 0) & (F.col("__d") >= 0)}
    marked = framed(base, keys, 1, 0, up, seq).withColumn("__chunk", chunk_of(seq)).withColumn("__here", F.when(F.col("__up"), F.col(seq)))
    # the last two crossings of each chunk, carried over to the chunks after it
    two = F.slice(F.sort_array(F.collect_list("__here"), asc=False), 1, 2)
    ends = marked.groupBy(*keys, "__chunk").agg(two.alias("__two")).withColumns({"__z": F.get("__two", F.lit(0)), "__y": F.get("__two", F.lit(1))})
    earlier = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("__far", F.last("__z", ignorenulls=True).over(earlier))
    pair = F.when(F.col("__z").isNotNull(), F.struct(F.col("__z").alias("z"), F.coalesce("__y", "__far").alias("y")))
    far = ends.select(*keys, "__chunk", F.last(pair, ignorenulls=True).over(earlier).alias("__far"))
    own = W.partitionBy(*keys, "__chunk").orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    joined = marked.join(far, [*keys, "__chunk"]).withColumn("__prior", F.coalesce(F.last("__here", ignorenulls=True).over(own), "__far.z"))
    gap = F.when(F.col("__up") & F.col("__prior").isNotNull(), rate / (F.col(seq) - F.col("__prior")))
    before = F.when(F.col("__far.y").isNotNull(), rate / (F.col("__far.z") - F.col("__far.y")))
    held = joined.withColumn("__gap", gap).withColumn("__f", F.coalesce("__gap", F.last("__gap", ignorenulls=True).over(own), before))
    return held.withColumn(name, F.coalesce("__f", rate / period)).drop("__mean", "__d", "__up", "__here", "__chunk", "__far", "__prior", "__gap", "__f")


def cumulative_phase(df: DataFrame, keys: Sequence[str], frequency: Column, rate: float, name: str, seq: str = "seq") -> DataFrame:
    """Add the phase (radians) that a frequency has passed through up to each row."""
    import math

    return running_sum(df, keys, frequency * (2 * math.pi / rate), name, seq)


def peak_candidates(df: DataFrame, keys: Sequence[str], value: str, seq: str = "seq") -> DataFrame:
    """Rows above the row before and not below the row after; never the first or last row."""
    v = F.col(value)
    peak = lambda w: {"__peak": (v > F.lag(value).over(w)) & (v >= F.lead(value).over(w))}
    return framed(df, keys, 1, 1, peak, seq).where("__peak").drop("__peak")


def prominent_peaks(df: DataFrame, keys: Sequence[str], value: str, distance: int, least: float, seq: str = "seq") -> DataFrame:
    """Peak candidates with their prominence within distance // 2 rows on either side, `least` at least."""
    half = max(1, distance // 2)
    v = F.col(value)

    def build(w):
        left, right = F.min(value).over(w.rowsBetween(-half, 0)), F.min(value).over(w.rowsBetween(0, half))
        return {"__peak": (v > F.lag(value).over(w)) & (v >= F.lead(value).over(w)), "prominence": v - F.greatest(left, right)}

    return framed(df, keys, half, half, build, seq).where(F.col("__peak") & (F.col("prominence") >= least)).drop("__peak")


def spaced_peaks(peaks: DataFrame, keys: Sequence[str], value: str, distance: int | Column, seq: str = "seq") -> DataFrame:
    """Of peaks closer than `distance` rows (a number, or a column that is one in a segment) keep the strongest, greedily; equal ones by the later row, missing heights last.

    A peak stays if no higher one that stays is nearer than the distance, so a
    chunk settles its own peaks but for those whose fate comes from beyond what
    it sees. These go into the next round, between other borders, with the kept
    peaks near them; a few thousand are settled at once. So the rounds are one
    or two, and more only for a trend of heights that is longer than a chunk:
    each round settles half a chunk of it at least. No group is above a chunk
    and its edges (some distances on either side).
    """
    from pyspark.sql import Observation

    from tidewright.session import cut, ship_package

    ship_package(peaks.sparkSession)
    keys, peaks, chunk = list(keys), cut(peaks), chunk_size()
    away = distance if isinstance(distance, Column) else F.lit(distance)
    todo = peaks.select(*keys, F.col(seq).cast("long").alias("__seq"), F.col(value).cast("double").alias("__height"), F.greatest(away, F.lit(1)).cast("long").alias("__away"), F.lit(False).alias("__kept"))
    halo = F.greatest(F.col("__away"), F.least(8 * F.col("__away"), F.lit(chunk // 4)))
    kept, turn, at_once = None, 0, False
    while True:
        # borders move by half a chunk from round to round
        shift = 0 if at_once else turn % 2 * (chunk // 2)
        placed = todo.withColumn("__at", F.col("__seq") + shift)
        dealt = placed.withColumn("__chunk", F.lit(0).cast("long")) if at_once else spread(placed, halo, halo, "__at", chunk)
        seen = Observation()
        settled = dealt.groupBy(*keys, "__chunk").applyInArrow(_settling(len(keys), chunk, shift, at_once), todo.schema)
        settled = cut(settled.observe(seen, F.sum(F.when(F.col("__kept"), 0).otherwise(1)).alias("open")))
        own = settled.where("__kept").drop("__kept")
        kept = own if kept is None else kept.union(own)
        left = seen.get["open"] or 0
        if not left:
            break
        open_ = settled.where("NOT __kept")
        near = F.floor(F.col("__seq") / F.col("__away"))
        around = open_.select(*keys, F.explode(F.sequence(near - 1, near + 1)).alias("__near")).distinct()
        beside = kept.withColumn("__near", near).join(around, [*keys, "__near"], "left_semi").select(*keys, "__seq", "__height", "__away", F.lit(True).alias("__kept"))
        todo, turn, at_once = open_.union(beside), turn + 1, left <= chunk
    return peaks.join(kept.select(*keys, F.col("__seq").alias(seq)), [*keys, seq], "left_semi")


def _settling(n_keys: int, chunk: int, shift: int, whole: bool):
    """A function of one chunk's peaks that returns its own newly kept ones (`__kept`) and those that stay open."""

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("__seq").to_numpy(), kind="stable")))
        place, distance = table.column("__seq").to_numpy(), table.column("__away")[0].as_py()
        height = np.nan_to_num(table.column("__height").fill_null(float("nan")).to_numpy(), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        before = table.column("__kept").to_numpy()
        # what is seen reaches from low to high; before the first row there is nothing to see
        own, halo = key[n_keys].as_py(), max(distance, min(8 * distance, chunk // 4))
        low, high = own * chunk - halo + 1 - shift, (own + 1) * chunk + halo - shift
        a, b = np.searchsorted(place, place - distance + 1), np.searchsorted(place, place + distance)
        hidden = np.zeros(len(place), bool) if whole else ((place - distance < low - 1) & (low > 1)) | (place + distance > high + 1)
        gone, unsure, stays = np.zeros(len(place), bool), hidden & ~before, before.copy()
        for i in np.lexsort((place, height))[::-1].tolist():
            if gone[i]:
                continue
            reach_ = slice(a[i], b[i])
            if stays[i] or not unsure[i]:
                stays[i] = True
                gone[reach_] = True
                gone[i] = False
            else:
                unsure[reach_] = True  # it is higher than all in its reach that come later
        out = ~gone & ~before if whole else ~gone & ~before & ((place + shift - 1) // chunk == own)
        picked = table.select([*table.column_names[:n_keys], "__seq", "__height", "__away"]).filter(pa.array(out))
        return picked.append_column("__kept", pa.array(stays[out]))

    return settle


def lagged_samples(peaks: DataFrame, keys: Sequence[str], height: str, time: str, inputs: int, targets: int, rank: str = "rank") -> DataFrame:
    """Supervised samples of peaks numbered by `rank`: `inputs` peaks up to one, `targets` after it, with the time since the peak before each."""

    def build(w):
        at = {f"in_h_{j}": F.lag(height, inputs - 1 - j).over(w) for j in range(inputs)}
        at |= {f"in_dt_{j}": F.lag(time, inputs - 1 - j).over(w) - F.lag(time, inputs - j).over(w) for j in range(inputs)}
        at |= {f"target_h_{j}": F.lead(height, j + 1).over(w) for j in range(targets)}
        at |= {f"target_dt_{j}": F.lead(time, j + 1).over(w) - (F.lead(time, j).over(w) if j else F.col(time)) for j in range(targets)}
        return at

    out = framed(peaks, keys, inputs, targets, build, rank)
    return out.where(F.col("in_dt_0").isNotNull() & F.col(f"target_dt_{targets - 1}").isNotNull())


def window_starts(lengths: DataFrame, n: str, seq_len: int, pred_len: int, stride: int, shift: int = 0, mode: str = "past") -> DataFrame:
    """Add `start` (0-based): one row for each window that fits into n rows.

    A past window needs seq_len + shift + pred_len rows, a centred one seq_len.
    """
    need = seq_len + shift + pred_len if mode == "past" else seq_len
    count = F.floor((F.col(n) - need) / F.lit(stride)) + 1
    fit = lengths.where(F.col(n) >= need)
    return fit.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda k: k * stride)))


def spaced_starts(starts: DataFrame, keys: Sequence[str], most: int, stride: int, start: str = "start") -> DataFrame:
    """Of each segment's window starts (0, stride, ...) `most` evenly spaced ones, first and last included: places round(k * (n - 1) / (most - 1)), halves to even."""
    if most < 1:
        raise ValueError("one window at least")
    n = F.col("__n")
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * ((n - 1) / F.lit(float(max(most - 1, 1)))), 0).cast("long"))
    chosen = starts.groupBy(*keys).agg(F.count("*").alias("__n")).select(*keys, F.when(n > most, F.array_distinct(places)).alias("__places"))
    held = starts.join(chosen, list(keys))
    return held.where(F.col("__places").isNull() | F.array_contains("__places", (F.col(start) / F.lit(stride)).cast("long"))).drop("__places")


def window_arrays(df: DataFrame, keys: Sequence[str], value: str, seq_len: int, pred_len: int, stride: int, shift: int = 0, seq: str = "seq") -> DataFrame:
    """(keys, start, x, y): the inputs and targets of each past window; windows with a null are left out.

    A chunk's values are put in order once, with those that its last windows
    reach, and its windows leave the task a few at a time: no row holds a chunk.
    """
    from tidewright.session import ship_package

    ship_package(df.sparkSession)
    keys, need, size = list(keys), seq_len + shift + pred_len, chunk_size()
    each = max(1, PORTION // need)
    head, ahead = np.arange(seq_len), np.arange(seq_len + shift, need)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        values = table.column(value).combine_chunks().take(pa.array(np.argsort(table.column(seq).to_numpy())))
        low, gaps = key[len(keys)].as_py() * size, np.concatenate(([0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))))
        at = np.arange(-low % stride, min(size, len(values) - need + 1), stride)
        lack = lambda a, n: gaps[a + n] - gaps[a]
        at = at[(lack(at, seq_len) == 0) & (lack(at + seq_len + shift, pred_len) == 0)]
        for k in range(0, len(at), each):
            own = at[k : k + each]
            arrays = [pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * len(j), pa.int32()), values.take(pa.array((own[:, None] + j).ravel()))) for j in (head, ahead)]
            yield pa.RecordBatch.from_arrays([*[pa.repeat(c, len(own)) for c in key[: len(keys)]], pa.array(own + low), *arrays], [*keys, "start", "x", "y"])

    kind = df.schema[value].dataType.simpleString()
    fields = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys], f"start long, x array<{kind}>, y array<{kind}>"])
    return spread(df.select(*keys, seq, value), 0, need, seq).groupBy(*keys, "__chunk").applyInArrow(run, fields)


def windowed_rows(df: DataFrame, width: int, stride: int, seq: str = "seq") -> DataFrame:
    """Rows with the number (`win`, 0-based) of each full-length analysis window that holds them; a window may miss its end."""
    at = F.col(seq) - 1
    low = F.greatest(F.ceil((at - width + 1) / F.lit(stride)), F.lit(0)).cast("long")
    high = F.floor(at / F.lit(stride)).cast("long")
    return df.where(low <= high).withColumn("win", F.explode(F.sequence(low, high)))


def delay_embedding(df: DataFrame, keys: Sequence[str], value: str, dim: int, delay: int, ahead: int = 0, seq: str = "seq") -> DataFrame:
    """Rows with `embedding` = (x[t], x[t + delay], ...), those whose last part and `ahead` rows more exist."""
    span = (dim - 1) * delay + ahead

    def build(w):
        return {"embedding": F.array(*[F.lead(value, k * delay).over(w) for k in range(dim)]), "__end": F.lead(seq, span).over(w) if span else F.col(seq)}

    return framed(df, keys, 0, span, build, seq).where("__end IS NOT NULL").drop("__end")


