"""Recursive filters and peaks of segments of any length, on chunks packed as arrays.

A segment's samples are put in order once, a row for each chunk with an array
of its values; what follows reads these rows and shuffles samples no more than
it must. A filter's state passes through a chunk by an affine map, so the maps
of the chunks are composed in a small table with a row for each chunk, and
every chunk is then filtered from its own state. What a peak has to find
beyond its chunk is looked up in a segment's outline (a few numbers of each
chunk), and then asked of the one chunk that has it. Results don't depend on
the size of a chunk.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tidewright.functions import kernels
from tidewright.operators.ordered import chunk_of, chunk_size, known
from tidewright.session import cut, ship_package

#: Fewest samples that a band-pass works on.
LEAST = 16


def kinds(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names]


def packed(df: DataFrame, keys: Sequence[str], value: Column, seq: str = "seq") -> DataFrame:
    """(keys, __chunk, __x): the values of each chunk in order as an array; missing samples are NaN."""
    ship_package(df.sparkSession)
    keys = list(keys)
    rows = df.select(*keys, F.col(seq).cast("long").alias("__s"), chunk_of(seq).alias("__chunk"), F.coalesce(known(value), F.lit(float("nan"))).alias("__x"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = table.column("__x").to_numpy()[np.argsort(table.column("__s").to_numpy())]
        return pa.table([*[pa.array([k.as_py()], k.type) for k in key], pa.array([x], pa.list_(pa.float64()))], [*keys, "__chunk", "__x"])

    return rows.groupBy(*keys, "__chunk").applyInArrow(run, ", ".join([*kinds(df, keys), "__chunk long, __x array<double>"]))


def each(chunks: DataFrame, kept: Sequence[str], fields: str, make: Callable[[dict], list[dict]]) -> DataFrame:
    """Rows that make(row) gives for each row of chunks (arrays as numpy), with the columns `kept` of that row; fields are theirs."""
    names = [f.name for f in chunks.schema.fields]
    made = [f.split()[0].strip("`") for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {}
                for c in names:
                    cell = batch.column(c)[i]
                    row[c] = cell.values.to_numpy(zero_copy_only=False) if isinstance(cell, pa.ListScalar) and pa.types.is_primitive(cell.type.value_type) and cell.is_valid else cell.as_py()
                out = make(row)
                if out:
                    own = batch.slice(i, 1).select(list(kept)).take(pa.array([0] * len(out)))
                    columns = [*own.columns, *[pa.array([o[c] for o in out], kind) for c, kind in zip(made, types)]]
                    yield pa.RecordBatch.from_arrays(columns, [*kept, *made])

    types = [to_arrow_type(f.dataType) for f in StructType.fromDDL(fields).fields]
    return chunks.mapInArrow(run, ", ".join([*kinds(chunks, kept), fields]))


def carried(table: DataFrame, keys: Sequence[str], fields: str, make: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """make(rows) of each segment's rows of a small table, a row for each chunk, in the order of chunks."""
    keys, schema = list(keys), StructType.fromDDL(fields)
    types, names = [to_arrow_type(f.dataType) for f in schema.fields], schema.names

    def run(key: tuple, own: pa.Table) -> pa.Table:
        rows = make(sorted(own.to_pylist(), key=lambda r: r["__chunk"]))
        columns = [pa.array([r[f] for r in rows], t) for f, t in zip(names, types)]
        return pa.table([*[pa.array([k.as_py()] * len(rows), k.type) for k in key], *columns], [*keys, *names])

    return table.groupBy(*keys).applyInArrow(run, ", ".join([*kinds(table, keys), fields]))


# Filters -----------------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=4096)
def _sections(low: float, high: float, rate: float) -> tuple:
    """Sections of a band, the matrix that its states pass through in one step, and its steady states; empty for no band."""
    nyquist = rate / 2
    top = min(high, 0.98 * nyquist)
    if rate <= 0 or low <= 0 or top <= low or low >= nyquist:
        return ()
    sections = kernels.band_sections(low / nyquist, top / nyquist)
    step = np.column_stack([np.ravel(kernels.filtered(sections, np.zeros(1), unit.reshape(-1, 2))[1]) for unit in np.eye(2 * len(sections))])
    return sections, step, np.ravel(kernels.steady(sections))


@functools.lru_cache(maxsize=4096)
def _power(low: float, high: float, rate: float, n: int) -> np.ndarray:
    return np.linalg.matrix_power(_sections(low, high, rate)[1], n)


def _filtered(sections, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y, after = kernels.filtered(sections, x, np.reshape(state, (-1, 2)))
    return y, np.ravel(after)


def _bands(row: dict) -> list[tuple[float, float, float]]:
    return [(b["low"], b["high"], row["__rate"]) for b in row["__bands"]]


def banded(chunks: DataFrame, keys: Sequence[str], zero_phase: bool = False) -> DataFrame:
    """(keys, __chunk, __y) of chunks (keys, __chunk, __x, __n, __rate, __bands): for each band the filtered values of the chunk, one array.

    __n is the segment's length, __bands an array of (low, high) in the units
    of __rate; a band that is empty or beyond the Nyquist frequency is zeros,
    and so are all of a segment below LEAST samples. With zero_phase the filter
    runs over the segment and back, with its ends mirrored through their last
    values, from the states of a steady input.
    """
    keys = list(keys)
    base = [*keys, "__chunk", "__n", "__rate", "__bands"]
    pad_of = lambda r: min(r["__n"] - 1, 3 * (2 * 4 + 1))
    fine = lambda r: [(b, _sections(*b)) for b in _bands(r)] if r["__n"] >= LEAST else []

    def forward(row: dict) -> list[dict]:
        x, pad = row["__x"], pad_of(row)
        after = [_filtered(s[0], x, np.zeros(8))[1] if s else np.zeros(8) for _, s in fine(row)]
        return [{"__count": len(x), "__after": np.ravel(after).tolist(), "__head": x[: pad + 1], "__tail": x[-pad - 1 :] if pad >= 0 else x[:0]}]

    def mirrored(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        pad = pad_of(rows[0])
        head = np.concatenate([r["__head"] for r in rows[: pad + 2]])[: pad + 1]
        tail = np.concatenate([r["__tail"] for r in rows[-pad - 2 :]])[-pad - 1 :]
        return 2 * head[0] - head[pad:0:-1], 2 * tail[-1] - tail[-2::-1][:pad]

    def compose(rows: list[dict]) -> list[dict]:
        out = [{"__chunk": r["__chunk"], "__enter": [], "__back": []} for r in rows]
        for k, (band, own) in enumerate(fine(rows[0])):
            state, back = np.zeros(8), np.zeros(8)
            if own and zero_phase:
                front, end = mirrored(rows)
                state = _filtered(own[0], front, own[2] * front[0])[1] if len(front) else own[2] * rows[0]["__head"][0]
            for r, o in zip(rows, out):
                o["__enter"] += state.tolist()
                if own:
                    state = _power(*band, r["__count"]) @ state + np.array(r["__after"][8 * k : 8 * k + 8])
            if own and zero_phase:
                y = _filtered(own[0], end, state)[0]
                back = _filtered(own[0], y[::-1], own[2] * y[-1])[1]
            out[-1]["__back"] += back.tolist()
        return out

    first = each(chunks, base, "__count long, __after array<double>, __head array<double>, __tail array<double>", forward)
    states = carried(first, keys, "__chunk long, __enter array<double>, __back array<double>", compose)
    states = cut(states) if zero_phase else states
    held = chunks.join(states, [*keys, "__chunk"])

    def passed(row: dict) -> list[np.ndarray]:
        own = fine(row)
        return [_filtered(s[0], row["__x"], row["__enter"][8 * k : 8 * k + 8])[0] if s else np.zeros(len(row["__x"])) for k, (_, s) in enumerate(own)] if own else [np.zeros(len(row["__x"])) for _ in row["__bands"]]

    if not zero_phase:
        return each(held, [*keys, "__chunk"], "__y array<array<double>>", lambda row: [{"__y": passed(row)}])

    def backward(row: dict) -> list[dict]:
        after = [_filtered(s[0], y[::-1], np.zeros(8))[1] if s else np.zeros(8) for (_, s), y in zip(fine(row), passed(row))]
        return [{"__count": len(row["__x"]), "__after": np.ravel(after).tolist(), "__start": row["__back"]}]

    def compose_back(rows: list[dict]) -> list[dict]:
        out = [{"__chunk": r["__chunk"], "__leave": []} for r in rows]
        for k, (band, own) in enumerate(fine(rows[0])):
            state = np.array(rows[-1]["__start"][8 * k : 8 * k + 8])
            for r, o in zip(rows[::-1], out[::-1]):
                o["__leave"] += state.tolist()
                if own:
                    state = _power(*band, r["__count"]) @ state + np.array(r["__after"][8 * k : 8 * k + 8])
        return out

    second = each(held, base, "__count long, __after array<double>, __start array<double>", backward)
    returned = carried(second, keys, "__chunk long, __leave array<double>", compose_back)

    def both(row: dict) -> list[dict]:
        ys = passed(row)
        return [{"__y": [_filtered(s[0], y[::-1], row["__leave"][8 * k : 8 * k + 8])[0][::-1] if s else y for k, ((_, s), y) in enumerate(zip(fine(row), ys))] if row["__n"] >= LEAST else ys}]

    return each(held.join(returned, [*keys, "__chunk"]), [*keys, "__chunk"], "__y array<array<double>>", both)


# Peaks -------------------------------------------------------------------------------------------------------------

_OUTLINE = ("most", "least", "first", "first_run", "second", "last", "last_run", "count")


def outlined(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """chunks with the outline of their segment: for each of its chunks the largest, smallest, first and last value, and the lengths of the runs of equal values at its ends."""

    def summary(row: dict) -> list[dict]:
        x = row["__x"]
        change = np.flatnonzero(x[1:] != x[:-1]) + 1
        run = int(change[0]) if len(change) else len(x)
        second = x[run] if len(change) else np.nan
        last = len(x) - int(change[-1]) if len(change) else len(x)
        return [dict(zip(_OUTLINE, map(float, (x.max(), x.min(), x[0], run, second, x[-1], last, len(x)))))]

    def gather(rows: list[dict]) -> list[dict]:
        return [{f"__{c}": [r[c] for r in rows] for c in _OUTLINE}]

    keys = list(keys)
    own = each(chunks.select(*keys, "__chunk", "__x"), [*keys, "__chunk"], ", ".join(f"{c} double" for c in _OUTLINE), summary)
    lines = carried(own, keys, ", ".join(f"__{c} array<double>" for c in _OUTLINE), gather)
    return chunks.join(lines, keys) if keys else chunks.crossJoin(F.broadcast(lines))


def tops(pieces: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """(keys, seq, height): local maxima; of flat ones the middle, rounded down; never an end of the segment."""

    def find(row: dict) -> list[dict]:
        x, c = row["__x"], row["__chunk"]
        begin = np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))
        length = np.diff(np.append(begin, len(x)))
        v = x[begin]
        before = np.concatenate(([row["__last"][c - 1] if c else np.nan], v[:-1]))
        after = np.append(v[1:], np.nan)
        # the last run may go on in the next chunks
        d = c + 1
        while d < len(row["__count"]) and row["__first"][d] == v[-1]:
            length[-1] += int(row["__first_run"][d])
            if row["__first_run"][d] < row["__count"][d]:
                break
            d += 1
        if d < len(row["__count"]):
            after[-1] = row["__second"][d] if row["__first"][d] == v[-1] else row["__first"][d]
        at = np.flatnonzero((v > before) & (v > after))  # a run that goes on from the chunk before equals its last value
        return [{"seq": int(c * size + begin[i] + (length[i] - 1) // 2 + 1), "height": float(v[i])} for i in at]

    return each(pieces, keys, "seq long, height double", find)


class Blocks:
    """Nearest values of an array above or below a level, by the extremes of its blocks."""

    SIZE = 256

    def __init__(self, x: np.ndarray, above: bool):
        self.x = x if above else -x
        padded = np.append(self.x, np.full(-len(x) % self.SIZE, -np.inf)).reshape(-1, self.SIZE)
        self.most = padded.max(1)

    def left(self, end: int, level: float, strict: bool) -> int:
        """The last place before `end` whose value passes the level; -1 if none."""
        ok = (lambda v: v > level) if strict else (lambda v: v >= level)
        block = max(0, (end - 1) // self.SIZE)
        hit = np.flatnonzero(ok(self.x[block * self.SIZE : end]))
        if len(hit):
            return block * self.SIZE + int(hit[-1])
        far = np.flatnonzero(ok(self.most[:block]))
        if not len(far):
            return -1
        start = int(far[-1]) * self.SIZE
        return start + int(np.flatnonzero(ok(self.x[start : start + self.SIZE]))[-1])

    def right(self, begin: int, level: float, strict: bool) -> int:
        """The first place from `begin` on whose value passes the level; -1 if none."""
        ok = (lambda v: v > level) if strict else (lambda v: v >= level)
        stop = (begin // self.SIZE + 1) * self.SIZE
        hit = np.flatnonzero(ok(self.x[begin:stop]))
        if len(hit):
            return begin + int(hit[0])
        far = np.flatnonzero(ok(self.most[stop // self.SIZE :]))
        if not len(far):
            return -1
        start = stop + int(far[0]) * self.SIZE
        return start + int(np.flatnonzero(ok(self.x[start : start + self.SIZE]))[0])


def _meet(pieces: DataFrame, asks: DataFrame, keys: list[str], at: Column, size: int, fields: str, answer: Callable) -> DataFrame:
    """answer(piece, ask) for every ask (a struct with seq, ...) in the chunk that it goes to."""
    grouped = asks.groupBy(*keys, at.cast("long").alias("__chunk")).agg(F.collect_list(F.struct(*[c for c in asks.columns if c not in keys])).alias("__asks"))

    def run(row: dict) -> list[dict]:
        up, down = Blocks(row["__x"], True), Blocks(row["__x"], False)
        return [o for a in row["__asks"] for o in answer(row, up, down, a)]

    return each(pieces.join(grouped, [*keys, "__chunk"]), keys, fields, run)


def _asked(pieces: DataFrame, peaks: DataFrame, keys: list[str], size: int, fields: str, own: Callable, other: Callable) -> DataFrame:
    """Answers for both sides of each peak: from its chunk and the outline (own), or else from the chunk that these name (other, in __target)."""
    names = [f.split()[0] for f in fields.split(", ")]
    far = Observation()
    found = cut(_meet(pieces, peaks, keys, F.floor((F.col("seq") - 1) / size), size, f"{fields}, __target long", own).observe(far, F.count("__target").alias("n")))
    if not far.get["n"]:
        return found.drop("__target")
    there = _meet(pieces, found.where("__target IS NOT NULL"), keys, F.col("__target"), size, fields, other)
    return found.where("__target IS NULL").drop("__target").union(there.select(*keys, *names))


def prominences(pieces: DataFrame, peaks: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """(keys, seq, height, prominence) of peaks (keys, seq, height): height less the higher of the lowest values before a higher one on either side."""
    keys = list(keys)

    def own(row: dict, up: Blocks, down: Blocks, ask: dict) -> list[dict]:
        x, c, h = row["__x"], row["__chunk"], ask["height"]
        p = ask["seq"] - 1 - c * size
        a, b = up.left(p, h, True), up.right(p + 1, h, True) if p + 1 < len(x) else -1
        out = {"seq": ask["seq"], "height": h, "__target": None}
        left, right = float(x[a + 1 : p + 1].min()), float(x[p : b if b >= 0 else len(x)].min())
        low, high = None, None
        if a < 0 and c:
            far = np.flatnonzero(row["__most"][:c] > h)
            low = int(far[-1]) if len(far) else None
            left = min(left, float(row["__least"][0 if low is None else low + 1 : c].min(initial=np.inf)))
        if b < 0 and c + 1 < len(row["__count"]):
            far = np.flatnonzero(row["__most"][c + 1 :] > h)
            high = c + 1 + int(far[0]) if len(far) else None
            right = min(right, float(row["__least"][c + 1 : high].min(initial=np.inf)))
        return [out | {"side": 0, "low": left, "__target": low}, out | {"side": 1, "low": right, "__target": high}]

    def other(row: dict, up: Blocks, down: Blocks, ask: dict) -> list[dict]:
        x, h = row["__x"], ask["height"]
        part = x[up.left(len(x), h, True) + 1 :] if ask["side"] == 0 else x[: up.right(0, h, True)]
        return [{"seq": ask["seq"], "height": h, "side": ask["side"], "low": min(ask["low"], float(part.min(initial=np.inf)))}]

    sides = _asked(pieces, peaks.select(*keys, "seq", "height"), keys, size, "seq long, height double, side int, low double", own, other)
    return sides.groupBy(*keys, "seq", "height").agg((F.col("height") - F.max("low")).alias("prominence"))


def half_widths(pieces: DataFrame, peaks: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """peaks (keys, seq, height, prominence above 0) with `width` at half the prominence, its ends interpolated between samples."""
    keys = list(keys)

    def crossing(row: dict, i: int, level: float, side: int) -> float:
        """The place (from 0 in the segment) where the level is crossed at or inward of sample i of the chunk."""
        x, c = row["__x"], row["__chunk"]
        inner = i + 1 if side == 0 else i - 1
        value = x[inner] if 0 <= inner < len(x) else row["__first"][c + 1] if side == 0 else row["__last"][c - 1]
        part = (level - x[i]) / (value - x[i]) if x[i] < level else 0.0
        return c * size + i + (part if side == 0 else -part)

    def own(row: dict, up: Blocks, down: Blocks, ask: dict) -> list[dict]:
        x, c = row["__x"], row["__chunk"]
        level, p = ask["height"] - 0.5 * ask["prominence"], ask["seq"] - 1 - c * size
        a, b = down.left(p, -level, False), down.right(p + 1, -level, False) if p + 1 < len(x) else -1
        out = []
        for side, i in ((0, a), (1, b)):
            one = {"seq": ask["seq"], "level": level, "side": side, "place": crossing(row, i, level, side) if i >= 0 else 0.0, "__target": None}
            if i < 0:
                low = row["__least"] <= level
                one["__target"] = int(np.flatnonzero(low[:c])[-1]) if side == 0 else c + 1 + int(np.flatnonzero(low[c + 1 :])[0])
            out.append(one)
        return out

    def other(row: dict, up: Blocks, down: Blocks, ask: dict) -> list[dict]:
        i = down.left(len(row["__x"]), -ask["level"], False) if ask["side"] == 0 else down.right(0, -ask["level"], False)
        return [{k: ask[k] for k in ("seq", "level", "side")} | {"place": crossing(row, i, ask["level"], ask["side"])}]

    ends = _asked(pieces, peaks.select(*keys, "seq", "height", "prominence"), keys, size, "seq long, level double, side int, place double", own, other)
    width = ends.groupBy(*keys, "seq").agg((F.max("place") - F.min("place")).alias("width"))
    return peaks.join(width, [*keys, "seq"])


def prominent_peaks(chunks: DataFrame, keys: Sequence[str], distance: Column | int, least: float) -> DataFrame:
    """(keys, seq, height, prominence, width) of the peaks of chunks (keys, __chunk, __x without missing samples): local maxima, spaced by distance, of prominence `least` or more.

    distance may be a column of chunks.
    """
    from tidewright.operators.windows import spaced_peaks

    keys, size = list(keys), chunk_size()
    pieces = cut(outlined(chunks.withColumn("__distance", distance if isinstance(distance, Column) else F.lit(distance)), keys))
    found = tops(pieces, [*keys, "__distance"], size)
    spaced = spaced_peaks(found, keys, "height", F.col("__distance")).drop("__distance")
    peaks = cut(prominences(pieces, spaced, keys, size).where(F.col("prominence") >= least))
    return half_widths(pieces, peaks, keys, size)
