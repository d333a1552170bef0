"""Scalar functions of signals and names, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.operators.ordered import finite

__all__ = ["finite"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def signed_log1p(x: Column | str) -> Column:
    return F.signum(_c(x)) * F.log1p(F.abs(_c(x)))


def clip(x: Column | str, low: Column | float, high: Column | float) -> Column:
    bound = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.greatest(F.least(_c(x), bound(high)), bound(low))


def transform(x: Column | str, mode: str) -> Column:
    """none, abs or square; the rms mode is a window (operators.windows.moving_rms)."""
    if mode not in ("none", "abs", "square"):
        raise ValueError(f"no such transform: {mode}")
    x = _c(x)
    return {"none": x, "abs": F.abs(x), "square": x * x}[mode]


def standardised(x: Column | str, mean: Column, std: Column, least: float = 1e-12) -> Column:
    """(x - mean) / std; a std of `least` or less counts as 1."""
    return (_c(x) - mean) / F.when(std <= least, 1.0).otherwise(std)


def round_to(x: Column | str, quantum: Column | float, least: Column | float) -> Column:
    """The multiple of quantum nearest to x, halves to even, `least` at least."""
    q = quantum if isinstance(quantum, Column) else F.lit(float(quantum))
    low = least if isinstance(least, Column) else F.lit(float(least))
    return F.greatest(F.bround(_c(x) / q, 0) * q, low)


def cycle_phase(seq: Column | str, period: Column | float) -> tuple[Column, Column]:
    """Sine and cosine of the phase of a 1-based row number in cycles of `period` rows."""
    p = period if isinstance(period, Column) else F.lit(float(period))
    angle = F.lit(2 * math.pi) * (_c(seq) - 1) / p
    return F.sin(angle), F.cos(angle)


def weight(x: Column | str, bias: float, scale: float) -> Column:
    """bias + scale * max(x, 0)."""
    return F.lit(float(bias)) + F.lit(float(scale)) * F.greatest(_c(x), F.lit(0.0))


def safe_name(x: Column | str, default: str = "item") -> Column:
    """Runs of other characters than letters, digits, '_', '.' and '-' become '_'; none at the ends."""
    out = F.regexp_replace(F.regexp_replace(_c(x), r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def tag_name(x: Column | str, most: int = 48, default: str = "na") -> Column:
    """Runs of other characters than letters, digits, '_', '.' and '-' become '-'; none at the ends, `most` characters at most."""
    out = F.regexp_replace(F.regexp_replace(_c(x), r"[^A-Za-z0-9_.-]+", "-"), r"^-+|-+$", "")
    return F.substring(F.coalesce(F.nullif(out, F.lit("")), F.lit(default)), 1, most)


def file_name(x: Column | str) -> Column:
    """Each character that is no letter or digit of any script, '.', '_' or '-' becomes '_'."""
    return F.regexp_replace(_c(x), r"[^\p{L}\p{N}._-]", "_")


# Parts of a name that tell a smoothed wave.
SMOOTHED = ("smooth", "ma", "cma", "main")


def same_waveform(a: Column | str, b: Column | str) -> Column:
    """Whether two column names seem to name one wave: equal in any case, or both smoothed, and both raw or neither."""
    x, y = F.lower(_c(a)), F.lower(_c(b))
    smoothed = lambda n: F.exists(F.array(*map(F.lit, SMOOTHED)), lambda t: F.contains(n, t))
    raw = lambda n: F.contains(n, F.lit("raw"))
    return (x == y) | ((raw(x) == raw(y)) & smoothed(x) & smoothed(y))


def away_from_zero(x: Column | str, eps: float) -> Column:
    """Whether x is further from zero than eps; false for a missing sample."""
    return F.coalesce(F.abs(_c(x)) > F.lit(float(eps)), F.lit(False))


def in_time(time: Column | str, start: float | None, end: float | None) -> Column:
    """Whether a time is in [start, end], both ends included; None is no limit."""
    ok = F.lit(True)
    for limit, test in ((start, lambda v: _c(time) >= v), (end, lambda v: _c(time) <= v)):
        ok = ok & test(F.lit(float(limit))) if limit is not None else ok
    return ok


def first_positive(*values: Column | float | None) -> Column:
    """The first value above 0."""
    cols = [v if isinstance(v, Column) else F.lit(v).cast("double") for v in values]
    return F.coalesce(*[F.when(c > 0, c) for c in cols])


def resolved_period(given: float | None, profile: Column, estimate: Column, rate: Column) -> Column:
    """The period in samples: given, of the profile, estimated, or a second of samples (8 at least)."""
    return first_positive(given, profile, estimate, F.greatest(F.lit(8.0), rate))


def resolved_window(given: int | None, profile: Column, period: Column) -> Column:
    """The smoothing window: given, of the profile (rounded), or a tenth of the period (3 at least)."""
    tenth = F.greatest(F.lit(3.0), F.bround(period / 10, 0))
    return first_positive(given, F.bround(profile.cast("double"), 0), tenth).cast("long")


# Multiples of the dominant frequency between which the relative bands lie.
BAND_EDGES = (0.5, 1.5, 3.0, 6.0, 10.0, 16.0)


def relative_bands(dominant: Column, rate: Column, count: int = 3) -> Column:
    """Array of `count` (low, high) bands around multiples of the dominant frequency, below 0.98 of the Nyquist frequency.

    Equal parts of the spectrum where there is no dominant frequency. Bands
    beyond the Nyquist frequency are left out, (0, 0) fills up their number.
    """
    top = F.greatest(rate / 2, F.lit(1e-12))
    step = 0.88 * top / count
    equal = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct((0.02 * top + step * i).alias("low"), (0.02 * top + step * (i + 1)).alias("high")))
    edges = F.array(*[F.lit(e) for e in BAND_EDGES])

    def band(i: Column) -> Column:
        low = F.greatest(F.lit(1e-6), F.get(edges, i) * dominant)
        high = F.least(0.98 * top, F.get(edges, i + 1) * dominant)
        return F.struct(low.alias("low"), F.when(high > low, high).otherwise(F.least(0.98 * top, low * 1.5)).alias("high"))

    made = F.filter(F.transform(F.sequence(F.lit(0), F.lit(min(count, len(BAND_EDGES) - 1) - 1)), band), lambda b: (b["high"] > b["low"]) & (b["low"] < top))
    none = F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))
    return F.when(dominant > 0, F.slice(F.concat(made, F.array_repeat(none, count)), 1, count)).otherwise(equal)


def json_safe(x: Column | str) -> Column:
    """A number as JSON has it: null where it is not finite."""
    return F.when(finite(_c(x)), _c(x))


def listed(x: Column | str) -> Column:
    """The trimmed, non-empty parts of a comma-separated text."""
    return F.filter(F.transform(F.split(_c(x), ","), lambda p: F.trim(p)), lambda p: p != "")


def signature(columns: Column | str) -> Column:
    """The first 8 hex digits of the MD5 of an array of names joined by commas."""
    return F.substring(F.md5(F.array_join(_c(columns), ",").cast("binary")), 1, 8)


def next_power_of_two(n: Column | str) -> Column:
    return F.when(_c(n) <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(_c(n)))).cast("long"))


def predictability_score(energy: Column, acf: Column, entropy: Column, residual: Column) -> Column:
    """0 to 1: energy and autocorrelation at the dominant period raise it, entropy and residual energy lower it."""
    # fixed values: the four coefficients
    raw = 0.35 * energy + 0.35 * F.greatest(acf, F.lit(0.0)) + 0.15 * (1 - entropy) + 0.15 * (1 - F.least(residual, F.lit(1.0)))
    return clip(raw, 0.0, 1.0)


# The ids of signal types.
TYPE_IDS = {"stable_single_freq": 0, "noisy_single_freq": 1, "am_fm_modulated": 2, "spike_event": 3, "multi_freq": 4, "weak_periodic": 5}


def type_id(name: Column | str) -> Column:
    """The id of a signal type, -1 for an unknown one."""
    table = F.create_map(*[F.lit(x) for kv in TYPE_IDS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, _c(name)), F.lit(-1))


def seconds_range(seq: Column | str, rate: float, start: float, end: float | None, duration: float | None) -> Column:
    """Whether a 1-based row is in [round(start * rate), min(round(end * rate), first + round(duration * rate))), halves to even."""
    half = lambda x: int(round(x * rate))  # noqa: E731  Python rounds halves to even
    first = max(0, half(start))
    ends = [e for e in (half(end) if end is not None else None, first + half(duration) if duration is not None else None) if e is not None]
    inside = _c(seq) - 1 >= first
    return inside & (_c(seq) - 1 < min(ends)) if ends else inside


def frequency_bounds(rate: Column, min_hz: float = 0.0, max_hz: float = 0.0, min_period: float = 0.0, max_period: float = 0.0) -> tuple[Column, Column]:
    """Lowest and highest frequency (Hz) that limits in Hz and in seconds of a period leave, the Nyquist frequency at most; 0 is no limit."""
    low = max([0.0, min_hz] + ([1 / max_period] if max_period > 0 else []))
    highs = [x for x in (max_hz, 1 / min_period if min_period > 0 else 0.0) if x > 0]
    return F.lit(float(low)), F.least(rate / 2, F.lit(float(min(highs)))) if highs else rate / 2
