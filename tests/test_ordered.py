"""Chunks, buckets and the order of input rows make no difference to ordered operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import aggregates as A
from tidewright.operators import forecast as FC
from tidewright.operators import joins as J
from tidewright.operators import ordered as O
from tidewright.operators import windows as WN

KEY = ["seg"]


def table(spark, seed=0, sizes=(1, 2, 57, 130)):
    rng = np.random.default_rng(seed)
    rows = []
    for k, n in enumerate(sizes):
        x = np.round(rng.normal(0, 3, n), 2)
        x[rng.random(n) < 0.15] = 0.0
        for i, v in enumerate(x):
            gap = rng.random()
            rows.append((k, i + 1, float(v), None if gap < 0.1 else float("nan") if gap < 0.2 else float(v)))
    rng.shuffle(rows)
    return spark.createDataFrame([(int(a), int(b), float(c), None if d is None else float(d)) for a, b, c, d in rows], "seg int, seq long, x double, gappy double")


OPERATORS = {
    "causal": lambda d: WN.frame_mean(d, KEY, F.col("x"), 7, "causal", "m"),
    "centred": lambda d: WN.frame_mean(d, KEY, F.col("x"), 8, "A", "m"),
    "wide": lambda d: WN.frame_mean(d, KEY, F.col("x"), 70, "B", "m"),
    "wide_causal": lambda d: WN.frame_mean(d, KEY, F.col("x"), 64, "causal", "m"),
    "edge": lambda d: WN.edge_rms(d, KEY, "x", 9, "m"),
    "interpolate": lambda d: WN.interpolate(d, KEY, "gappy", "m").drop("gappy"),
    "repair": lambda d: WN.repair_zero_gaps(d, KEY, "x", "m", 2, 0.5).drop("repaired"),
    "crossing": lambda d: WN.crossing_frequency(d, KEY, "x", 5, 100.0, "m"),
    "running": lambda d: O.running_sum(d, KEY, F.col("x"), "m"),
    "runs": lambda d: O.runs(d.withColumn("up", F.col("x") > 0), KEY, "up", "m").drop("up"),
    "prominent": lambda d: WN.prominent_peaks(d, KEY, "x", 6, 1.0),
    "spaced": lambda d: WN.spaced_peaks(WN.peak_candidates(d, KEY, "x").drop("gappy"), KEY, "x", 5),
    "resample": lambda d: J.resample(d, KEY, "x", 100.0, 37.0),
    "embedding": lambda d: WN.delay_embedding(d, KEY, "x", 3, 4, 2).select("seg", "seq", F.col("embedding")[2].alias("m")),
    "robust": lambda d: A.robust_zscore(d, KEY, "gappy", "m").drop("gappy"),
}


def rows(df):
    return sorted((tuple(round(v, 6) + 0.0 if isinstance(v, float) and v == v else str(v) for v in r) for r in df.select(sorted(df.columns, key=lambda c: (c not in ("seg", "seq", "j"), c))).collect()), key=lambda r: tuple(map(str, r[:2])))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_chunks_make_no_difference(spark, monkeypatch, name):
    d = table(spark)
    want = rows(OPERATORS[name](d))
    monkeypatch.setattr(O, "CHUNK", 11)
    got = rows(OPERATORS[name](d.repartition(5)))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == pytest.approx(y, abs=2e-6) if isinstance(x, float) and isinstance(y, float) else x == y for x, y in zip(a, b))


def series(spark, d, k):
    own = sorted((r.seq, r.x, r.gappy) for r in d.where(F.col("seg") == k).collect())
    return np.array([r[1] for r in own]), np.array([np.nan if r[2] is None else r[2] for r in own])


def test_frames_by_definition(spark, monkeypatch):
    monkeypatch.setattr(O, "CHUNK", 16)
    d = table(spark)
    x, gappy = series(spark, d, 3)
    pick = lambda df: np.array([r.m for r in df.where("seg = 3").orderBy("seq").collect()], float)
    for width, kind in ((4, "A"), (4, "B"), (70, "B"), (65, "A"), (64, "causal")):
        left, right = WN.reach(width, kind)
        want = [x[max(0, i - left) : i + right + 1].mean() for i in range(len(x))]
        assert np.allclose(pick(WN.frame_mean(d, KEY, F.col("x"), width, kind, "m")), want)
        with_gaps = np.where(np.arange(len(gappy)) == 50, np.inf, gappy)
        d2 = d.withColumn("y", F.when(F.col("seq") == 51, float("inf")).otherwise(F.col("gappy")))
        parts = [with_gaps[max(0, i - left) : i + right + 1] for i in range(len(x))]
        assert np.allclose(pick(WN.frame_mean(d2, KEY, F.col("y"), width, kind, "m")), [p[np.isfinite(p)].mean() if np.isfinite(p).any() else np.nan for p in parts], equal_nan=True)
        assert np.allclose(pick(WN.moving_rms(d2, KEY, F.col("y"), width, kind, "m")), [np.sqrt((p[np.isfinite(p)] ** 2).mean()) if np.isfinite(p).any() else np.nan for p in parts], equal_nan=True)
    ok = np.flatnonzero(np.isfinite(gappy))
    assert np.allclose(pick(WN.interpolate(d, KEY, "gappy", "m")), np.interp(np.arange(len(gappy)), ok, gappy[ok]))
    left = 4
    padded = np.pad(x**2, (left, 4), mode="edge")
    assert np.allclose(pick(WN.edge_rms(d, KEY, "x", 9, "m")), np.sqrt(np.convolve(padded, np.ones(9) / 9, "valid")))


def test_causal_frames_see_no_later_rows(spark):
    d = table(spark)
    changed = d.withColumn("x", F.when(F.col("seq") > 60, 99.0).otherwise(F.col("x")))
    for name in ("causal", "wide_causal", "crossing"):
        a, b = (rows(OPERATORS[name](t).where("seq <= 60").drop("gappy")) for t in (d, changed))
        assert a == b


@pytest.mark.parametrize("accuracy", [20_000, 20, 3])
def test_quantiles_are_exact(spark, monkeypatch, accuracy):
    monkeypatch.setattr(O, "ACCURACY", accuracy)
    rng = np.random.default_rng(5)
    rows_ = [(k, float(v)) for k in range(3) for v in np.round(rng.exponential(2, 400), k)] + [(3, 1.5), (4, float("nan")), (4, None), (None, 2.0), (None, 4.0)]
    d = spark.createDataFrame(rows_, "k int, v double")
    at = {"a": 0.0, "b": 0.03, "c": 0.5, "d": 0.951, "e": 1.0}
    got = {r.k: r for r in O.quantiles(d, ["k"], "v", at).collect() if r.k is not None}
    for k in range(4):
        own = [v for i, v in rows_ if i == k]
        assert np.allclose([got[k][n] for n in at], np.quantile(own, list(at.values())))
    assert 4 not in got
    whole = O.quantiles(d.where("k < 3"), [], "v", at).first()
    assert np.allclose([whole[n] for n in at], np.quantile([v for i, v in rows_ if i is not None and i < 3], list(at.values())))
    assert {r.k: r.v for r in O.medians(d, ["k"], ["v"]).collect()}[None] == 3.0


def test_subsample_is_evenly_spaced(spark):
    for n, most in ((10, 4), (1000, 7), (37, 37), (5, 9), (12345, 100)):
        want = np.unique(np.linspace(0, n - 1, most, dtype=np.int64)) if n > most else np.arange(n)
        got = sorted(r.id for r in spark.range(n).where(J.subsample(F.lit(n), F.col("id"), most)).collect())
        assert got == want.tolist()


def test_dlinear_learns_a_linear_rule(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (300, 6))
    y = np.stack([x[:, 5] * 2 - x[:, 0], x.mean(1)], axis=1)
    d = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))], "i int, x array<double>, y array<double>").repartition(4)
    weights = FC.fit_dlinear(d, 6, 2, 3, ridge=1e-8)
    for r in FC.predict_dlinear(d, weights, 3).collect():
        assert np.allclose(r.pred, r.y, atol=1e-4)


def test_empty_tables(spark):
    d = table(spark).where("seg > 99")
    for name, f in OPERATORS.items():
        assert f(d).collect() == [], name


@pytest.mark.parametrize("chunk,portion", [(1 << 16, 1 << 18), (11, 20)])
def test_windows_by_definition(spark, monkeypatch, chunk, portion):
    """Windows of every chunk and portion; a null in between inputs and targets leaves no window out."""
    d = table(spark)
    series = {}
    for r in sorted(d.collect()):
        series.setdefault(r.seg, []).append(r.gappy)
    monkeypatch.setattr(O, "CHUNK", chunk)
    monkeypatch.setattr(WN, "PORTION", portion)
    got = {(r.seg, r.start): (r.x, r.y) for r in WN.window_arrays(d.repartition(5), KEY, "gappy", 3, 2, 2, 1).collect()}
    cut = {(k, s): (v[s : s + 3], v[s + 4 : s + 6]) for k, v in series.items() for s in range(0, len(v) - 5, 2)}
    want = {at: w for at, w in cut.items() if None not in w[0] + w[1]}
    assert len(want) > 20 and {at: str(w) for at, w in got.items()} == {at: str(w) for at, w in want.items()}


def test_windows_of_whole_chunks_fit_into_a_small_heap():
    """A heap of 1 GB, four tasks and chunks of 65,536 rows: a window's row must not hold its chunk (8,192 times half a MB a task)."""
    import os
    import subprocess
    import sys

    code = """
from pyspark.sql import SparkSession, functions as F
from tidewright.operators import windows as WN
spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
d = spark.range(4 << 16).select((F.col("id") % 2).alias("seg"), (F.floor(F.col("id") / 2) + 1).alias("seq"), F.col("id").cast("double").alias("x"))
w = WN.window_arrays(d, ["seg"], "x", 32, 8, 8)
print("windows", w.where(F.element_at("x", -1) + 2 == F.col("y")[0]).count())
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    assert f"windows {2 * ((2 * 65536 - 40) // 8 + 1)}" in done.stdout, done.stderr[-2000:]
