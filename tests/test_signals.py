"""Kernels against known answers, profiles against synthetic signals, streams against batch."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright import catalog
from tidewright.functions import kernels as K
from tidewright.operators import clusters as G
from tidewright.operators import dynamics as D
from tidewright.operators import joins as J
from tidewright.operators import neighbours as N
from tidewright.plans import augment, prepare, profile
from tidewright.sources.synthetic import logistic_map, synthetic
from tidewright.streaming import causal


def test_welch_keeps_the_power_of_a_sine():
    t = np.arange(4096) / 100
    freq, power = K.welch(np.sin(2 * np.pi * 12.5 * t), 100.0, 1024)
    assert freq[np.argmax(power)] == pytest.approx(12.5)
    assert power.sum() * (freq[1] - freq[0]) == pytest.approx(0.5, rel=1e-3)


def test_band_pass_gain_at_its_edges():
    sections = K.band_sections(0.1, 0.3)
    gain = lambda w: abs(math.prod((np.exp(-1j * np.pi * w * np.arange(3)) @ b) / (np.exp(-1j * np.pi * w * np.arange(3)) @ a) for b, a in sections))
    assert gain(0.1) == pytest.approx(math.sqrt(0.5)) and gain(0.3) == pytest.approx(math.sqrt(0.5))
    assert gain(math.sqrt(0.03)) == pytest.approx(1, abs=1e-3) and gain(0.02) < 1e-3 and gain(0.9) < 1e-3


def test_zero_phase_keeps_a_wave_in_place():
    t = np.arange(3000) / 100
    want = np.sin(2 * np.pi * 5 * t)
    got = K.band_pass(want + np.sin(2 * np.pi * 30 * t), 100.0, 3.0, 8.0, zero_phase=True)
    assert np.abs(got - want)[300:-300].max() < 1e-4


def test_filter_states_continue_a_series():
    rng = np.random.default_rng(0)
    x, sections = rng.normal(0, 1, 300), K.band_sections(0.1, 0.4)
    whole, _ = K.filtered(sections, x)
    a, states = K.filtered(sections, x[:117])
    b, _ = K.filtered(sections, x[117:], states)
    assert np.allclose(np.concatenate([a, b]), whole)


def brute_peaks(x, distance, prominence):
    peaks = []
    i = 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            peaks.append((i + j) // 2)
        i = j + 1
    for p in sorted(peaks, key=lambda p: (x[p], p), reverse=True):
        if p in peaks:
            peaks = [q for q in peaks if q == p or abs(q - p) >= distance]
    out = []
    for p in peaks:
        left = next((k for k in range(p - 1, -1, -1) if x[k] > x[p]), -1)
        right = next((k for k in range(p + 1, len(x)) if x[k] > x[p]), len(x))
        own = x[p] - max(min(x[left + 1 : p + 1]), min(x[p:right]))
        if own >= prominence:
            out.append((p, own))
    return out


def test_peaks_by_definition():
    rng = np.random.default_rng(3)
    for _ in range(60):
        x = rng.integers(0, 8, 80).astype(float)
        peaks, own = K.find_peaks(x, distance=int(rng.integers(1, 7)) or 1, prominence=2.0)
        assert all(o >= 2 for o in own)
    for d in (1, 2, 5):
        x = rng.normal(0, 1, 200)
        peaks, own = K.find_peaks(x, distance=d, prominence=0.7)
        assert [(int(p), pytest.approx(o)) for p, o in zip(peaks, own)] == brute_peaks(x, d, 0.7)


def test_widths_and_envelope():
    assert K.half_widths(np.array([0, 1, 2, 1, 0.0]), np.array([2])) == pytest.approx([2.0])
    t = np.arange(1000) / 100
    assert np.allclose(np.abs(K.analytic(3 * np.sin(2 * np.pi * 5 * t))), 3)
    x = np.random.default_rng(1).normal(0, 1, 50)
    y = x - x.mean()
    assert K.autocorrelation(x)[3] == pytest.approx((y[3:] * y[:-3]).sum() / (y * y).sum())


def test_profiles_recover_period_and_type(spark):
    signals = synthetic(spark, 3)
    got = profile.profile(signals.withColumnRenamed("signal_type", "kind"), ["segment_id", "kind"], "value", 100.0)
    rows = got.collect()
    assert len(rows) == 18
    for r in rows:
        if r.kind in ("stable_single_freq", "noisy_single_freq"):
            assert r.dominant_period_samples == pytest.approx(100, rel=0.08)
        # by the ordered rules any regular wave whose peaks stand out by 2.5 deviations, a sine too, is a spike_event
        if r.kind in ("stable_single_freq", "spike_event"):
            assert r.signal_type == "spike_event" and r.peak_interval_cv < 0.5 and r.peak_prominence_ratio >= 2.5
        assert r.recommended_seq_len == max(16, max(1, round(r.dominant_period_samples)) * r.input_cycles)
        assert 0 <= r.predictability_score <= 1
    # thinned before it is grouped: every third row
    thin = profile.profile(signals.where("signal_type = 'stable_single_freq'"), ["segment_id"], "value", 100.0, most=1500).collect()
    assert {r.analysis_sample_step for r in thin} == {3}
    assert all(r.dominant_period_samples == pytest.approx(100, rel=0.08) for r in thin)


def test_configuration_and_plan(spark):
    signals = synthetic(spark, 2, types=("stable_single_freq", "weak_periodic"))
    p = profile.profile(signals.drop("signal_type"), ["segment_id"], "value", 100.0).withColumn("kind", F.regexp_replace("segment_id", r"_\d+$", ""))
    configs = {r.kind: r for r in profile.configuration(p, ["kind"], 4).collect()}
    c = configs["stable_single_freq"]
    assert c.segments == 2 and c.seq_len % 4 == 0 and c.pred_len == c.eval_stride and 4 <= c.num_layers <= 12 and c.patch_stride == c.patch_len // 2
    plan = profile.experiment_plan(profile.configuration(p, ["kind"], 4), "kind").collect()
    every = {"tcn", "dlinear", "patchtst", "gru", "cnnlstm", "crnn", "inceptiontime", "fasttcn", "spectralcnn", "timemixer", "enhanced_tcn"}
    for kind, c in configs.items():
        want = every | ({"cycle_residual"} if c.signal_type != "weak_periodic" else set()) | ({"smooth_pec"} if c.signal_type in {"noisy_single_freq", "am_fm_modulated", "spike_event"} else set())
        own = {r.model: r for r in plan if r.kind == kind}
        assert own.keys() == want
        best = own["enhanced_tcn"]
        assert best.loss == "qp_hybrid" and best.peak_pool == max(3, round(c.dominant_period_samples / 8)) and best.run_id == f"{kind}_{c.signal_type}_qpenhanced_sl{c.seq_len}_pl{c.pred_len}"
        assert best.peak_weight == (1.0 if c.signal_type == "spike_event" else 0.0) and own["gru"].kernel_size is None and own["tcn"].kernel_size == c.kernel_size
        assert own["patchtst"].patch_len == c.patch_len and own["dlinear"].moving_avg == max(3, c.smooth_window_samples) and own["tcn"].moving_avg is None
    few = profile.experiment_plan(profile.configuration(p, ["kind"], 4), "kind", baselines=False, smooth_pec=True, enhanced=False)
    assert {r.model for r in few.collect()} - {"cycle_residual"} == {"tcn", "dlinear", "patchtst", "smooth_pec"}
    whole = profile.global_profile(p, ["dominant_period_samples", "spectral_entropy"], ["signal_type"], "segment_id").collect()
    assert len(whole) == 1


def test_preparation(spark):
    good = [("good", i + 1, math.sin(i / 5) if i % 10 else None) for i in range(400)]
    bad = [("short", i + 1, float(i)) for i in range(20)] + [("flat", i + 1, 1.0) for i in range(400)] + [("gaps", i + 1, None if i % 2 else float(i)) for i in range(400)]
    s = prepare.Settings(rate=10.0, min_duration=10.0, min_finite=0.8, min_std=0.01, clip=(0.01, 0.99), target_rate=5.0, smooth=4)
    long, quality = prepare.prepare(spark.createDataFrame(good + bad, "record string, seq long, v double"), ["record"], "v", s)
    assert {r.record: r.status for r in quality.collect()} == {"good": "ok", "short": "skipped", "flat": "skipped", "gaps": "skipped"}
    rows = long.orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(1, 201)) and {r.record for r in rows} == {"good"}
    assert [r.split for r in rows] == ["train"] * 140 + ["val"] * int(200 * (0.7 + 0.1) - 140) + ["test"] * (200 - int(200 * (0.7 + 0.1)))
    x = np.array([r.raw for r in rows])
    assert rows[3].input_smooth == pytest.approx(x[:4].mean()) and rows[140].input_smooth == pytest.approx(x[140])
    assert rows[10].target_smooth == pytest.approx(x[8:12].mean())


def test_logistic_map_has_the_known_exponent(spark):
    series = logistic_map(spark, 2000).cache()
    curve = D.divergence(series, "value", 2, 1, 6, 10, 400, 1500)
    got = D.lyapunov(curve, 1, 4, 1.0).first()
    assert got.slope == pytest.approx(math.log(2), abs=0.15)
    ratios = D.false_neighbours(series, "value", 1, 5, 0.05, 10, 300, 1500)
    assert D.embedding_dimension(ratios, 5).first().dim <= 2 and ratios.count() >= 1
    analog = D.analog_curve(series, "value", 2, 1, 4, 10, 300, 1500).orderBy("horizon").collect()
    assert analog[0].skill > 0.8
    assert D.horizon_summary(spark.createDataFrame(analog)).first()["horizon_skill_ge_0_20"] >= 1
    series.unpersist()


def test_nearest_neighbours_match_brute_force_in_cells(spark, monkeypatch):
    for name, n in (("CELL", 60), ("GROUP", 25), ("HELD", 90), ("SAMPLE", 4)):
        monkeypatch.setattr(N, name, n)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (400, 2)).astype(float)  # many ties
    x[7, 1] = np.nan
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "start long, embedding array<double>")
    got = {r.start: (r.neighbour, r.d2) for r in J.nearest_neighbours(points.where("start % 2 = 1"), points, 5).collect()}
    want = {}
    for i in range(1, 400, 2):
        d2 = ((x - x[i]) ** 2).sum(1)
        d2[(np.abs(np.arange(400) - i) <= 5) | np.isnan(d2)] = np.inf
        if np.isfinite(d2).any():
            want[i] = (int(d2.argmin()), d2.min())
    assert got == want and 7 not in got
    assert J.nearest_neighbours(points.where("start < 3"), points.where("start < 6"), 5).count() == 0


@pytest.mark.parametrize("dim, band, kind", [(2, 5, "noise"), (3, 60, "noise"), (5, 2, "noise"), (3, 20, "ties"), (1, 1, "walk"), (2, 400, "noise")])
def test_neighbour_kernel_equals_all_pairs(dim, band, kind):
    rng = np.random.default_rng(dim)
    p = rng.normal(size=(1500, dim))
    p = {"noise": p, "ties": np.round(p), "walk": np.cumsum(p, 0)}[kind]
    starts = rng.permutation(4000)[:1500]
    d2 = np.zeros((1500, 1500))
    for k in range(dim):
        d2 += (p[:, k][:, None] - p[None, :, k]) ** 2
    d2[np.abs(starts[:, None] - starts[None]) <= band] = np.inf
    least = d2.min(1)
    who = np.array([starts[row == m].min() if np.isfinite(m) else -1 for row, m in zip(d2, least)])
    few = N.needed(p, starts, band)
    assert len(few) < 1500 or kind != "ties"
    best, found = N.nearest(p, starts, p[few], starts[few], band, np.full(1500, np.inf), np.full(1500, -1))
    assert (best == least).all() and (found == who).all()


def test_neighbours_of_many_segments_with_a_hot_vector(spark, monkeypatch):
    for name, n in (("CELL", 50), ("GROUP", 40), ("HELD", 100), ("SAMPLE", 8)):
        monkeypatch.setattr(N, name, n)
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for key, n in (("a", 700), ("b", 20), ("c", 130), (None, 3)):
        x = rng.normal(size=(n, 2))
        x[rng.random(n) < 0.4] = [0.5, 0.5]
        rows += [(key, i, v.tolist()) for i, v in enumerate(x)]
        for i in range(n if key else 0):
            d2 = (x[:, 0] - x[i, 0]) ** 2 + (x[:, 1] - x[i, 1]) ** 2
            d2[np.abs(np.arange(n) - i) <= 3] = np.inf
            want[key, i] = (int(d2.argmin()), d2.min())
    points = spark.createDataFrame(rows, "k string, start int, embedding array<float>").repartition(6)
    exact = points.withColumn("embedding", F.col("embedding").cast("array<double>"))
    got = {(r.k, r.start): (r.neighbour, r.d2) for r in J.nearest_neighbours(exact, exact, 3, keys=["k"]).collect() if r.k}
    assert got.keys() == want.keys()
    assert all(got[k][1] == pytest.approx(want[k][1], rel=1e-5, abs=1e-12) for k in want)


def test_nearest_neighbours_take_any_number_of_candidates(spark):
    points = spark.range(150_000).select(F.col("id").alias("start"), F.array(F.floor(F.col("id") / 10) * 1.0, (F.col("id") % 10) * 1.0).alias("embedding"))
    got = J.nearest_neighbours(points.where("start % 50000 = 25"), points, 0).collect()
    # the nearest of the grid's four neighbours with equal distances is the one ten rows before
    assert sorted(map(tuple, got)) == [(k + 25, k + 15, 1.0) for k in (0, 50_000, 100_000)]


def test_neighbour_queries_take_the_reference_sample(spark, tmp_path, monkeypatch):
    sizes, own = [], D.nearest_neighbours
    monkeypatch.setattr(D, "nearest_neighbours", lambda refs, candidates, band, **kw: sizes.append((refs.count(), candidates.count())) or own(refs, candidates, band, **kw))
    rows = spark.range(4500).select(F.col("id").alias("event_id"), F.expr("timestamp_seconds(id)").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("click").alias("event_type"), F.rand(3).alias("value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    for name in ("lyapunov_divergence", "false_neighbour_dimension"):
        assert catalog.queries()[name](spark, str(tmp_path)).count() > 0
    assert set(sizes) == {(1500, 4000)}


@pytest.mark.parametrize("chunk, distance", [(16, 3), (20, 9), (64, 5), (10, 30), (1 << 16, 7)])
def test_spaced_peaks_by_the_greedy_rule(spark, monkeypatch, chunk, distance):
    from tidewright.operators import ordered, windows

    monkeypatch.setattr(ordered, "CHUNK", chunk)
    rng = np.random.default_rng(distance)
    places = np.sort(rng.choice(900, 330, replace=False)) + 1
    kinds = {"noise": rng.normal(size=330), "ties": rng.integers(0, 3, 330) * 1.0, "up": np.arange(330.0), "down": -np.arange(330.0), "wave": np.sin(np.arange(330) / 40), "gaps": np.where(rng.random(330) < 0.1, np.nan, rng.normal(size=330))}
    rows, want = [], set()
    for kind, heights in kinds.items():
        rows += [(kind, int(s), None if kind == "gaps" and i % 7 == 0 else float(h), i) for i, (s, h) in enumerate(zip(places, heights))]
        known = [(-np.inf if r[2] is None or np.isnan(r[2]) else r[2], r[1]) for r in rows if r[0] == kind]
        kept: list[int] = []
        for _, s in sorted(known, reverse=True):
            if all(abs(s - k) >= distance for k in kept):
                kept.append(s)
        want |= {(kind, s) for s in kept}
    peaks = spark.createDataFrame(rows, "kind string, seq long, x double, extra int").repartition(5)
    got = windows.spaced_peaks(peaks, ["kind"], "x", distance)
    assert got.columns == peaks.columns and {(r.kind, r.seq) for r in got.collect()} == want


def test_sections_run_in_lanes(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=5000)
    for low, high in ((0.1, 0.4), (0.01, 0.03)):
        sections = K.band_sections(low, high)
        monkeypatch.setattr(K, "LANES_FROM", 10**9)
        want, states = K.filtered(sections, x)
        monkeypatch.setattr(K, "LANES_FROM", 256)
        got, own = K.filtered(sections, x)
        assert np.allclose(got, want, rtol=0, atol=1e-11) and np.allclose(own, states, rtol=0, atol=1e-11)


def test_silhouette_by_definition(spark):
    rng = np.random.default_rng(2)
    x, c = rng.normal(0, 1, (60, 2)), rng.integers(0, 3, 60)
    x[:, 0] += 3 * c
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i in range(60):
        a = d[i][(c == c[i]) & (np.arange(60) != i)].mean()
        b = min(d[i][c == k].mean() for k in range(3) if k != c[i])
        want.append((b - a) / max(a, b))
    df = spark.createDataFrame([(int(k), float(p), float(q)) for k, (p, q) in zip(c, x)], "cluster int, a double, b double")
    assert G.silhouette(df, ["a", "b"]).first().silhouette == pytest.approx(np.mean(want))


def stream(spark, tmp_path, df, files):
    path = str(tmp_path / "in")
    df.withColumn("part", F.ntile(files).over(__import__("pyspark").sql.Window.orderBy("seq"))).repartition(1).write.partitionBy("part").json(path)
    from pathlib import Path

    src = tmp_path / "flat"
    src.mkdir()
    for p in sorted(Path(path).rglob("*.json")):
        k = int(p.parent.name.split("=")[1])
        p.rename(src / f"{k:03d}.json")
        import os

        os.utime(src / f"{k:03d}.json", (1_000_000 + k, 1_000_000 + k))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(src))


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


def test_causal_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(k, i + 1, float(rng.normal())) for k in range(2) for i in range(90)]
    df = spark.createDataFrame(rows, "seg int, seq long, x double")
    sections = K.band_sections(0.1, 0.4)
    got = run(spark, causal.causal_features(stream(spark, tmp_path, df, 5), ["seg"], ["seq"], "x", 7, sections), "causal_stream")
    assert len(got) == len(rows)
    for k in range(2):
        x = np.array([r[2] for r in rows if r[0] == k])
        own = sorted((r for r in got if r.seg == k), key=lambda r: r.seq)
        assert np.allclose([r.causal_mean for r in own], [x[max(0, i - 6) : i + 1].mean() for i in range(len(x))])
        assert np.allclose([r.causal_rms for r in own], [np.sqrt((x[max(0, i - 6) : i + 1] ** 2).mean()) for i in range(len(x))])
        assert np.allclose([r.band for r in own], K.filtered(sections, x)[0])


def test_closed_windows_and_sessions_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    at = np.cumsum(rng.integers(1, 400, 200)) + 1_700_000_000
    df = spark.createDataFrame([(0, i + 1, int(t), float(i)) for i, t in enumerate(at)], "seg int, seq long, at long, x double")
    timed = lambda d: causal.event_time(d.withColumn("at", F.timestamp_seconds("at")), "at", "10 seconds")
    batch = {tuple(r) for r in causal.windowed_stats(timed(df), ["seg"], "at", "x", "1 hour").collect()}
    live = [tuple(r) for r in run(spark, causal.windowed_stats(timed(stream(spark, tmp_path, df, 4)), ["seg"], "at", "x", "1 hour"), "windows_stream")]
    assert live and set(live) <= batch and len(live) >= len(batch) - 2
    sessions = causal.sessions(timed(df), ["seg"], "at", "x", "5 minutes").collect()
    assert sum(r.n_rows for r in sessions) == 200 and len(sessions) == 1 + int((np.diff(at) > 300).sum())


def test_shuffled_stream_equals_batch(spark, tmp_path):
    """Rows that come in any order within the watermark are processed in their own; the last wait for a timer, late ones are dropped."""
    from tidewright.operators import windows as WN

    rng = np.random.default_rng(6)
    rows = []
    for k in range(2):
        x = np.sin(np.arange(240) / (3 + k)) + 0.3 * rng.normal(size=240)
        rows += [(k, i + 1, 1_700_000_000 + 10 * (i // 2), None if i % 37 == 5 else float(v)) for i, v in enumerate(x)]
    # each row comes up to 8 places of time later than it should; 8 * 10 s is within the watermark
    late = sorted(rows, key=lambda r: r[2] + rng.integers(0, 80))
    marker = [(9, 0, 1_700_100_000, 0.0)]  # a later row of another segment moves the watermark
    too_late = [(0, 999, 1_700_000_500, 1e9)]
    files = [late[i : i + 70] for i in range(0, len(late), 70)] + [marker, too_late]
    src = tmp_path / "in"
    src.mkdir()
    import json
    import os

    for i, own in enumerate(files):
        (src / f"{i:03d}.json").write_text("\n".join(json.dumps(dict(zip(("seg", "n", "at", "x"), r))) for r in own))
        os.utime(src / f"{i:03d}.json", (1_000_000 + i, 1_000_000 + i))
    raw = spark.readStream.schema("seg int, n long, at long, x double").option("maxFilesPerTrigger", 1).json(str(src))
    timed = causal.event_time(raw.withColumn("at", F.timestamp_seconds("at")), "at", "100 seconds")
    sections = K.band_sections(0.1, 0.4)
    got = run(spark, causal.ordered_features(timed, ["seg"], "at", "x", 7, 12.0, 50.0, sections, tie="n"), "shuffled_stream")
    assert len(got) == len(rows) and {r.seg for r in got} == {0, 1}
    df = spark.createDataFrame([(k, n, x) for k, n, _, x in rows], "seg int, seq long, x double")
    want = WN.crossing_frequency(WN.moving_rms(WN.frame_mean(df, ["seg"], F.col("x"), 7, "causal", "m"), ["seg"], F.col("x"), 7, "causal", "r"), ["seg"], "x", 12, 50.0, "f")
    want = {(r.seg, r.seq): r for r in want.collect()}
    for k in range(2):
        own = sorted((r for r in got if r.seg == k), key=lambda r: r.seq)
        assert [r.seq for r in own] == list(range(1, 241)) and all(a.at <= b.at for a, b in zip(own, own[1:]))
        for r in own:
            w = want[k, r.seq]
            assert (r.x if r.x == r.x else None) == w.x and r.causal_mean == pytest.approx(w.m) and r.causal_rms == pytest.approx(w.r) and r.crossing_frequency == pytest.approx(w.f)
        x = np.array([0.0 if r[3] is None else r[3] for r in rows if r[0] == k])
        assert np.allclose([r.band for r in own], K.filtered(sections, x)[0])


def test_parts_of_a_streamed_series_carry_on():
    """The functions behind the stream: parts of a series carry on as the whole does."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    x[50] = np.nan
    start = {"tail": np.zeros(0), "memory": [], "last": float("nan"), "frequency": 50 / 12, "cross": -1.0, "rows": 0.0}
    whole, _ = causal._advance(x, dict(start), 7, 12.0, 50.0, None)
    carry, parts = dict(start), []
    for a, b in ((0, 1), (1, 60), (60, 61), (61, 200)):
        own, carry = causal._advance(x[a:b], carry, 7, 12.0, 50.0, None)
        parts.append(own)
    for name in whole:
        assert np.allclose(np.concatenate([p[name] for p in parts]), whole[name], equal_nan=True)
