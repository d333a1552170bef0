"""Every query with SQL equals DuckDB on the same rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")

from tidewright import catalog  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("events", "embeddings", "orders", "lineitem", "documents", "labels")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def cell(v):
    return ("",) if v is None or v != v else (round(v, 5) + 0.0,) if isinstance(v, float) else (str(v),)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_duckdb(spark, sql, name):
    got = catalog.queries()[name](spark, SF)
    want = sql.sql(catalog.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    mine = [tuple(r[c] for c in cols) for r in got.collect()]
    theirs = [tuple(r[i] for i in at) for r in want.fetchall()]
    key = lambda r: [(v is None, str(type(v)), str(round(v, 3) + 0.0 if isinstance(v, float) else v)) for v in r]
    mine.sort(key=key)
    theirs.sort(key=key)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert x == pytest.approx(y, abs=2e-5, rel=1e-9, nan_ok=True)
            else:
                assert cell(x) == cell(y)


def events(spark, kind="click"):
    rows = [r for r in catalog.samples(spark, SF).where(F.col("event_type") == kind).orderBy("seq").collect()]
    return np.array([r.value for r in rows])


def by_seq(df, kind="click"):
    return sorted((r for r in df.where(F.col("event_type") == kind).collect()), key=lambda r: r.seq)


def test_analytic_signal_by_definition(spark):
    """The analytic signal has the doubled positive half of the spectrum."""
    x = events(spark)
    y, n = x - x.mean(), len(x)
    spectrum = np.fft.fft(y)
    spectrum[1 : (n + 1) // 2] *= 2
    spectrum[n // 2 + 1 :] = 0
    z = np.fft.ifft(spectrum)
    got = by_seq(catalog.queries()["hilbert_envelope"](spark, SF))
    assert np.allclose([r.envelope for r in got], np.abs(z))
    assert np.allclose([r.phase_cos for r in got], np.cos(np.angle(z)), atol=1e-6)
    step = np.diff(np.unwrap(np.angle(z)), prepend=np.angle(z[:1])) * 100 / (2 * np.pi)
    assert np.allclose([r.local_freq for r in got], np.maximum(step, 0), atol=1e-6)


def test_no_result_depends_on_the_size_of_a_chunk(spark, monkeypatch):
    """Filters, events and the analytic signal over small chunks equal kernels on the whole series."""
    from tidewright.functions import kernels as K
    from tidewright.operators import ordered, spectra
    from tidewright.plans.augment import hilbert_features, sequential_features

    rng = np.random.default_rng(3)
    t = np.arange(700)
    segments = {
        "sine": (24.0, np.sin(2 * np.pi * t / 24) + 0.2 * np.sin(2 * np.pi * t / 7)),
        "noise": (9.0, rng.normal(size=601)),
        "trend": (16.0, 0.01 * t[:500] + 3 * np.sin(2 * np.pi * t[:500] / 16)),
        "flat": (12.0, np.repeat(rng.normal(size=12), rng.integers(1, 80, 12))),
        "short": (8.0, rng.normal(size=12)),
    }
    rows = [(k, i + 1, float(v), p) for k, (p, x) in segments.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, seq long, x double, p double").repartition(5)
    monkeypatch.setattr(ordered, "CHUNK", 64)
    monkeypatch.setattr(spectra, "LIMIT", 32)
    for offline in (False, True):
        got = sequential_features(df, ["k"], "x", F.col("p"), 100.0, offline=offline).toPandas().sort_values(["k", "seq"])
        for k, (p, x) in segments.items():
            own, z = got[got.k == k], (x - np.median(x)) / (1.4826 * np.median(np.abs(x - np.median(x))))
            assert own.seq.tolist() == list(range(1, len(x) + 1))
            peaks, prominence = K.find_peaks(z, distance=max(1, round(0.35 * p)), prominence=0.75)
            width, near = K.half_widths(z, peaks), np.zeros(len(x))
            for i, w in zip(peaks, width):
                near = np.maximum(near, 1 - np.abs(np.arange(len(x)) - i) / max(1, round(w)))
            assert np.flatnonzero(own.qp_event_mask).tolist() == peaks.tolist() and (len(peaks) or k in ("short", "flat"))
            assert np.allclose(own.qp_event_prominence.to_numpy()[peaks], prominence, rtol=0, atol=1e-9) and np.allclose(own.qp_event_width.to_numpy()[peaks], width, rtol=0, atol=1e-9)
            assert np.allclose(own.qp_event_proximity, near, rtol=0, atol=1e-9) and np.allclose(own.qp_event_weight, 1 + 2 * near)
            for j, (a, b) in enumerate(((0.5, 1.5), (1.5, 3.0), (3.0, 6.0))):
                band = K.band_pass(x, 100.0, a * 100 / p, min(b * 100 / p, 49.0), zero_phase=offline)
                assert np.allclose(own[f"qp_band{j}"], band, rtol=0, atol=1e-9)
                rms = np.sqrt(np.maximum(K.moving_mean(band * band, max(3, round(p / 8)), "B" if offline else "causal"), 0))
                assert np.allclose(own[f"qp_band{j}_rms"], rms, rtol=0, atol=1e-9)
    got = hilbert_features(df, ["k"], "x", 100.0).toPandas().sort_values(["k", "seq"])
    for k, (_, x) in segments.items():
        z, own = K.analytic(x - x.mean()), got[got.k == k]
        phase = np.unwrap(np.angle(z))
        assert np.allclose(own.envelope, np.abs(z), rtol=0, atol=1e-9) and np.allclose(own.phase_sin, np.sin(phase), rtol=0, atol=1e-9)
        assert np.allclose(own.local_freq, np.maximum(np.diff(phase, prepend=phase[:1]) * 100 / (2 * np.pi), 0), rtol=0, atol=1e-7)


def test_periodogram_of_any_length(spark, monkeypatch):
    from tidewright.operators import spectra
    from tidewright.plans.profile import periodogram

    rng = np.random.default_rng(9)
    segments = {n: np.sin(2 * np.pi * np.arange(n) / 37.3) + rng.normal(size=n) for n in (7, 8, 50, 1009, 1024, 1500)}
    df = spark.createDataFrame([(n, i + 1, float(v)) for n, x in segments.items() for i, v in enumerate(x)], "k int, seq long, x double")
    monkeypatch.setattr(spectra, "LIMIT", 64)
    got = {r.k: r for r in periodogram(df, ["k"], "x", 100.0).collect()}
    assert got[7].dominant_period_steps is None
    for n, x in segments.items():
        amp = np.abs(np.fft.rfft(x - x.mean()))
        amp[0] = 0
        if n > 7:
            assert got[n].dominant_period_steps == n / amp.argmax() and got[n].amplitude_share == pytest.approx(amp.max() / amp.sum(), rel=1e-9)


def test_periods_of_segments_without_a_profile(spark, monkeypatch):
    """Welch's estimate over blocks equals the kernel's on the whole; constant and tiny segments take the rate."""
    from tidewright.functions import kernels as K
    from tidewright.operators import spectra
    from tidewright.plans.augment import augmented, settings

    rng = np.random.default_rng(11)
    segments = {"a": np.sin(2 * np.pi * np.arange(900) / 20) + 0.3 * rng.normal(size=900), "b": np.sin(2 * np.pi * np.arange(300) / 33), "c": np.ones(40), "d": np.ones(3)}
    df = spark.createDataFrame([(k, i + 1, float(v)) for k, x in segments.items() for i, v in enumerate(x)], "k string, seq long, x double")
    got = {r.k: r.estimated_period for r in spectra.welch_period(df, ["k"], "x", F.lit(50.0), length=256).collect()}
    for k in "ab":
        freq, power = K.welch(segments[k] - segments[k].mean(), 50.0, 256)
        assert got[k] == pytest.approx(50.0 / freq[1:][power[1:].argmax()])
    assert got["c"] == got["d"] == 0
    own = {r.k: (r["__period"], r["__width"]) for r in settings(df, ["k"], "x", 50.0).collect()}
    assert own["c"] == own["d"] == (50.0, 5) and own["a"] == (900 / 45, 3) or own["a"][0] == pytest.approx(20, abs=1)
    assert own["b"][1] == max(3, round(own["b"][0] / 10))
    full = augmented(df, ["k"], "x", None, 50.0)
    assert full.count() == df.count() and not [c for c in full.columns if c.startswith("__")]
    late = augmented(df, ["k"], "x", None, 50.0, offline=True).where("k = 'b'").orderBy("seq").toPandas()
    z = K.analytic(K.moving_mean(segments["b"], own["b"][1], "causal") - K.moving_mean(segments["b"], own["b"][1], "causal").mean())
    assert np.allclose(late.qp_envelope, K.moving_mean(np.abs(z), max(3, round(own["b"][0] / 4)), "B"))


def test_structure_scores_by_definition(spark):
    """Of the whole horizon: dominant periods by the largest amplitude, spectra as shares, local deviations, peaks by hits."""
    f = catalog._forecasts(catalog.samples(spark, SF)).where("event_type = 'click'").orderBy("seq").collect()
    t, p = np.array([r.y for r in f]), np.array([r.p for r in f])
    got = catalog.queries()["forecast_structure"](spark, SF).where("event_type = 'click'").orderBy("horizon").collect()
    assert len(got) == -(-f[-1].seq // 2000) == 1
    amp = [np.abs(np.fft.rfft(x - x.mean())) for x in (t, p)]
    for a in amp:
        a[0] = 0
    k = [int(a.argmax()) for a in amp]
    assert got[0].dominant_period_true_samples == pytest.approx(len(t) / k[0]) and got[0].dominant_period_pred_samples == pytest.approx(len(t) / k[1])
    assert got[0].dominant_energy_ratio_true == pytest.approx(amp[0].max() / amp[0].sum())
    assert got[0].spectral_energy_l1 == pytest.approx(np.abs(amp[0] / amp[0].sum() - amp[1] / amp[1].sum()).sum())
    width = max(3, round(len(t) / k[0] / 4))
    left = (width - 1) // 2

    def local(x):
        x = x - x.mean()
        return np.array([np.sqrt(np.mean([x[min(max(j, 0), len(x) - 1)] ** 2 for j in range(i - left, i - left + width)])) for i in range(len(x))])

    assert got[0].envelope_mae == pytest.approx(np.abs(local(p) - local(t)).mean())
    assert got[0].peak_count_error == got[0].peak_count_pred - got[0].peak_count_true and 0 <= got[0].peak_hit_rate <= 1


def smooth_l1(d, beta):
    return np.mean([0.5 * v * v / beta if abs(v) < beta else abs(v) - 0.5 * beta for v in d])


def test_shape_and_hybrid_losses_by_definition(spark):
    from tidewright.operators import forecast as FC

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 1, 12).tolist(), rng.normal(0, 1, 16).tolist(), rng.normal(0, 1, 16).tolist()) for i in range(5)]
    w = spark.createDataFrame(rows, "i int, x array<double>, y array<double>, pred array<double>")
    shape = {r.i: r for r in FC.shape_losses(w, ["i"]).collect()}
    hybrid = {r.i: r for r in FC.hybrid_loss(w, ["i"], phase=0.5).collect()}
    for i, x, t, p in rows:
        x, t, p = map(np.array, (x, t, p))
        assert shape[i].derivative == pytest.approx(smooth_l1(np.diff(p) - np.diff(t), 0.3))
        assert shape[i].correlation == pytest.approx(1 - np.corrcoef(p, t)[0, 1])
        assert shape[i].spectrum == pytest.approx(np.mean(np.abs(np.log1p(np.abs(np.fft.rfft(p))) - np.log1p(np.abs(np.fft.rfft(t))))))
        assert shape[i].multiscale == pytest.approx(np.mean([smooth_l1(p.reshape(-1, s).mean(1) - t.reshape(-1, s).mean(1), 0.3) for s in (2, 4, 8)]))
        fp, ft = np.fft.rfft(p), np.fft.rfft(t)
        parts = [np.abs(p - t).mean(), np.mean((np.diff(p) - np.diff(t)) ** 2), np.mean(np.abs(np.abs(fp) - np.abs(ft))) + 0.5 * np.mean(np.abs(np.angle(fp / ft))), (p[0] - 2 * x[-1] + x[-2]) ** 2]
        assert [hybrid[i].level, hybrid[i].slope, hybrid[i].spectrum, hybrid[i].boundary] == pytest.approx(parts)
        assert hybrid[i].hybrid == pytest.approx(parts[0] + parts[1] + 0.1 * parts[2] + 5 * parts[3])
    with pytest.raises(Exception, match="a forecast of 2 steps for 16"):
        FC.aligned(w.withColumn("pred", F.slice("pred", 1, 2))).collect()


def test_strongest_bins_by_definition(spark):
    rows = catalog.queries()["strongest_bins"](spark, SF).limit(20).collect()
    for r in rows:
        x = np.array(r.season) + np.array(r.trend)
        f = np.fft.rfft(x)
        amp = np.abs(f)
        amp[0] = 0
        for i in range(len(f)):
            if amp[i] <= sorted(amp, reverse=True)[4]:
                f[i] = 0
        assert np.allclose(r.season, np.fft.irfft(f, n=len(x)), atol=1e-8)


def test_spectral_window_features_by_definition(spark):
    x = events(spark)
    got = {r.win: r for r in catalog.queries()["spectral_window_features"](spark, SF).where("event_type = 'click'").collect()}
    for win in (0, 1):
        y = x[64 * win : 64 * win + 128]
        n = len(y)
        hann = [0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1)) for i in range(n)]
        power = np.array([abs(sum((y[i] - y.mean()) * hann[i] * np.exp(-2j * np.pi * k * i / n) for i in range(n))) ** 2 for k in range(n // 2 + 1)])
        power[0] = 0
        freq = np.arange(n // 2 + 1) * 100 / n
        assert got[win].dom_freq == pytest.approx(freq[power.argmax()]) and got[win].dom_ratio == pytest.approx(power.max() / power.sum())
        assert got[win].centroid == pytest.approx((freq * power).sum() / power.sum())
        assert got[win].band0_ratio == pytest.approx(power[(freq >= 1) & (freq <= 10)].sum() / power.sum())


def test_divergence_by_definition(spark):
    """With a sample of everything: mean log distance of each place and its nearest neighbour, k rows later."""
    from tidewright.operators import dynamics as D

    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 120)
    df = spark.createDataFrame([("a", i + 1, float(v)) for i, v in enumerate(x)] + [("b", i + 1, float(-2 * v)) for i, v in enumerate(x)], "g string, seq long, x double")
    got = {(r.g, r.k): r.divergence for r in D.divergence(df, "x", 2, 1, 5, 4, 0, 0, keys=("g",)).collect()}
    e = np.array([x[i : i + 2] for i in range(len(x) - 1 - 5)])
    near = [min((float(((e[i] - e[j]) ** 2).sum()), j) for j in range(len(e)) if abs(i - j) > 4)[1] for i in range(len(e))]
    for k in range(6):
        dist = [np.linalg.norm(x[i + k : i + k + 2] - x[j + k : j + k + 2]) for i, j in enumerate(near)]
        assert got["a", k] == pytest.approx(np.mean(np.log(np.maximum(dist, 1e-12)))) and got["b", k] == pytest.approx(got["a", k] + np.log(2))


def test_linear_forecasts_and_clusters_of_the_queries(spark):
    rows = catalog.queries()["dlinear_forecast"](spark, SF).collect()
    assert rows and all(len(r.pred) == len(r.y) == 8 and np.isfinite(r.pred).all() for r in rows)
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    own = {r.vec_id: r.cluster for r in catalog.queries()["kmeans_windows"](spark, SF).collect()}
    x = np.stack(e["embedding"].to_list()).astype(float)
    x = (x - x.mean(0)) / x.std(0)
    c = np.array([own[i] for i in e["vec_id"]])
    centres = np.stack([x[c == k].mean(0) for k in sorted(set(c))])
    near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert len(own) == len(e) and np.mean(np.array(sorted(set(c)))[near] == c) > 0.95
    sweep = {r.k: r for r in catalog.queries()["cluster_sweep"](spark, SF).collect()}
    assert sorted(sweep) == [2, 3, 4] and all(-1 <= r.silhouette <= 1 and r.n_windows == len(e) for r in sweep.values())


def test_sequential_modules_of_the_queries(spark):
    """Band-pass by the difference equation of each section, peaks that are local maxima of enough prominence."""
    from tidewright.functions import kernels as K

    x = events(spark)
    got = by_seq(catalog.queries()["event_and_band_features"](spark, SF))
    low, high = 1.5 * 100 / 24, 3.0 * 100 / 24
    y = x.copy()
    for b, a in K.band_sections(low / 50, high / 50):
        out = np.zeros(len(y))
        for i in range(len(y)):
            out[i] = sum(b[j] * y[i - j] for j in range(3) if i >= j) - sum(a[j] * out[i - j] for j in (1, 2) if i >= j)
        y = out
    assert np.allclose([r.qp_band1 for r in got], y)
    peaks = [r.seq - 1 for r in got if r.qp_event_mask]
    assert peaks and all(x[i] >= x[i - 1] and x[i] >= x[i + 1] for i in peaks) and min(np.diff(peaks)) >= round(0.35 * 24)
    table = by_seq(catalog.queries()["augmented_table"](spark, SF))
    assert [r.qp_band1 for r in table] == pytest.approx([r.qp_band1 for r in got]) and {r.qp_signal_type_id for r in table} == {-1}


def test_peak_spacing_by_the_plain_rule(spark):
    s = catalog.samples(spark, SF).where("event_type = 'click'").orderBy("seq").collect()
    v = [r.value for r in s]
    peaks = [i for i in range(1, len(v) - 1) if v[i] > v[i - 1] and v[i] >= v[i + 1]]
    kept = []
    for i in sorted(peaks, key=lambda i: (-v[i], -i)):
        if all(abs(i - k) >= 12 for k in kept):
            kept.append(i)
    got = catalog.queries()["peak_spacing"](spark, SF).where("event_type = 'click'").collect()
    assert sorted(r.seq - 1 for r in got) == sorted(kept)


def test_false_neighbours_by_definition(spark):
    from tidewright.operators import dynamics as D

    rng = np.random.default_rng(6)
    segments = {"a": rng.normal(0, 1, 80), "b": np.sin(np.arange(90) * 1.1), "c": rng.normal(0, 1, 9)}
    df = spark.createDataFrame([(k, i + 1, float(v)) for k, x in segments.items() for i, v in enumerate(x)], "g string, seq long, x double")
    for threshold in (0.0, 0.3):
        got = D.false_neighbours(df, "x", 1, 4, threshold, 3, 0, 0, keys=("g",))
        rows = sorted(tuple(r) for r in got.collect())
        want = []
        for k, x in segments.items():
            for dim in range(1, 4):
                if len(x) - dim <= 8:
                    continue
                e = np.array([x[i : i + dim] for i in range(len(x) - dim)])
                false = []
                for i in range(len(e)):
                    d2, j = min((float(((e[i] - e[j]) ** 2).sum()), j) for j in range(len(e)) if abs(i - j) > 3)
                    base, extra = np.sqrt(max(d2, 1e-12)), abs(x[i + dim] - x[j + dim])
                    false.append(extra / base > 10 or np.hypot(base, extra) / x.std() > 2)
                want.append((k, dim, float(np.mean(false)), np.mean(false) <= threshold))
                if np.mean(false) <= threshold:
                    break
        assert [r[:2] + r[3:] for r in rows] == [w[:2] + w[3:] for w in want] and [r[2] for r in rows] == pytest.approx([w[2] for w in want])
        dims = {r.g: r.dim for r in D.embedding_dimension(got, 4, ("g",)).collect()}
        assert dims["a"] == next((w[1] for w in want if w[0] == "a" and w[3]), 4)


def test_reports_and_plans_have_their_rows(spark):
    lines = sorted(tuple(r) for r in catalog.queries()["profile_report"](spark, SF).collect())
    assert lines[0][1].startswith("| signal_type | segments |") and set(lines[1][1]) == set("|-") and len(lines) >= 3
    plan = catalog.queries()["recommend_configuration"](spark, SF).collect()
    assert plan and all(r.seq_len >= 16 and r.pred_len >= 1 and r.stride >= 1 for r in plan)
    kept = catalog.queries()["prepare_records"](spark, SF).collect()
    assert {r.split for r in kept} == {"train", "val", "test"} and all(r.time == pytest.approx((r.seq - 1) / 5) for r in kept)


def test_transforms_leave_in_portions(spark, monkeypatch):
    """A transform's rows leave its task a portion at a time, whole, in steps or by a chirp, with the same numbers."""
    import numpy as np
    from pyspark.sql import functions as F

    from tidewright.operators import spectra

    sizes = {"whole": 20, "steps": 48, "chirp": 37}
    monkeypatch.setattr(spectra, "LIMIT", 24)
    monkeypatch.setattr(spectra, "PORTION", 5)
    rng = np.random.default_rng(2)
    x = {k: rng.normal(size=n) for k, n in sizes.items()}
    rows = spark.createDataFrame([(k, i, float(v), 0.0, len(own)) for k, own in x.items() for i, v in enumerate(own)], "k string, __i long, __re double, __im double, __n long")
    got = {k: {} for k in sizes}
    for r in spectra.transform(rows, ["k"]).orderBy(F.col("k"), "__i").collect():
        got[r.k][r["__i"]] = complex(r["__re"], r["__im"])
    for k, own in x.items():
        assert np.allclose([got[k][i] for i in range(len(own))], np.fft.fft(own), atol=1e-9) and len(got[k]) == len(own)
