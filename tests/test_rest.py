"""Readers, sinks, plans and cluster operators that other tests don't reach."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.functions import columns as C
from tidewright.operators import clusters as G
from tidewright.operators import dynamics as D
from tidewright.operators import ordered as O
from tidewright.operators import splits as X
from tidewright.plans import profile
from tidewright.sources import readers, sinks


def test_row_cap_by_place_in_files(spark, tmp_path):
    for name, n in (("a", 30), ("b", 1), ("c", 400), ("d", 20)):
        (tmp_path / f"{name}.csv").write_text("t,v\n" + "".join(f"{i},{ord(name)}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # several blocks of a file
    try:
        every = [(float(i), float(ord(n))) for n, k in (("a", 30), ("b", 1), ("c", 400), ("d", 20)) for i in range(k)]
        for most in (1, 30, 31, 32, 200, 451, 1000):
            got = readers.read_wide_csv(spark, str(tmp_path), max_rows=most)
            assert sorted(map(tuple, got.collect()), key=lambda r: (r[1], r[0])) == every[:most]
        plan = readers.read_wide_csv(spark, str(tmp_path), max_rows=200)._jdf.queryExecution().optimizedPlan().toString()
        assert "Limit" not in plan and "Sort" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_cells_with_commas(spark, tmp_path):
    (tmp_path / "x_Signals.csv").write_text('time,"note, long",RESP\n0.0,"a, b",1.5\n0.1,plain,"2.5"\n')
    got = readers.read_records(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.value for r in got] == [1.5, 2.5] and got[0].fs == pytest.approx(10)


def test_data_sets_by_name(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"r{k}.csv").write_text("time,RESP\n" + "".join(f"{i / 20},{i + k}\n" for i in range(10)))
    got = readers.read_dataset(spark, "bidmc", str(tmp_path), record_limit=2)
    assert {r.record_id for r in got.select("record_id").distinct().collect()} == {"r0", "r1"} and got.first().fs == pytest.approx(20)
    assert readers.read_dataset(spark, "csv", str(tmp_path), rate=7.0).agg(F.max("fs")).first()[0] == 7.0
    (tmp_path / "bare.csv").write_text("RESP\n1\n2\n")
    with pytest.raises(Exception, match="the sample rate is unknown: bare"):
        readers.read_dataset(spark, "csv", str(tmp_path)).collect()
    with pytest.raises(ValueError, match="no such data set"):
        readers.read_dataset(spark, "other", str(tmp_path))
    known = {r.dataset: r for r in readers.presets(spark).collect()}
    assert set(known) == {"bidmc", "fantasia", "mitdb"} and known["mitdb"].rate == 125.0
    paths = spark.createDataFrame([("/x/MIT-BIH/100.csv",), ("bidmc01",), ("none",)], "p string").select(readers.preset_of("p").alias("d")).collect()
    assert [r.d for r in paths] == ["mitdb", "bidmc", None]


def test_small_tables(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"name": "a", "rows": 1}, {"name": "b", "rows": 2}], indent=1))
    assert sorted(map(tuple, readers.read_manifest(spark, str(tmp_path / "m.json")).collect())) == [("a", 1), ("b", 2)]
    (tmp_path / "two.csv").write_text("t,x,y\n0,5,1\n1,6,2\n2,7,bad\n3,8,4\n")
    got = readers.read_two_columns(spark, str(tmp_path / "two.csv"), "t", "x", 1.0, 2.0)
    assert sorted(map(tuple, got.collect())) == [(1.0, 6.0), (2.0, 7.0)] and got.columns == ["time", "value"]
    assert readers.header(spark, str(tmp_path / "two.csv")) == ["t", "x", "y"]
    (tmp_path / "peaks.csv").write_text("split,in_h_1,in_h_0,in_dt_0,target_h_0,target_dt_0,note\ntrain,2,1,3,4,5,z\ntest,12,11,13,14,15,\n")
    peaks = readers.read_peak_samples(spark, str(tmp_path / "peaks.csv"))
    assert sorted(map(tuple, peaks.collect())) == [("test", [11.0, 12.0, 13.0], [14.0, 15.0]), ("train", [1.0, 2.0, 3.0], [4.0, 5.0])]
    with pytest.raises(ValueError, match="no columns"):
        readers.read_peak_samples(spark, str(tmp_path / "two.csv"))


def test_wide_table_and_scaler_files(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i * i), "train" if i < 6 else "test") for i in range(9)], "a double, b double, split string")
    wide = sinks.wide_table(df, ["b", "a"], {"sum": F.col("a") + F.col("b")})
    assert wide.columns == ["b", "a", "split", "sum"] and wide.where("a = 2").first()["sum"] == 6.0
    with pytest.raises(ValueError, match="columns that are there already: a"):
        sinks.wide_table(df, ["a"], {"a": F.col("b")})
    scaler = X.fit_channel_scaler(df, ["a", "b"])
    sinks.write_scaler(scaler, str(tmp_path / "scaler"))
    again = sinks.read_scaler(df, str(tmp_path / "scaler"))
    order = lambda d: sorted(map(tuple, d.collect()))
    assert order(X.scale(df, again, ["a", "b"])) == order(X.scale(df, scaler, ["a", "b"]))


def test_small_functions(spark):
    assert G.band_ranges("50-500, 500-2000,9-3,") == [(50.0, 500.0), (500.0, 2000.0)]
    assert D.theiler_window(24.4, 3) == 24 and D.theiler_window(4.0, 9) == 18 and D.theiler_window(None, 2) == 10
    rows = spark.createDataFrame([(1.5,), (float("nan"),), (float("inf"),), (None,)], "x double").select(C.json_safe("x").alias("x")).collect()
    assert [r.x for r in rows] == [1.5, None, None, None]


def test_splits_for_training_alone(spark):
    df = spark.createDataFrame([("s", i + 1) for i in range(10)], "seg string, seq long")
    parts = {r.seq: r.split for r in df.withColumn("n", F.lit(10).cast("long")).withColumn("split", X.train_val(F.col("seq"), F.col("n"), 0.8)).collect()}
    assert [parts[i] for i in range(1, 11)] == ["train"] * 8 + ["val"] * 2


def test_principal_axes_by_definition(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 4)) * [3, 2, 1, 0.5]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double, c double, d double")
    got = sorted(G.principal_axes(df, ["a", "b", "c", "d"]).collect(), key=lambda r: r.i)
    values, axes = np.linalg.eigh(np.cov(x.T))
    for k, name in ((1, "pc1"), (2, "pc2")):
        own = np.array([r[name] for r in got])
        assert np.allclose(own, x @ axes[:, -k], atol=1e-8) or np.allclose(own, -(x @ axes[:, -k]), atol=1e-8)


def test_silhouette_of_all_rows_in_blocks(spark):
    rng = np.random.default_rng(3)
    c = np.array([0] * 60 + [1] * 40 + [2] * 1 + [5] * 20)
    x = rng.normal(size=(len(c), 3)) + c[:, None]
    df = spark.createDataFrame([(int(k), *map(float, v)) for k, v in zip(c, x)], "cluster int, a double, b double, e double")
    d, want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), []
    for i, k in enumerate(c):
        a = d[i][c == k].sum() / max((c == k).sum() - 1, 1)
        b = min(d[i][c == o].mean() for o in set(c) - {k})
        want.append((b - a) / max(a, b) if (c == k).sum() > 1 else 0.0)
    for block in (16, 4096):
        assert G.silhouette(df, ["a", "b", "e"], block=block).first().silhouette == pytest.approx(np.mean(want))
    assert G.silhouette(df.where("cluster = 0"), ["a"]).first().silhouette == 0.0


def test_feature_matrix_has_all_columns_in_order(spark):
    rng = np.random.default_rng(4)
    x = {(g, ch): rng.normal(size=64) for g, n in (("p", 3), ("q", 2)) for ch in range(n)}
    rows = [(0, g, ch, i, float(v)) for (g, ch), own in x.items() for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "win int, grp string, ch int, i int, v double")
    got = G.feature_matrix(df, ["win"], "grp", "ch", "v", "i", 100.0, [(1.0, 10.0), (10.0, 20.0), (20.0, 50.0)])
    names = got.columns[1:]
    assert names == sorted(names) and len(names) == 32 and sum(n.startswith("p_") for n in names) == 17
    row, p, q = got.first(), np.stack([x["p", k] for k in range(3)], 1), np.stack([x["q", k] for k in range(2)], 1)
    centred = p - p.mean(0)
    assert row.p_mean == pytest.approx(p.mean()) and row.p_rms == pytest.approx(np.sqrt((centred**2).mean())) and row.p_peak_to_peak_max == pytest.approx(np.ptp(p, axis=0).max())
    a, b = p.mean(1) - p.mean(), q.mean(1) - q.mean()
    assert row.pq_corr == pytest.approx(np.corrcoef(a, b)[0, 1]) and row.rayleigh_proxy == pytest.approx((a * b).mean())
    power = np.abs(np.fft.rfft(a * np.hanning(64))) ** 2
    power[0] = 0
    freq = np.fft.rfftfreq(64, 0.01)
    assert row.p_band_10_20_ratio == pytest.approx(power[(freq >= 10) & (freq <= 20)].sum() / power.sum()) and row.p_dom_freq_hz == pytest.approx(freq[power.argmax()])


def test_steps_of_a_plan(spark):
    manifest = spark.createDataFrame([("spike_event", "/d/a", "/p/a"), ("multi freq", "/d/b", None), (None, "/d/c", ""), ("x", None, "/p")], "signal_type string, table string, profile string")
    got = {}
    for r in profile.plan_steps(manifest, "/out/").orderBy("signal_type", "step").collect():
        got.setdefault(r.signal_type, []).append(r)
    assert {k: [r.action for r in v] for k, v in got.items()} == {"spike_event": ["augment", "recommend", "train"], "multi freq": ["profile", "augment", "recommend", "train"], "unknown": ["profile", "augment", "recommend", "train"]}
    assert got["spike_event"][0].profile == "/p/a" and got["multi freq"][0].result == got["multi freq"][1].profile == "/out/multi_freq/profile"
    assert profile.plan_steps(manifest, "/out", ["spike_event"], reprofile=True).count() == 4
    with pytest.raises(ValueError):
        profile.plan_steps(manifest, "/out", ["none"])


def test_numbers_of_a_bucket_with_all_rows(spark, monkeypatch):
    """All rows in one bucket, many ties of the first column: divisions at sampled boundaries number as one sort does."""
    monkeypatch.setattr(O, "BUCKET", 160)
    monkeypatch.setattr(O, "SAMPLED", 8)
    rng = np.random.default_rng(0)
    rows = [(k, int(t), i) for k, n in (("a", 4000), ("b", 30), ("c", 700)) for i, t in enumerate(rng.integers(0, 50, n) // 10 * 10)]
    df = spark.createDataFrame(rows, "k string, t int, id int").repartition(5)
    for bucket in (None, F.floor(F.col("t") / 30)):
        got = sorted((r.k, r.seq, r.t, r.id) for r in O.number(df, ["k"], ["t", "id"], bucket).collect())
        want = [(k, i + 1, t, n) for k in "abc" for i, (_, t, n) in enumerate(sorted(r for r in rows if r[0] == k))]
        assert got == want
    heavy = O._divided(df.withColumn("b", F.lit(0)), spark.createDataFrame([("a", 0)], "k string, b int"), ["k", "b"], ["t", "id"])
    sizes = [r.n for r in heavy.where("k = 'a'").groupBy("__part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 10 and max(sizes) < 4000 / 5


def test_fitted_models_are_the_same_when_read_again(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel

    from tidewright.plans.fitted import LinearForecaster, LinearForecasterModel, Scaler, ScalerModel

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(float(a), float(b), "Train" if i < 60 else "test") for i, (a, b) in enumerate(rng.normal(3, 2, (90, 2)))], "a double, b double, split string")
    for scope, fit in (("channel", X.fit_channel_scaler), ("global", X.fit_global_scaler)):
        model = Scaler(["a", "b"], scope, "split").fit(df)
        model.write().overwrite().save(str(tmp_path / scope))
        again = ScalerModel.load(str(tmp_path / scope))
        want = X.scale(df, fit(df.where("split = 'Train'"), ["a", "b"]), ["a", "b"])
        rows = lambda d: sorted(map(tuple, d.collect()))
        assert rows(again.transform(df)) == rows(model.transform(df)) == rows(want)
        back = again.inverse(again.transform(df)).select("a").collect()
        assert np.allclose(sorted(r.a for r in back), sorted(r.a for r in df.collect()))
    x = rng.normal(size=(200, 6))
    windows = spark.createDataFrame([(i, v.tolist(), [float(v[5] * 2 - v[0]), float(v.mean())]) for i, v in enumerate(x)], "i int, x array<double>, y array<double>")
    forecaster = LinearForecaster(6, 2, 3, ridge=1e-8)
    forecaster.save(str(tmp_path / "estimator"))
    pipeline = Pipeline(stages=[LinearForecaster.load(str(tmp_path / "estimator"))]).fit(windows)
    pipeline.save(str(tmp_path / "pipeline"))
    again = PipelineModel.load(str(tmp_path / "pipeline"))
    assert isinstance(again.stages[0], LinearForecasterModel)
    first, second = ({r.i: r.pred for r in m.transform(windows).collect()} for m in (pipeline, again))
    assert first == second and all(np.allclose(first[i], [v[5] * 2 - v[0], v.mean()], atol=1e-4) for i, v in enumerate(x))
    with pytest.raises(ValueError):
        Scaler(["a"]).fit(df.where("false"))
