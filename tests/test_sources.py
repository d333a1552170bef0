"""Readers and sinks on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import splits
from tidewright.sources import readers, sinks


def test_records_of_files_with_different_columns(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a_Signals.csv").write_text("Time [s],PLETH, RESP\n" + "\n".join(f"{i / 50},{9},{i * i}" for i in range(40)) + "\n0.8,9,bad\n")
    (tmp_path / "deep" / "b_Signals.csv").write_text('"resp",x time\n' + "\n".join(f"{i},{i / 10}" for i in range(30)))
    (tmp_path / "c_Signals.csv").write_text("flow\n1\n2\n3\n")
    (tmp_path / "other.csv").write_text("time,RESP\n1,2\n")
    got = {}
    for r in readers.read_records(spark, str(tmp_path)).orderBy("record_id", "seq").collect():
        got.setdefault(r.record_id, []).append(r)
    assert set(got) == {"a_Signals", "b_Signals", "c_Signals"}
    assert [r.value for r in got["a_Signals"][:40]] == [i * i for i in range(40)] and np.isnan(got["a_Signals"][40].value)
    assert got["a_Signals"][0].fs == pytest.approx(50) and got["b_Signals"][0].fs == pytest.approx(10)
    assert [r.value for r in got["b_Signals"]] == list(range(30))
    assert [(r.seq, r.value, r.fs) for r in got["c_Signals"]] == [(1, 1.0, 125.0), (2, 2.0, 125.0), (3, 3.0, 125.0)]


def test_strict_and_lenient_wide_csv(spark, tmp_path):
    (tmp_path / "w.csv").write_text("time,p00,p01\n0,1,2\n1,x,4\n")
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        readers.read_wide_csv(spark, str(tmp_path / "w.csv")).collect()
    rows = readers.read_wide_csv(spark, str(tmp_path / "w.csv"), ["p01", "p00"], strict=False).collect()
    assert [tuple(r) for r in rows] == [(2.0, 1.0), (4.0, None)]


def test_columns():
    assert readers.column_by_prefix(["p10", "p2", "px", "q1", "p01"], "p") == ["p01", "p2", "p10"]
    assert readers.match_column(["xResp", "RESP", "resp"], "resp") == "resp"
    assert readers.match_column(["Time", "my RESP 2"], "resp") == "my RESP 2"
    assert readers.ordered_columns(["a", "b"], ["b", "c"]) == (["a", "b", "c"], [0, 1], [1, 2])
    with pytest.raises(ValueError):
        readers.ordered_columns(["a"], ["b"], "S")


def test_scalar_series_slices_like_a_list(spark):
    x = [float(i) for i in range(50)]
    d = spark.createDataFrame([(i + 1, str(v) if i % 5 else "n/a") for i, v in enumerate(x)], "seq long, v string")
    own = [v for i, v in enumerate(x) if i % 5]
    for start, end, every, most in ((0, None, 1, 0), (3, -4, 2, 0), (-20, None, 3, 5)):
        want = own[start:end][::every]
        want = want[:most] if most else want
        got = [r.value for r in readers.scalar_series(d, "v", start=start, end=end, every=every, most=most, least=1).orderBy("seq").collect()]
        assert got == want
    with pytest.raises(ValueError):
        readers.scalar_series(d, "v", least=100)


def test_metrics_and_arguments(spark, tmp_path):
    for k, args in (("r1", {"model": "a", "pred_len": 8}), ("r2", None)):
        (tmp_path / k).mkdir()
        (tmp_path / k / "point_metrics.json").write_text(json.dumps({"mse": 0.5, "pearson": 0.9}))
        if args:
            (tmp_path / k / "run_args.json").write_text(json.dumps(args))
    from tidewright.operators.forecast import best_run

    got = best_run(readers.read_metrics(spark, str(tmp_path)), readers.read_arguments(spark, str(tmp_path)), "run").collect()
    assert {r.run.rsplit("/", 1)[1]: r.model for r in got} == {"r1": "a", "r2": None}
    assert [r.best for r in got].count(True) == 1


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("s1", 1, 2.0, "a"), ("s1", 2, 3.0, "a"), ("s2", 1, 5.0, "b")], "segment_id string, seq long, x double, signal_type string")
    manifest = {tuple(r) for r in sinks.write_by_type(d, d.select("segment_id", "signal_type").distinct(), str(tmp_path / "by")).collect()}
    assert manifest == {("a", 1, 2), ("b", 1, 1)}
    sinks.write_long(d, str(tmp_path / "long"), "csv", ["signal_type"])
    assert spark.read.csv(str(tmp_path / "long"), header=True).count() == 3
    report = sinks.ordered_report([d.select("x", "seq"), d.select("segment_id", "x")], ["segment_id", "zz"])
    assert report.columns == ["segment_id", "seq", "x"] and report.count() == 6
    assert json.loads(sinks.as_json(d).first().json)["segment_id"] == "s1"
    bins = {r.bin: r.n for r in sinks.histogram(d, "x", 2.0, 5.0, 3).collect()}
    assert bins == {0: 1, 1: 1, 2: 1}
    sinks.write_sidecar(d, str(tmp_path / "side"), {"a": 1})
    assert json.loads(spark.read.text(str(tmp_path / "side")).first().value) == {"a": 1}


def test_splits(spark):
    n, seq = F.lit(10), F.col("id") + 1
    row = lambda c: [r[0] for r in spark.range(10).orderBy("id").select(c).collect()]
    # 0.7 + 0.1 is a little less than 0.8, so that the second cut is at 7
    assert row(splits.chronological(seq, n, 0.7, 0.1)) == ["train"] * 7 + ["test"] * 3
    assert row(splits.chronological(seq, n, 0.5, 0.4, "legacy_rest")) == ["train"] * 5 + ["val"] * 2 + ["test"] * 3
    assert row(splits.adapted(seq, n, 0.3, 0.2, 0.8)) == ["train"] * 3 + ["val"] * 2 + ["ignore"] * 3 + ["test"] * 2
    with pytest.raises(ValueError):
        splits.chronological(seq, n, 0.8, 0.3)
    counts = spark.createDataFrame([("Train",), ("test",)], "split string")
    with pytest.raises(ValueError, match="val"):
        splits.require_splits(counts, "train", "val")
    assert splits.eval_stride(-1, 8, 3) == 8 and splits.eval_stride(0, 8, 3) == 3 and splits.eval_stride(5, 8, 3) == 5 and splits.eval_stride(5, 8, 3, False) == 8


def test_global_scaler_is_that_of_all_values_together(spark):
    rng = np.random.default_rng(0)
    x = rng.normal([1, 50], [2, 9], (200, 2))
    d = spark.createDataFrame(x.tolist(), "a double, b double")
    s = splits.fit_global_scaler(d, ["a", "b"], eps=0.5).first()
    assert s.mean_a == pytest.approx(x.mean()) and s.std_b == pytest.approx(x.std() + 0.5)
    # single channels are restored by the deviation without eps: the round trip is off by it
    back = d.select(splits.unscale((F.col("a") - s.mean_a) / s.std_a, F.lit(s.mean_a), F.lit(s.std_a), 0.5).alias("v")).first().v
    assert back == pytest.approx((x[0, 0] - x.mean()) / (x.std() + 0.5) * x.std() + x.mean())
