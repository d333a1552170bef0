"""Profiles of segments, their classification, and what is recommended for each type of signal."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.functions import kernels
from tidewright.functions.columns import predictability_score, round_to
from tidewright.operators import spectra
from tidewright.operators.aggregates import robust_scale
from tidewright.operators.ordered import _join, finite, known, medians, quantiles, sizes
from tidewright.session import cut, ship_package

#: Samples of a segment that are analysed; longer ones are thinned before they are grouped.
MAX_SAMPLES = 200_000

# Cycles in and out, module and task of each signal type.
TYPES = [
    ("stable_single_freq", 10, 4, "cycle_adaptive_window", "main_waveform_forecast"),
    ("noisy_single_freq", 10, 3, "main_residual_decomposition", "smooth_main_waveform_forecast"),
    ("am_fm_modulated", 12, 3, "envelope_frequency_conditioning", "conditioned_main_waveform_forecast"),
    ("spike_event", 10, 3, "event_skeleton_constraint", "event_timing_and_main_waveform_forecast"),
    ("multi_freq", 12, 2, "frequency_band_decomposition", "band_energy_or_multibranch_waveform_forecast"),
    ("weak_periodic", 6, 1, "predictability_rejection_or_target_switch", "short_horizon_or_rejection"),
]

_FEATURES = [
    "dominant_frequency_hz", "period_analyzed", "dominant_energy_ratio", "spectral_entropy", "multi_peak_count",
    "acf_peak", "acf_peak_lag", "peak_count", "peak_interval_cv", "peak_prominence_ratio", "envelope_cv", "residual_energy_ratio",
]


def thinned(df: DataFrame, keys: Sequence[str], value: str, most: int = MAX_SAMPLES, seq: str = "seq") -> DataFrame:
    """(keys, seq, value, n_samples_analyzed, analysis_sample_step): missing samples as the segment's median, then every step-th row, `most` at most."""
    keys = list(keys)
    middle = quantiles(df, keys, value, {"__median": 0.5})
    n = sizes(df, keys, "__n")
    joined = _join(_join(df, middle, keys), n, keys)
    step = F.when(F.lit(most) > 0, F.greatest(F.ceil(F.col("__n") / F.lit(max(most, 1))), F.lit(1))).otherwise(1)
    filled = F.when(finite(F.col(value)), F.col(value).cast("double")).otherwise(F.col("__median"))
    out = joined.select(*keys, seq, filled.alias(value), step.cast("long").alias("analysis_sample_step"), F.col("__n"))
    kept = F.ceil(F.col("__n") / F.col("analysis_sample_step")).cast("long")
    return out.where((F.col(seq) - 1) % F.col("analysis_sample_step") == 0).withColumn("n_samples_analyzed", kept).drop("__n")


def spectral_profile(x: np.ndarray, rate: float, low: float = 0.0, high: float = 0.0) -> list[float]:
    """The features of one thinned series, in the order of _FEATURES; the period is in its samples."""
    y = x - x.mean()
    std = y.std()
    if len(x) < 8 or std <= 1e-12:
        return [0.0, 0.0, 0.0, 1.0, 0, 0.0, 0, 0, float("nan"), 0.0, 0.0, 0.0]
    freq, power = kernels.welch(y, rate)
    inside = (np.arange(len(freq)) > 0) & (freq >= low) & ((freq <= high) | (high <= 0))
    freq, power = freq[inside], np.maximum(power[inside], 0)
    total = power.sum() if len(power) else 0.0
    f_dom = period = energy = 0.0
    entropy, multi = 1.0, 0
    if total > 1e-20:
        k = int(np.argmax(power))
        p = power / total
        f_dom, energy = float(freq[k]), float(p[k])
        period = rate / f_dom if f_dom > 0 else 0.0
        entropy = float(-(p * np.log(p + 1e-12)).sum() / np.log(max(2, len(p))))
        multi = len(kernels.find_peaks(power, height=0.2 * power.max())[0])
    acf = kernels.autocorrelation(x)
    last = min(len(x) - 1, int(max(3 * period, 20)) if period > 1 else 2000)
    peak_value, lag = 0.0, 0
    if last > 2:
        search = acf[1 : last + 1]
        tops = kernels.local_maxima(search)
        lag = int(tops[np.argmax(search[tops])] if len(tops) else np.argmax(search)) + 1
        peak_value = float(acf[lag])
    centred = x - np.median(x)
    peaks, prominence = kernels.find_peaks(centred, distance=max(1, int(0.35 * period)) if period > 1 else 1, prominence=0.5 * std)
    cv, ratio = float("nan"), 0.0
    if len(peaks) >= 2:
        gaps = np.diff(peaks)
        cv, ratio = float(gaps.std() / max(gaps.mean(), 1e-12)), float(np.median(prominence) / std)
    envelope = np.abs(kernels.analytic(y))
    width = int(max(3, min(len(x) // 2, round(period / 6)))) if period > 6 else 3
    residual = float((x - kernels.moving_mean(x, width)).var() / x.var())
    return [f_dom, period, energy, entropy, multi, peak_value, lag, len(peaks), cv, ratio, float(envelope.std() / max(envelope.mean(), 1e-12)), residual]


def classified() -> Column:
    """The type of a signal by ordered rules; fewer than two peaks count as a wide spread of intervals.

    Fixed values: the thresholds.
    """
    spread = F.when(F.col("peak_interval_cv").isNull() | F.isnan("peak_interval_cv"), 999.0).otherwise(F.col("peak_interval_cv"))
    return (
        F.when((F.col("dominant_energy_ratio") < 0.08) & (F.col("acf_peak") < 0.20), "weak_periodic")
        .when((F.col("peak_prominence_ratio") >= 2.5) & (spread <= 0.50), "spike_event")
        .when((F.col("multi_peak_count") >= 3) & (F.col("spectral_entropy") >= 0.45), "multi_freq")
        .when((spread >= 0.20) | (F.col("envelope_cv") >= 0.45), "am_fm_modulated")
        .when((F.col("residual_energy_ratio") >= 0.35) | (F.col("spectral_entropy") >= 0.55), "noisy_single_freq")
        .otherwise("stable_single_freq")
    )


def recommended(df: DataFrame) -> DataFrame:
    """Add module, task, cycles, window lengths and smoothing for each row's signal_type, period and sample rate."""
    table = df.sparkSession.createDataFrame(TYPES, "signal_type string, input_cycles long, output_cycles long, recommended_module string, recommended_task string")
    period = F.when(F.col("dominant_period_samples") > 0, F.greatest(F.bround("dominant_period_samples", 0), F.lit(1.0))).otherwise(1.0)
    part, least = (F.when(F.col("signal_type") == "spike_event", a).when(F.col("signal_type") == "noisy_single_freq", b).when(F.col("signal_type") == "am_fm_modulated", c).otherwise(d) for a, b, c, d in ((20, 6, 8, 10), (1, 3, 3, 1)))
    rate = F.greatest("sample_rate_hz", F.lit(1e-12))
    lengths = {
        "recommended_seq_len": F.greatest(F.lit(16), period * F.col("input_cycles")).cast("long"),
        "recommended_pred_len": F.greatest(F.lit(1), period * F.col("output_cycles")).cast("long"),
        "recommended_smooth_window": F.greatest(least, F.bround(period / part, 0)).cast("long"),
    }
    out = df.join(F.broadcast(table), "signal_type", "left").withColumns(lengths)
    return out.withColumns({c: F.col(a) / rate for c, a in (("recommended_seq_sec", "recommended_seq_len"), ("recommended_pred_sec", "recommended_pred_len"), ("recommended_smooth_sec", "recommended_smooth_window"))})


def profile(df: DataFrame, keys: Sequence[str], value: str, rate: float | Column, most: int = MAX_SAMPLES, low: float = 0.0, high: float = 0.0, seq: str = "seq") -> DataFrame:
    """One row for each segment: spectral, autocorrelation, peak and envelope features, type, score and recommended windows.

    A segment without a finite sample has no row. The group that a Python
    function gets is thinned to `most` rows before it is shuffled.
    """
    ship_package(df.sparkSession)
    keys = list(keys)
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    thin = thinned(df.withColumn("__rate", rate), keys + ["__rate"], value, most, seq)
    head = [*keys, "sample_rate_hz", "analysis_sample_step", "n_samples_analyzed"]
    group = thin.withColumnRenamed("__rate", "sample_rate_hz")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(seq)[value].to_numpy(float)
        own = spectral_profile(x, key[len(keys)] / max(1, key[len(keys) + 1]), low, high)
        return pd.DataFrame([[*key, *map(float, own)]], columns=[*head, *_FEATURES])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in group.select(*head).schema.fields] + [f"{n} double" for n in _FEATURES])
    raw = group.select(*head, seq, value).groupBy(*head).applyInPandas(run, fields)
    whole = {c: F.col(c).cast("long") for c in ("multi_peak_count", "acf_peak_lag", "peak_count")}
    out = raw.withColumns(whole).withColumns(
        {
            "effective_sample_rate_hz": F.col("sample_rate_hz") / F.col("analysis_sample_step"),
            "dominant_period_samples": F.col("period_analyzed") * F.col("analysis_sample_step"),
            "dominant_period_sec": F.col("period_analyzed") * F.col("analysis_sample_step") / F.col("sample_rate_hz"),
            "duration_sec_analyzed": F.col("n_samples_analyzed") * F.col("analysis_sample_step") / F.col("sample_rate_hz"),
            "cycles_analyzed": F.col("n_samples_analyzed") / F.greatest("period_analyzed", F.lit(1e-12)),
            "spectral_min_frequency_hz": F.lit(float(low)),
            "spectral_max_frequency_hz": F.lit(float(high)),
        }
    )
    score = predictability_score(F.col("dominant_energy_ratio"), F.col("acf_peak"), F.col("spectral_entropy"), F.col("residual_energy_ratio"))
    return recommended(out.withColumn("signal_type", classified()).withColumn("predictability_score", score)).drop("period_analyzed")


def periodogram(df: DataFrame, keys: Sequence[str], value: str, rate: float, seq: str = "seq") -> DataFrame:
    """(keys, dominant_frequency_hz, dominant_period_steps, dominant_period_seconds, amplitude_share) of the raw spectrum of each segment.

    All samples take part at their own rate, missing ones as the median, in one
    transform of the segment whatever its length. Segments of fewer than 8 rows
    or without variance have nulls.
    """
    keys, df = list(keys), cut(df.select(*keys, seq, value))
    n = cut(_join(sizes(df, keys, "__n"), robust_scale(df, keys, value).select(*keys, "median", "scale"), keys))
    rows = _join(df.select(*keys, seq, value), n, keys).select(*keys, seq, F.coalesce(known(F.col(value)), "median").alias("__x"))
    mean = rows.groupBy(*keys).agg(F.avg("__x").alias("__mean"))
    amp = spectra.amplitudes(_join(rows, mean, keys).withColumn("__x", F.col("__x") - F.col("__mean")), keys, "__x", seq)
    best = amp.groupBy(*keys).agg(F.max_by("bin", F.struct("amplitude", -F.col("bin"))).alias("__k"), (F.max("amplitude") / F.nullif(F.sum("amplitude"), F.lit(0.0))).alias("amplitude_share"))
    whole = _left(n, best, keys).withColumn("__ok", (F.col("__n") >= 8) & F.col("scale").isNotNull())
    steps = F.when(F.col("__ok"), F.col("__n") / F.col("__k"))
    share = F.when(F.col("__ok"), F.col("amplitude_share"))
    return whole.select(*keys, (rate / steps).alias("dominant_frequency_hz"), steps.alias("dominant_period_steps"), (steps / rate).alias("dominant_period_seconds"), share.alias("amplitude_share"))


def global_profile(profiles: DataFrame, numbers: Sequence[str], texts: Sequence[str], order: str) -> DataFrame:
    """One row: medians of the finite numbers, the most frequent texts (ties by the first)."""
    from tidewright.operators.aggregates import mode

    out = medians(profiles, [], numbers)
    for t in texts:
        out = out.crossJoin(F.broadcast(mode(profiles, [], t, order, t)))
    return out


def configuration(profiles: DataFrame, keys: Sequence[str], quantum: int = 1, stride_cycles: float = 1.0, order: str = "segment_id") -> DataFrame:
    """A training configuration for each group of profiles: lengths in rounded multiples of the median period, and layers and patches that fit them."""
    from tidewright.operators.aggregates import mode

    keys = list(keys)
    profiles = cut(profiles)  # a small table that several aggregates read
    defaults = {"dominant_period_samples": 128.0, "sample_rate_hz": 1.0, "recommended_smooth_window": None, "input_cycles": 10.0, "output_cycles": 3.0, "predictability_score": 0.0}
    middle = medians(profiles, keys, list(defaults), positive=True)
    middle = middle.select(*keys, *[F.col(c).alias(f"__{c}") for c in defaults])
    out = _left(profiles.groupBy(*keys).agg(F.count("*").alias("segments")), middle, keys)
    kind = mode(profiles, keys, "signal_type", order, "__kind")
    out = _left(out, kind, keys).withColumn("signal_type", F.coalesce("__kind", F.lit("stable_single_freq")))
    period = F.coalesce("__dominant_period_samples", F.lit(128.0))
    smooth = F.coalesce("__recommended_smooth_window", F.greatest(F.lit(1.0), period / 10))
    cycles = {n: F.coalesce(f"__{n}", F.lit(defaults[n])).cast("long") for n in ("input_cycles", "output_cycles")}
    out = out.withColumns({"dominant_period_samples": period, "sample_rate_hz": F.coalesce("__sample_rate_hz", F.lit(1.0)), **cycles, "predictability_score": F.coalesce("__predictability_score", F.lit(0.0)), "smooth_window_samples": F.bround(smooth, 0).cast("long")})
    p = F.col("dominant_period_samples")
    lengths = {"seq_len": round_to(p * F.col("input_cycles"), quantum, 16), "pred_len": round_to(p * F.col("output_cycles"), quantum, 1), "stride": round_to(p * stride_cycles, quantum, 1)}
    out = out.withColumns({k: v.cast("long") for k, v in lengths.items()}).withColumn("eval_stride", F.col("pred_len"))
    kernel = F.when(F.col("seq_len") >= 8192, 7).when(F.col("seq_len") >= 2048, 5).otherwise(3)
    field = F.least(F.col("seq_len").cast("double"), F.greatest(F.col("pred_len") * 2.0, p * 6.0))
    layers = F.ceil(F.log2(F.greatest((field - 1) / (F.col("kernel_size") - 1) + 1, F.lit(2.0))))
    raw = F.greatest(F.lit(8), F.least(F.floor(F.col("seq_len") / 4), F.bround(p / 4, 0).cast("long")))
    patch = F.least(round_to(raw, 4, 4).cast("long"), F.col("seq_len"))
    out = out.withColumn("kernel_size", kernel).withColumn("num_layers", F.greatest(F.lit(4), F.least(F.lit(12), layers)).cast("int")).withColumn("patch_len", patch)
    out = out.withColumn("patch_stride", F.greatest(F.lit(1), F.floor(F.col("patch_len") / 2)).cast("long"))
    return out.drop("__kind", *[f"__{c}" for c in defaults])


def _left(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys, "left") if keys else a.join(F.broadcast(b), how="left")


# Models of the plan, their tags in run ids, whether they are older baselines, and the types that they are for (none: all).
MODELS = [
    (0, "tcn", "tcn", False, None),
    (1, "cycle_residual", "cycleres", False, ["stable_single_freq", "noisy_single_freq", "am_fm_modulated", "spike_event", "multi_freq"]),
    (2, "dlinear", "dlinear", False, None),
    (3, "patchtst", "patchtst", False, None),
    (4, "gru", "gru", True, None),
    (5, "cnnlstm", "cnnlstm", True, None),
    (6, "crnn", "crnn", True, None),
    (7, "inceptiontime", "inceptiontime", True, None),
    (8, "fasttcn", "fasttcn", True, None),
    (9, "spectralcnn", "spectralcnn", True, None),
    (10, "timemixer", "timemixer", True, None),
    (11, "smooth_pec", "smoothpec", False, ["noisy_single_freq", "am_fm_modulated", "spike_event"]),
    (12, "enhanced_tcn", "qpenhanced", False, None),
]
# Inputs of the enhanced model and the weights of its loss terms (derivative, envelope, band, event, correlation, multi-scale, peak) by type.
ENHANCED = [
    ("stable_single_freq", "qp_main_input", 0.5, 0.1, 0.02, 0.0, 0.2, 0.1, 0.0),
    ("noisy_single_freq", "qp_main_input,qp_residual,qp_abs_residual", 0.5, 0.3, 0.05, 0.2, 0.2, 0.3, 0.0),
    ("am_fm_modulated", "qp_main_input,qp_envelope,qp_local_freq_ratio,qp_phase_sin,qp_phase_cos", 0.4, 1.0, 0.05, 0.0, 0.2, 0.3, 0.0),
    ("spike_event", "qp_main_input,qp_residual,qp_abs_residual", 1.0, 0.2, 0.05, 2.0, 0.2, 0.1, 1.0),
    ("multi_freq", "qp_main_input,qp_band0_rms,qp_band1_rms,qp_band2_rms", 0.4, 0.3, 0.2, 0.0, 0.1, 0.2, 0.0),
    ("weak_periodic", "qp_main_input,qp_predictability_score,qp_weak_periodic_flag", 0.2, 0.2, 0.05, 0.0, 0.1, 0.2, 0.0),
]
_TERMS = ("derivative", "envelope", "band", "event", "correlation", "multiscale", "peak")


def experiment_plan(configs: DataFrame, label: str, baselines: bool = True, smooth_pec: bool = False, enhanced: bool = True, raw: str = "raw", source: str = "input_smooth", target: str = "target_smooth") -> DataFrame:
    """A row for each run of a model on a configuration: run id, columns, loss and the settings of its kind of model (null where it has none).

    The older baselines and the enhanced model are rows if asked; smooth_pec
    gives that model to all types instead of its own. An unknown type takes the
    enhanced settings of noisy signals and the main wave alone.
    """
    spark = configs.sparkSession
    models = spark.createDataFrame(MODELS, "step int, model string, tag string, older boolean, own array<string>")
    models = models.where(F.lit(baselines) | ~F.col("older")).where(F.lit(enhanced) | (F.col("model") != "enhanced_tcn"))
    fit = F.col("own").isNull() | F.array_contains("own", F.col("signal_type")) | (F.lit(smooth_pec) & (F.col("model") == "smooth_pec"))
    weights = spark.createDataFrame(ENHANCED, ", ".join(["signal_type string, enhanced_inputs string", *[f"{t}_weight double" for t in _TERMS]]))
    runs = configs.join(F.broadcast(models), fit).join(F.broadcast(weights), "signal_type", "left")
    run = F.concat_ws("_", F.col(label), "signal_type", "tag", F.concat(F.lit("sl"), F.col("seq_len")), F.concat(F.lit("pl"), F.col("pred_len")))
    mean = F.col("signal_type").isin("stable_single_freq", "noisy_single_freq", "multi_freq")
    of = lambda *names: F.col("model").isin(*names)
    best, deep = of("enhanced_tcn"), of("tcn", "cycle_residual", "smooth_pec", "enhanced_tcn")
    noisy = dict(zip(_TERMS, ENHANCED[1][2:]))
    smooth = F.col("smooth_window_samples")
    return runs.select(
        "step", label, "signal_type", "model", run.alias("run_id"),
        F.when(best, F.coalesce("enhanced_inputs", F.lit("qp_main_input"))).when(of("smooth_pec"), raw).otherwise(source).alias("input_columns"),
        F.when(best, "qp_main_target").otherwise(target).alias("output_columns"),
        F.when(best, "qp_hybrid").otherwise("huber").alias("loss"),
        "seq_len", "pred_len", "stride", "eval_stride", F.greatest(F.col("pred_len") * 6, F.col("pred_len")).alias("horizon"),
        F.when(deep, F.col("kernel_size")).alias("kernel_size"), F.when(deep, F.col("num_layers")).alias("num_layers"),
        F.when(of("patchtst"), F.col("patch_len")).alias("patch_len"), F.when(of("patchtst"), F.col("patch_stride")).alias("patch_stride"),
        F.greatest(F.lit(1), F.bround("dominant_period_samples", 0).cast("long")).alias("period_len"),
        F.when(of("cycle_residual"), F.when(mean, 3).otherwise(1)).alias("cycle_base_cycles"),
        F.when(of("cycle_residual"), F.when(mean, "mean").otherwise("last")).alias("cycle_base_mode"),
        F.when(of("dlinear", "timemixer"), F.greatest(F.lit(3).cast("long"), smooth)).alias("moving_avg"),
        F.when(of("smooth_pec"), F.greatest(F.lit(1).cast("long"), smooth)).alias("smooth_window"),
        *[F.when(best, F.coalesce(f"{t}_weight", F.lit(noisy[t]))).alias(f"{t}_weight") for t in _TERMS],
        F.when(best, F.greatest(F.lit(3).cast("long"), F.bround(F.col("dominant_period_samples") / 8, 0).cast("long"))).alias("peak_pool"),
    )


def plan_steps(manifest: DataFrame, folder: str, include: Sequence[str] = (), reprofile: bool = False, kind: str = "signal_type") -> DataFrame:
    """(signal_type, step, action, source, profile, result): what is done for each type of a manifest (signal_type, table, profile), in order.

    A profile is a step only where the manifest has none, or with reprofile;
    then come augmentation, recommendation and training. A row without a table
    is left out, and so are types that are not included, if any are; an error
    if nothing is left.
    """
    from tidewright.functions.columns import safe_name

    own = manifest.where("table IS NOT NULL AND table <> ''").withColumn(kind, F.coalesce(kind, F.lit("unknown")))
    own = own.where(F.col(kind).isin(*include)) if include else own
    if own.isEmpty():
        raise ValueError("nothing to plan")
    at = F.concat(F.lit(f"{folder.rstrip('/')}/"), safe_name(F.col(kind)))
    made = F.lit(reprofile) | F.coalesce(F.col("profile") == "", F.lit(True))
    profile_ = F.when(made, F.concat(at, F.lit("/profile"))).otherwise(F.col("profile"))
    augmented_, advice = F.concat(at, F.lit("/augmented")), F.concat(at, F.lit("/recommend"))
    step = lambda n, action, source, result: F.struct(F.lit(n).alias("step"), F.lit(action).alias("action"), source.alias("source"), profile_.alias("profile"), result.alias("result"))
    steps = F.array(step(0, "profile", F.col("table"), profile_), step(1, "augment", F.col("table"), augmented_), step(2, "recommend", augmented_, advice), step(3, "train", augmented_, advice))
    return own.select(kind, F.explode(F.filter(steps, lambda s: made | (s["step"] > 0))).alias("s")).select(kind, "s.*")


def profile_report(profiles: DataFrame, kind: str = "signal_type") -> DataFrame:
    """(line, text): a Markdown table with a row for each type: segments, medians of period, energy ratio, entropy and score."""
    columns = ["dominant_period_samples", "dominant_energy_ratio", "spectral_entropy", "predictability_score"]
    own = profiles.groupBy(kind).agg(F.count("*").alias("segments"), *[F.median(c).alias(c) for c in columns])
    cells = [F.col(kind), F.col("segments").cast("string"), *[F.format_string("%.4g", c) for c in columns]]
    row = lambda cs: F.concat(F.lit("| "), F.array_join(F.array(*cs), " | ", "-"), F.lit(" |"))
    ranked = own.select((F.rank().over(W.orderBy(kind)) + 1).cast("int").alias("line"), row(cells).alias("text"))  # a row for each type: a few
    head = [(0, f"| {' | '.join([kind, 'segments', *columns])} |"), (1, "|" + "---|" * (len(columns) + 2))]
    return profiles.sparkSession.createDataFrame(head, "line int, text string").union(ranked)
