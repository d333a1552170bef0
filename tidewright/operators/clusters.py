"""Clustering of analysis windows: features, scaling, k-means, and scores of a clustering."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.functions import kernels
from tidewright.operators.aggregates import moments, window_shape
from tidewright.operators.ordered import finite
from tidewright.session import cut, ship_package


def window_features(rows: DataFrame, keys: Sequence[str], channel: str, value: str, time_order: str) -> DataFrame:
    """Shape and moments of each window (keys), over channels less their mean in the window; rows are long (one for each channel and sample)."""
    keys = list(keys)
    means = rows.groupBy(*keys, channel).agg(F.avg(value).alias("__m"))
    centred = rows.join(means, [*keys, channel]).withColumn("__c", F.col(value) - F.col("__m"))
    level = means.groupBy(*keys).agg(F.avg("__m").alias("mean"), F.stddev_pop("__m").alias("channel_mean_std"))
    shape = window_shape(centred, keys, channel, "__c")
    return level.join(shape, keys).join(moments(centred, keys, "__c"), keys)


def joint_features(rows: DataFrame, keys: Sequence[str], p: str, q: str) -> DataFrame:
    """Correlation (0 if one is constant) and mean product of fluctuations of two mean waves in each window."""
    flat = (F.stddev_pop(p) <= 1e-12) | (F.stddev_pop(q) <= 1e-12)
    return rows.groupBy(*keys).agg(F.when(flat, 0.0).otherwise(F.corr(p, q)).alias("pq_corr"), F.covar_pop(p, q).alias("rayleigh_proxy"))


def spectral_window_features(rows: DataFrame, keys: Sequence[str], value: str, order: str, rate: float, bands: Sequence[tuple[float, float]] = ()) -> DataFrame:
    """Hann-windowed spectral features of the mean wave of each window (windows are bounded by their width)."""
    ship_package(rows.sparkSession)
    keys = list(keys)
    names = ["dom_freq", "dom_ratio", "centroid", "entropy"] + [f"band{i}_ratio" for i in range(len(bands))]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = kernels.hann_features(pdf.sort_values(order)[value].to_numpy(float), rate, list(bands))
        return pd.DataFrame([[*key, *(own[n] for n in names)]], columns=[*keys, *names])

    fields = ", ".join([f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys] + [f"{n} double" for n in names])
    return rows.select(*keys, order, value).groupBy(*keys).applyInPandas(run, fields)


def feature_matrix(
    rows: DataFrame, keys: Sequence[str], group: str, channel: str, value: str, order: str, rate: float, bands: Sequence[tuple[float, float]] = (), groups: Sequence[str] = ("p", "q")
) -> DataFrame:
    """keys, then all features of each window in the order of their names: those of each group of channels, and of two groups together.

    rows are long: window keys, the group (its name is the prefix of its
    features), channel, sample place and value. Of a group there are shape and
    moments over its channels and the spectral features of their mean wave (of
    the first also its bands and the spread of channel means); of both the
    correlation and the mean product of the two mean waves. A window without
    rows of a group has nulls for it.
    """
    keys, out, waves = list(keys), None, []
    for g in groups:
        own = rows.where(F.col(group) == g)
        wave = own.groupBy(*keys, order).agg(F.avg(value).alias(g))
        waves.append(wave)
        shape = window_features(own, keys, channel, value, order).withColumnsRenamed({"ptp_mean": "peak_to_peak_mean", "ptp_max": "peak_to_peak_max", "max_abs": "max_abs_fluct", "crest": "crest_factor"})
        main = g == groups[0]  # bands and the spread of channel means are features of the first group alone
        bins = spectral_window_features(wave, keys, g, order, rate, bands if main else ())
        shape = shape if main else shape.drop("channel_mean_std")
        named = {"dom_freq": "dom_freq_hz", "dom_ratio": "dom_power_ratio", "centroid": "spectral_centroid_hz", "entropy": "spectral_entropy"} | {f"band{i}_ratio": f"band_{int(a)}_{int(b)}_ratio" for i, (a, b) in enumerate(bands)}
        both = shape.join(bins.withColumnsRenamed(named), keys)
        both = both.select(*keys, *[F.col(c).alias(f"{g}_{c}") for c in both.columns if c not in keys])
        out = both if out is None else out.join(both, keys, "full")
    if len(groups) == 2:
        joint = joint_features(waves[0].join(waves[1], [*keys, order]), keys, *groups)
        out = out.join(joint, keys, "left")
    return out.select(*keys, *sorted(c for c in out.columns if c not in keys))


def standardised_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns with non-finite values as 0, less their mean, divided by the population std (0 counts as 1)."""
    clean = df.withColumns({c: F.when(finite(F.col(c)), F.col(c).cast("double")).otherwise(0.0) for c in columns})
    params = clean.agg(*[F.struct(F.avg(c).alias("m"), F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0).alias("s")).alias(f"__{c}") for c in columns])
    joined = clean.crossJoin(F.broadcast(params))
    return joined.withColumns({c: (F.col(c) - F.col(f"__{c}.m")) / F.col(f"__{c}.s") for c in columns}).select(df.columns)


def kmeans(df: DataFrame, columns: Sequence[str], k: int, seeds: Sequence[int] = range(5), name: str = "cluster") -> tuple[DataFrame, float]:
    """df with the cluster of the best of several seeded runs, and its cost."""
    vectors = cut(df).withColumn("__v", array_to_vector(F.array(*columns)))  # each iteration reads it
    best = None
    for seed in seeds:
        model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol=name).fit(vectors)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    return best.transform(vectors).drop("__v"), best.summary.trainingCost


def scatter(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """One row: Calinski-Harabasz and Davies-Bouldin scores of a clustering."""
    v = F.array(*columns)
    sq = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, e: s + e)
    centre = lambda d, *by: d.groupBy(*by).agg(F.array(*[F.avg(c) for c in columns]).alias("__centre"), F.count("*").alias("__n"))
    centres = centre(df, cluster)
    near = df.join(F.broadcast(centres), cluster).withColumn("__d2", sq(v, F.col("__centre")))
    spread = near.groupBy(cluster).agg(F.sum("__d2").alias("__w"), F.avg(F.sqrt("__d2")).alias("__s"))
    # a clustering has few clusters; pairs of them are pairs of centres, not of rows
    own = centres.join(spread, cluster)
    whole = centre(df).withColumnRenamed("__centre", "__all").select("__all", F.col("__n").alias("__total"))
    sums = own.crossJoin(F.broadcast(whole)).agg(
        F.sum(F.col("__n") * sq(F.col("__centre"), F.col("__all"))).alias("b"), F.sum("__w").alias("w"), F.count("*").alias("k"), F.max("__total").alias("n")
    )
    ch = F.when(F.col("w") > 0, F.col("b") * (F.col("n") - F.col("k")) / (F.col("w") * (F.col("k") - 1))).otherwise(1.0)
    other = own.select(F.col(cluster).alias("__k2"), F.col("__centre").alias("__c2"), F.col("__s").alias("__s2"))
    pairs = own.join(F.broadcast(other), F.col(cluster) != F.col("__k2"))
    worst = pairs.groupBy(cluster).agg(F.max((F.col("__s") + F.col("__s2")) / F.sqrt(sq(F.col("__centre"), F.col("__c2")))).alias("__r"))
    return sums.select(ch.alias("calinski_harabasz")).crossJoin(F.broadcast(worst.agg(F.avg("__r").alias("davies_bouldin"))))


#: Rows of a block whose distances to another block's a task adds up.
BLOCK = 4096


def silhouette(df: DataFrame, columns: Sequence[str], cluster: str = "cluster", block: int | None = None) -> DataFrame:
    """One row: the mean Euclidean silhouette of all rows of df.

    Rows are dealt to blocks by a hash; a task has a pair of blocks and
    returns for each row of one the sum of its distances to each cluster's rows
    of the other, so no pair of rows is ever a row. The time grows with the
    square of the rows: give a sample of a large table. A row alone in its
    cluster has 0; so have all if there is one cluster.
    """
    spark, block = df.sparkSession, block or BLOCK
    ship_package(spark)
    rows = cut(df.select(F.monotonically_increasing_id().alias("id"), F.col(cluster).cast("long").alias("c"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v")))
    sizes = rows.groupBy("c").agg(F.count("*").alias("n"))
    blocks = max(1, -(-rows.count() // block))
    part = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left, right = rows.withColumn("a", part).withColumn("b", every), rows.select(F.col("id").alias("id2"), F.col("c").alias("c2"), F.col("v").alias("v2")).withColumn("b", F.pmod(F.xxhash64("id2"), F.lit(blocks)).cast("int")).withColumn("a", every)

    def run(key: tuple, one: pa.Table, two: pa.Table) -> pa.Table:
        if not one.num_rows or not two.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64())], ["id", "c", "other", "s"])
        x, y = (np.stack(t.column(n).to_numpy()) for t, n in ((one, "v"), (two, "v2")))
        kinds, at = np.unique(two.column("c2").to_numpy(), return_inverse=True)
        sums = np.zeros((len(x), len(kinds)))
        for i in range(0, len(x), 256):
            d = np.zeros((len(x[i : i + 256]), len(y)))
            for k in range(x.shape[1]):
                d += (x[i : i + 256, k][:, None] - y[None, :, k]) ** 2
            sums[i : i + 256] = np.sqrt(d) @ np.eye(len(kinds))[at]
        n = len(kinds)
        return pa.table([pa.array(np.repeat(one.column(c).to_numpy(), n)) for c in ("id", "c")] + [pa.array(np.tile(kinds, len(x))), pa.array(sums.ravel())], ["id", "c", "other", "s"])

    tasks = min(max(blocks * blocks, spark.sparkContext.defaultParallelism), 10_000)
    dealt = [t.repartition(tasks, "a", "b").groupBy("a", "b") for t in (left, right)]
    sums = dealt[0].cogroup(dealt[1]).applyInArrow(run, "id long, c long, other long, s double").groupBy("id", "c", "other").agg(F.sum("s").alias("s"))
    held = sums.join(F.broadcast(sizes.select(F.col("c").alias("other"), "n")), "other")  # a row for each cluster
    same = F.col("c") == F.col("other")
    own = F.max(F.when(same & (F.col("n") > 1), F.col("s") / (F.col("n") - 1)))
    each = held.groupBy("id").agg(own.alias("a"), F.min(F.when(~same, F.col("s") / F.col("n"))).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") <= 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return each.agg(F.avg(value).alias("silhouette"))


def principal_axes(df: DataFrame, columns: Sequence[str], k: int = 2) -> DataFrame:
    """df with pc1, pc2, ... of the (already scaled) columns."""
    vectors = df.withColumn("__v", array_to_vector(F.array(*columns)))
    model = PCA(k=k, inputCol="__v", outputCol="__pc").fit(vectors)
    out = model.transform(vectors).withColumn("__pc", vector_to_array("__pc"))
    return out.withColumns({f"pc{i + 1}": F.col("__pc")[i] for i in range(k)}).drop("__v", "__pc")


def nearest_examples(df: DataFrame, columns: Sequence[str], cluster: str, order: str, k: int) -> DataFrame:
    """The k rows nearest to each cluster's centre, with their distance; ties by order."""
    centres = df.groupBy(cluster).agg(*[F.avg(c).alias(f"__{c}") for c in columns])
    total = sum(((F.col(c) - F.col(f"__{c}")) ** 2 for c in columns), F.lit(0.0))
    near = df.join(F.broadcast(centres), cluster).withColumn("distance", F.sqrt(total)).drop(*[f"__{c}" for c in columns])
    return near.withColumn("rank", F.row_number().over(W.partitionBy(cluster).orderBy("distance", order))).where(F.col("rank") <= k)


def best_k(scores: DataFrame) -> DataFrame:
    """The one row with the largest silhouette, then the smallest Davies-Bouldin score."""
    return scores.orderBy(F.desc("silhouette"), F.asc("davies_bouldin")).limit(1)


def cluster_summary(df: DataFrame, columns: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Count, and mean and population std of each column, by cluster."""
    return df.groupBy(cluster).agg(F.count("*").alias("n"), *[a for c in columns for a in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"))])


def k_values(text: str) -> list[int]:
    """Cluster numbers of a text such as "2-5, 7"; those below 2 are left out."""
    spans = [p.partition("-") for p in text.replace(" ", "").split(",") if p]
    found = {k for a, _, b in spans for k in range(int(a), int(b or a) + 1) if k >= 2}
    if not found:
        raise ValueError("no number of clusters of 2 or more")
    return sorted(found)


def band_ranges(text: str) -> list[tuple[float, float]]:
    """Frequency bands of a text such as "50-500, 500-2000"; empty or negative ones are left out."""
    pairs = [p.partition("-")[::2] for p in text.replace(" ", "").split(",") if p]
    return [(float(a), float(b)) for a, b in pairs if float(b) > float(a) >= 0]


def sweep(df: DataFrame, id: str, columns: Sequence[str], ks: Sequence[int], seeds: Sequence[int] = range(5), sample: int = 5000, examples: int = 2) -> dict[str, DataFrame]:
    """K-means for each k: scores, labels (id, k, cluster), the best k, and of it summary, features that separate and nearest examples.

    Features are scaled and written once. The silhouette is that of `sample`
    rows by a hash of the id; the other scores are of all rows.
    """
    own = cut(standardised_features(df.select(id, *columns), columns))
    n = own.count()
    scores, labels, found = None, None, {}
    for k in [k for k in ks if k < n]:
        found[k] = kmeans(own, columns, k, seeds)[0]
        lot = found[k].withColumn("__lot", F.xxhash64(F.col(id))).orderBy("__lot").limit(sample)
        one = scatter(found[k], columns).crossJoin(F.broadcast(silhouette(lot, columns)))
        one = one.select(F.lit(k).alias("k"), F.lit(n).cast("long").alias("n_windows"), "silhouette", "calinski_harabasz", "davies_bouldin")
        scores = one if scores is None else scores.union(one)
        named = found[k].select(id, F.lit(k).alias("k"), "cluster")
        labels = named if labels is None else labels.union(named)
    if scores is None:
        raise ValueError("no number of clusters below the number of rows")
    scores = cut(scores)
    best = best_k(scores)
    k = best.first()["k"]
    plain = df.select(id, *columns).join(found[k].select(id, "cluster"), id)
    from tidewright.operators.aggregates import separating_features

    return {
        "scores": scores, "labels": labels, "best": best, "summary": cluster_summary(plain, columns),
        "features": separating_features(found[k], "cluster", columns), "examples": nearest_examples(found[k], columns, "cluster", id, examples),
    }
