"""Readers: signals as long tables with a segment, a row number and a value; configurations and metrics as small tables."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.functions.columns import in_time
from tidewright.operators.ordered import finite, number
from tidewright.session import cut


#: Commas that no pair of quotation marks holds.
OUTSIDE = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
#: Prefixes of the columns of a table of peak samples: inputs, then targets.
PEAK_INPUTS, PEAK_TARGETS = ("in_h_", "in_dt_"), ("target_h_", "target_dt_")


def column_by_prefix(columns: Sequence[str], prefix: str) -> list[str]:
    """Columns that are the prefix and digits, in the order of the number."""
    found = [(int(m[1]), c) for c in columns if (m := re.fullmatch(rf"{re.escape(prefix)}(\d+)", c))]
    return [c for _, c in sorted(found)]


def match_column(columns: Sequence[str], name: str) -> str | None:
    """A column by its name, then by its name in any case, then the first that contains it."""
    low = name.lower()
    for test in (lambda c: c == name, lambda c: c.lower() == low, lambda c: low in c.lower()):
        if found := [c for c in columns if test(c)]:
            return found[0]
    return None


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


def select_features(df: DataFrame, columns: Sequence[str] | None = None, kind: str = "float") -> DataFrame:
    """The columns, or all numeric ones, as `kind`."""
    return df.select(*[F.col(c).cast(kind).alias(c) for c in (columns or numeric_columns(df))])


def ordered_columns(inputs: Sequence[str], outputs: Sequence[str], mode: str = "MS") -> tuple[list[str], list[int], list[int]]:
    """All columns once, in order, and the places of inputs and outputs; mode S has one input, which is the output too."""
    if mode == "S" and list(inputs[:1]) != list(outputs[:1]):
        raise ValueError("mode S predicts its input")
    names = list(dict.fromkeys([*inputs, *outputs]))
    return names, [names.index(c) for c in inputs], [names.index(c) for c in outputs]


def read_wide_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, strict: bool = True, max_rows: int = 0) -> DataFrame:
    """Float columns of CSV files with a header; a bad cell fails (strict) or is null. Unused columns are not parsed.

    max_rows keeps the first rows, by file name and place in the file; 0 keeps all.
    """
    heads = header(spark, path)
    schema = ", ".join(f"`{c}` double" for c in heads)
    out = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST" if strict else "PERMISSIVE")
    return (first_rows(out, max_rows) if max_rows > 0 else out).select(*(columns or heads))


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of CSV files, from their first line alone."""
    return spark.read.csv(path, header=True, enforceSchema=False).columns


def first_rows(df: DataFrame, most: int) -> DataFrame:
    """The first rows of a table of files, by file name and place in the file, as the rows of one reader.

    Rows are counted by block of a file and the counts are added up in a table
    with a row for each block; whole blocks are kept or left, and only the one
    in which the count is reached is numbered row by row.
    """
    # a task reads a block in order, so its ids rise with the place in the file; they only rank the rows of one block
    placed = df.withColumns({"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__id": F.monotonically_increasing_id()})
    order = W.orderBy("__file", "__block").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy("__file", "__block").agg(F.count("*").alias("__rows"))
    blocks = cut(counts.withColumn("__before", F.coalesce(F.sum("__rows").over(order), F.lit(0))).where(F.col("__before") < most))
    left = F.lit(most) - F.col("__before")
    whole = placed.join(blocks.where(F.col("__rows") <= left).select("__file", "__block"), ["__file", "__block"], "left_semi")
    part = placed.join(blocks.where(F.col("__rows") > left).withColumn("__left", left).select("__file", "__block", "__left"), ["__file", "__block"])
    ranked = part.withColumn("__rank", F.row_number().over(W.partitionBy("__file", "__block").orderBy("__id"))).where("__rank <= __left")
    return whole.select(df.columns).union(ranked.select(df.columns))


def read_peak_samples(spark: SparkSession, path: str, split: str = "split") -> DataFrame:
    """(split, x, y) of CSV files of peak samples: arrays of the inputs and the targets, heights before intervals, each in the order of its number."""
    heads = header(spark, path)
    parts = [[c for p in prefixes for c in column_by_prefix(heads, p)] for prefixes in (PEAK_INPUTS, PEAK_TARGETS)]
    if lacking := [p for p in (*PEAK_INPUTS, *PEAK_TARGETS) if not column_by_prefix(heads, p)]:
        raise ValueError(f"no columns {', '.join(f'{p}*' for p in lacking)}")
    schema = ", ".join(f"`{c}` {'string' if c not in parts[0] + parts[1] else 'double'}" for c in heads)
    rows = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST")
    return rows.select(split, F.array(*parts[0]).alias("x"), F.array(*parts[1]).alias("y"))


def read_two_columns(spark: SparkSession, path: str, time: str, value: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """(time, value) of CSV files in a time range, both ends included; only these two columns are parsed."""
    rows = read_wide_csv(spark, path, [time, value])
    return rows.where(in_time(time, start, end)).select(F.col(time).alias("time"), F.col(value).alias("value"))


def crop_time(df: DataFrame, time: str, start: float | None = None, end: float | None = None) -> DataFrame:
    """Rows in [start, end], both ends included; an error if there is none."""
    out = df.where(in_time(time, start, end))
    if out.isEmpty():
        raise ValueError(f"no rows from {start} to {end}")
    return out


def keep_types(df: DataFrame, kind: str, include: Sequence[str] = (), unknown: str | None = None) -> DataFrame:
    """Rows of the named types (all if none is named), without those of type `unknown` if given; an error if none is left."""
    out = df.where(F.col(kind).isin(*include)) if include else df
    if unknown is not None:
        out = out.where(~F.col(kind).eqNullSafe(F.lit(unknown)))
    if out.isEmpty():
        raise ValueError("no rows of these types")
    return out


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a JSON manifest, whose objects may span lines."""
    return spark.read.option("multiLine", True).json(path)


# Signal, target rate, smoothing (s), least duration (s) and frequency range (Hz) of the public data sets, and parts of their folders' names.
PRESETS = {
    "bidmc": {"keywords": ["bidmc"], "signal": "RESP", "rate": 25.0, "smooth": 2.0, "min_duration": 120.0, "low": 0.04, "high": 1.0},
    "fantasia": {"keywords": ["fantasia"], "signal": "RESP", "rate": 25.0, "smooth": 2.0, "min_duration": 300.0, "low": 0.04, "high": 1.0},
    "mitdb": {"keywords": ["mitdb", "mit-bih", "mit_bih", "arrhythmia"], "signal": "MLII", "rate": 125.0, "smooth": 0.08, "min_duration": 300.0, "low": 0.4, "high": 8.0},
}


def presets(spark: SparkSession) -> DataFrame:
    """(dataset, keywords, signal, rate, smooth, min_duration, low, high): what is known of the public data sets."""
    rows = [(k, *v.values()) for k, v in sorted(PRESETS.items())]
    return spark.createDataFrame(rows, "dataset string, keywords array<string>, signal string, rate double, smooth double, min_duration double, low double, high double")


def preset_of(path: Column | str) -> Column:
    """The data set that a path names, by its keywords in any case; null if none."""
    low = F.lower(F.col(path) if isinstance(path, str) else path)
    return F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, v["keywords"])), lambda w: F.contains(low, w)), F.lit(k)) for k, v in sorted(PRESETS.items())])


def read_dataset(spark: SparkSession, name: str, path: str, rate: float | None = None, record_limit: int = 0) -> DataFrame:
    """The CSV records of a data set: one of PRESETS by its signal, or "csv" for any folder of CSV files, whose rate must be known.

    record_limit keeps the first records by name; 0 keeps all.
    """
    if name in PRESETS:
        rows = read_records(spark, path, PRESETS[name]["signal"], "*.csv", rate)
    elif name == "csv":
        rows = read_records(spark, path, None, "*.csv", rate, default_rate=None)
    else:
        raise ValueError(f"no such data set: {name}")
    if record_limit > 0:
        first = rows.select("record_id").distinct().orderBy("record_id").limit(record_limit)
        rows = rows.join(F.broadcast(first), "record_id", "left_semi")
    return rows


def numbered(df: DataFrame, keys: Sequence[str], time: str, width: float = 3600.0) -> DataFrame:
    """Rows with seq by time within a segment; buckets are `width` units of time."""
    return number(df, keys, [time], F.floor(F.col(time) / F.lit(width)))


def read_records(spark: SparkSession, path: str, signal: str | None = None, pattern: str = "*_Signals.csv", rate: float | None = None, default_rate: float | None = 125.0) -> DataFrame:
    """(record_id, seq, time, value, fs) of the CSV records under a folder; bad cells are NaN.

    Files may differ in their columns: each file's first line says which is
    the time (the first name with "time" in it) and which the signal (the name
    as it is, in any case, or as a part; RESP if none is given, else the first
    other column). Without a time the order of lines counts. The rate is the
    argument, else one over the median time step, else default_rate; if that is
    None, reading a record without a rate fails. All files are one table of
    lines, however many there are.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("at"))
    heads = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"), F.min("at").alias("first"))
    cells = lambda line: F.split(line, OUTSIDE)
    names = F.transform(cells("head"), lambda n: F.trim(F.regexp_replace(n, '"', "")))
    want = F.lit(signal or "RESP")
    at = lambda test: F.nullif(F.array_position(F.transform("names", test), True), F.lit(0))
    timed = lambda n: F.contains(F.lower(n), F.lit("time"))
    own = F.coalesce(
        at(lambda n: (n == want) & ~timed(n)), at(lambda n: (F.lower(n) == F.lower(want)) & ~timed(n)), at(lambda n: F.contains(F.lower(n), F.lower(want)) & ~timed(n)), at(lambda n: ~timed(n))
    )
    heads = heads.withColumn("names", names).select("file", "first", at(timed).alias("time_at"), own.alias("own_at"))
    cell = lambda k: F.coalesce(F.regexp_replace(F.get(cells("value"), (F.col(k) - 1).cast("int")), '"', "").try_cast("double"), F.lit(float("nan")))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.csv$", "")
    rows = lines.join(heads, "file").where("at <> first AND trim(value) <> ''")
    rows = rows.select(stem.alias("record_id"), F.when(F.col("time_at").isNotNull(), cell("time_at")).alias("time"), cell("own_at").alias("value"), "at")
    rows = number(rows, ["record_id"], ["time", "at"], F.coalesce(F.floor(F.col("time") / 3600), F.lit(0))).drop("at")
    if rate:
        return rows.withColumn("fs", F.lit(float(rate)))
    from tidewright.operators.aggregates import sample_rate

    missing = F.raise_error(F.concat(F.lit("the sample rate is unknown: "), F.col("record_id"))).cast("double") if default_rate is None else F.lit(default_rate)
    return rows.join(sample_rate(rows, ["record_id"], "time"), "record_id", "left").withColumn("fs", F.coalesce("fs", missing))


def scalar_series(df: DataFrame, value: str, seq: str = "seq", start: int = 0, end: int | None = None, every: int = 1, most: int = 0, least: int = 100) -> DataFrame:
    """(seq, value): the finite values of a (text or number) column, numbered anew, sliced, thinned and capped, in that order.

    Negative start and end count from the end. Fewer than `least` values raise.
    """
    x = F.col(value).try_cast("double")
    rows = _numbered_all(df.select(F.col(seq).alias("__s"), x.alias("value")).where(finite(F.col("value"))))
    n = rows.count()
    a, b, _ = slice(start, end).indices(n)
    place = F.col("seq") - 1 - a
    rows = rows.where((place >= 0) & (F.col("seq") <= b) & (place % every == 0)).withColumn("seq", (place / every).cast("long") + 1)
    if most > 0:
        rows = rows.where(F.col("seq") <= most)
    kept = max(0, -(-(b - a) // every))
    if (min(kept, most) if most > 0 else kept) < least:
        raise ValueError(f"fewer than {least} values")
    return rows


def _numbered_all(df: DataFrame) -> DataFrame:
    return number(df.withColumn("__all", F.lit(0)), ["__all"], ["__s"], F.floor(F.col("__s") / (1 << 16))).select("seq", "value")


def list_signals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each (record, signal)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def unpivot_channels(df: DataFrame, ids: Sequence[str], prefix: str, stem: str) -> DataFrame:
    """(ids, channel, raw, segment_id) of the wide columns with a prefix."""
    long = df.unpivot(list(ids), column_by_prefix(df.columns, prefix), "channel", "raw")
    return long.withColumn("segment_id", F.concat(F.lit(f"{stem}_"), F.col("channel")))


def window_configs(spark: SparkSession, text: str) -> DataFrame:
    """(name, time_start, time_end) of a window configuration: objects or [start, end] lists, under "windows" or at the top."""
    data = json.loads(text)
    data = data.get("windows", data)
    rows = [(k, *(map(float, v) if isinstance(v, list) else (float(v["time_start"]), float(v["time_end"])))) for k, v in data.items()]
    return spark.createDataFrame(rows, "name string, time_start double, time_end double")


def resolve_windows(files: DataFrame, configs: DataFrame, path: str = "path") -> DataFrame:
    """files with the time range of the first of: the whole path, the file's name, its stem."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    keys = F.array(F.col(path), name, F.regexp_replace(name, r"\.[^.]*$", ""))
    long = files.select(path, F.posexplode(keys).alias("__k", "__name"))
    hit = long.join(F.broadcast(configs), F.col("__name") == F.col("name")).groupBy(path).agg(F.min_by(F.struct("time_start", "time_end"), "__k").alias("__w"))
    return files.join(hit, path, "left").select(*files.columns, "__w.time_start", "__w.time_end")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(run, metrics fields) of the point_metrics.json files under a folder; run is their directory."""
    read = spark.read.option("recursiveFileLookup", True).option("multiLine", True).option("pathGlobFilter", "point_metrics.json").json(path)
    return read.withColumn("run", directory(F.col("_metadata.file_path")))


def read_arguments(spark: SparkSession, path: str) -> DataFrame:
    """(run, argument fields) of the run_args.json files under a folder; an unreadable one has nulls."""
    read = spark.read.option("recursiveFileLookup", True).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "run_args.json").json(path)
    return read.withColumn("run", directory(F.col("_metadata.file_path")))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")
