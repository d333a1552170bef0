"""Ordered operators over segments of any length.

A segment may hold a third of all rows, so no operator here puts a whole
segment into one task. Rows are numbered in two levels (buckets of the order,
then rows in a bucket); frames are computed on chunks that also hold copies of
the neighbouring rows that a frame reaches; running values are computed in
chunks and carried over by a small table with a row for each chunk.

Each function takes `keys` (the segment) and, unless it makes it, a 1-based
gapless row number `seq` in each segment. Rows with a null key belong to no
segment and are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Rows of a chunk.
CHUNK = 1 << 16


#: Rows of a bucket that are numbered in one task, about, and of so many the rows that boundaries are taken from.
BUCKET, SAMPLED = 1 << 20, 64


def number(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None = None, name: str = "seq") -> DataFrame:
    """Add the 1-based row number in each segment, ordered by `order` (unique in a segment).

    `bucket` never falls as the order rises (a day of a timestamp, say). Rows
    are counted by bucket, the counts are added up in a small table, and the
    rows of a bucket are numbered on their own. Where a bucket has more than
    BUCKET rows (a day may hold them all), such buckets are first divided at
    boundaries from a sample of their rows.
    """
    from pyspark.sql import Observation

    from tidewright.session import cut

    keys, seen = list(keys), Observation()
    df = df.withColumn("__bucket", F.lit(0) if bucket is None else bucket)
    by = [*keys, "__bucket"]
    sizes = cut(df.groupBy(*by).agg(F.count("*").alias("__n")).observe(seen, F.max("__n").alias("most")))
    if (seen.get["most"] or 0) > BUCKET:
        heavy = sizes.where(F.col("__n") > BUCKET).drop("__n")
        df, by = _divided(df, heavy, by, order), [*by, "__part"]
        sizes = df.groupBy(*by).agg(F.count("*").alias("__n"))
    ahead = W.partitionBy(*keys).orderBy(*by[len(keys) :]).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*by, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    own = W.partitionBy(*by).orderBy(*order)
    return df.join(starts, by).withColumn(name, (F.col("__start") + F.row_number().over(own)).cast("long")).drop(*by[len(keys) :], "__start")


def _divided(df: DataFrame, heavy: DataFrame, by: list[str], order: Sequence[str]) -> DataFrame:
    """df with the division (`__part`) of each row's bucket: boundaries are sampled rows, about two for each BUCKET rows, so they are broadcast."""
    row = F.struct(*order)
    some = df.join(F.broadcast(heavy), by, "left_semi").where(F.pmod(F.xxhash64(*by, *order), F.lit(max(1, BUCKET // SAMPLED))) == 0)
    found = some.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias("__s")).where(F.size("__s") > SAMPLED)
    # of the boundaries every 32nd is looked at first
    cuts = F.transform(F.sequence(F.lit(SAMPLED // 2), F.size("__s") - 1, F.lit(SAMPLED // 2)), lambda i: F.get("__s", i))
    found = found.select(*by, cuts.alias("__cuts"))
    found = found.withColumn("__coarse", F.transform(F.sequence(F.lit(0), F.size("__cuts") - 1, F.lit(32)), lambda i: F.get("__cuts", i)))
    upto = lambda bounds: F.size(F.filter(bounds, lambda b: b <= row))
    block = F.greatest(upto(F.col("__coarse")) - 1, F.lit(0)) * 32
    part = F.when(F.col("__cuts").isNull(), 0).otherwise(block + upto(F.slice("__cuts", block + 1, F.lit(32))))
    return df.join(F.broadcast(found), by, "left").withColumn("__part", part).drop("__cuts", "__coarse")


def chunk_size() -> int:
    return CHUNK


def chunk_of(seq: str, chunk: int | None = None) -> Column:
    return F.floor((F.col(seq) - 1) / F.lit(chunk or CHUNK)).cast("long")


def framed(
    df: DataFrame, keys: Sequence[str], before: int, after: int, build: Callable[[WindowSpec], dict[str, Column]], seq: str = "seq", chunk: int | None = None
) -> DataFrame:
    """Add build(w): columns over windows that reach at most `before` rows back and `after` rows ahead.

    w is partitioned by segment and chunk and ordered by seq; a row that is
    near a chunk's edge also goes to the neighbouring chunks.
    """
    w = W.partitionBy(*keys, "__chunk").orderBy(seq)
    return spread(df, before, after, seq, chunk).withColumns(build(w)).where(chunk_of(seq, chunk) == F.col("__chunk")).drop("__chunk")


def spread(df: DataFrame, before: int | Column, after: int | Column, seq: str = "seq", chunk: int | None = None) -> DataFrame:
    """Rows with every chunk (`__chunk`) whose own rows have them within `before` rows back or `after` rows ahead; either may be a column that is one in a segment."""
    at, size = F.col(seq) - 1, F.lit(chunk or CHUNK)
    low = F.greatest(F.floor((at - after) / size), F.lit(0))
    return df.withColumn("__chunk", F.explode(F.sequence(low.cast("long"), F.floor((at + before) / size).cast("long"))))


def swept(
    df: DataFrame,
    keys: Sequence[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    nexts: dict[str, Column] | None = None,
    seq: str = "seq",
    chunk: int | None = None,
) -> DataFrame:
    """Add sums over all rows of the segment up to this one (nulls count as nothing), last non-null values at or before, and first ones at or after.

    All are found in one pass: one aggregate by chunk, whose few numbers are
    carried over by a table with a row for each chunk, and one join with it.
    """
    sums, lasts, nexts = sums or {}, lasts or {}, nexts or {}
    df = df.withColumns({f"__v_{n}": c for n, c in (sums | lasts | nexts).items()} | {"__chunk": chunk_of(seq, chunk)})
    known = lambda n: F.when(F.col(f"__v_{n}").isNotNull(), F.col(seq))
    ends = df.groupBy(*keys, "__chunk").agg(
        *[F.sum(f"__v_{n}").alias(f"__e_{n}") for n in sums], *[F.max_by(f"__v_{n}", known(n)).alias(f"__e_{n}") for n in lasts], *[F.min_by(f"__v_{n}", known(n)).alias(f"__e_{n}") for n in nexts]
    )
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy(*keys).orderBy(F.desc("__chunk")).rowsBetween(W.unboundedPreceding, -1)
    far = ends.select(
        *keys,
        "__chunk",
        *[F.coalesce(F.sum(f"__e_{n}").over(before), F.lit(0)).alias(f"__e_{n}") for n in sums],
        *[F.last(f"__e_{n}", ignorenulls=True).over(w).alias(f"__e_{n}") for w, names in ((before, lasts), (behind, nexts)) for n in names],
    )
    own = W.partitionBy(*keys, "__chunk")
    up, down = (own.orderBy(o).rowsBetween(W.unboundedPreceding, 0) for o in (F.asc(seq), F.desc(seq)))
    near = {n: F.col(f"__e_{n}") + F.coalesce(F.sum(f"__v_{n}").over(up), F.lit(0)) for n in sums}
    near |= {n: F.coalesce(F.last(f"__v_{n}", ignorenulls=True).over(w), f"__e_{n}") for w, names in ((up, lasts), (down, nexts)) for n in names}
    return df.join(far, [*keys, "__chunk"]).withColumns(near).drop("__chunk", *[f"__{k}_{n}" for k in "ve" for n in near])


def running_sum(df: DataFrame, keys: Sequence[str], value: Column, name: str, seq: str = "seq", chunk: int | None = None) -> DataFrame:
    """Add the sum of value over all rows of the segment up to this one (nulls count as nothing)."""
    return swept(df, keys, sums={name: value}, seq=seq, chunk=chunk)


def sizes(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows of each segment."""
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def runs(df: DataFrame, keys: Sequence[str], label: str, name: str = "run", seq: str = "seq", chunk: int | None = None, place: str | None = None) -> DataFrame:
    """Add the number, from 1, of the run of equal labels that each row is in (null equals null), and with `place` the 1-based row in the run."""
    change = lambda w: {"__new": F.when((F.col(seq) == 1) | ~F.col(label).eqNullSafe(F.lag(label).over(w)), 1).otherwise(0)}
    marked = framed(df, keys, 1, 0, change, seq, chunk)
    first = {"__first": F.when(F.col("__new") == 1, F.col(seq))} if place else {}
    out = swept(marked, keys, sums={name: F.col("__new")}, lasts=first, seq=seq, chunk=chunk).withColumn(name, F.col(name).cast("long")).drop("__new")
    return out.withColumn(place, F.col(seq) - F.col("__first") + 1).drop("__first") if place else out


#: Accuracy of the sketch that bounds a quantile: what is ranked is about four parts in so many of a group.
ACCURACY = 20_000


def finite_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, __v): the finite values, computed once for all that reads them."""
    from tidewright.session import cut

    return cut(df.where(finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("__v")))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles of the finite values of each group; `at` gives them by output name.

    Groups without a finite value have no row.
    """
    return quantiles_of(finite_values(df, keys, value), keys, at)


def quantiles_of(rows: DataFrame, keys: Sequence[str], at: dict[str, float]) -> DataFrame:
    """Exact quantiles of a table of values (see finite_values), as a small table.

    A mergeable sketch gives a value surely below and one surely above each
    quantile. One more pass counts the values below as one, and each value
    between on its own, where equal ones are one row; so values are never
    shuffled but for the few between. Should a bound be off, which shows in the
    counts, all values of such groups are ranked.
    """
    from pyspark.sql import Observation

    from tidewright.session import cut

    keys, off = list(keys), Observation()
    points = [p for q in at.values() for p in (max(0.0, q - 2 / ACCURACY), min(1.0, q + 2 / ACCURACY))]
    cuts = rows.groupBy(*keys).agg(F.percentile_approx("__v", points, ACCURACY).alias("__points"), F.count("*").alias("__size"))
    v, size = F.col("__v"), F.col("__size")
    # a value below a quantile's bounds stands there as null
    cell = lambda i, name: F.struct(F.lit(name).alias("k"), F.when(v >= F.col("__points")[2 * i], v).alias("v"))
    cells = F.array_compact(F.array(*[F.when(v <= F.col("__points")[2 * i + 1], cell(i, name)) for i, name in enumerate(at)]))
    near = _join(rows, cuts, keys).select(*keys, size, F.explode(cells).alias("__cell")).select(*keys, "__size", F.col("__cell.k").alias("__k"), F.col("__cell.v").alias("__v"))
    found = cut(_at_ranks(near, keys, at).observe(off, F.sum(F.when(F.col("__a").isNull() | F.col("__b").isNull(), 1).otherwise(0)).alias("n")))
    if off.get["n"]:
        again = found.where("__a IS NULL OR __b IS NULL").select(*[F.col(c).alias(f"__again_{c}") for c in keys], F.col("__k"), F.col("__size"))
        same = [F.col(c).eqNullSafe(F.col(f"__again_{c}")) for c in keys]
        # without keys it is a row for each quantile
        every = (rows.join(again, same) if keys else rows.crossJoin(F.broadcast(again))).select(*keys, "__size", "__k", "__v")
        found = cut(found.where("__a IS NOT NULL AND __b IS NOT NULL").union(_at_ranks(every, keys, at)))
    part = F.element_at(F.create_map(*[x for name, q in at.items() for x in (F.lit(name), F.lit(float(q)))]), F.col("__k")) * (size - 1)
    interpolated = F.col("__a") + (F.col("__b") - F.col("__a")) * (part - F.floor(part))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("__k") == k, interpolated)).alias(k) for k in at])


def _at_ranks(cells: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """(keys, __k, __size, __a, __b): the values of cells (keys, __size, __k, __v) at the ranks next to each quantile; null values rank first and are no answer."""
    few = cells.groupBy(*keys, "__k", "__size", "__v").agg(F.count("*").alias("__m"))
    own = W.partitionBy(*keys, "__k").orderBy(F.col("__v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    placed = few.withColumn("__last", F.sum("__m").over(own) - 1)  # rank of the last of the equal values
    rank = F.element_at(F.create_map(*[x for name, q in at.items() for x in (F.lit(name), F.lit(float(q)))]), F.col("__k")) * (F.col("__size") - 1)
    at_rank = lambda r: F.min(F.when((F.col("__last") - F.col("__m") + 1 <= r) & (r <= F.col("__last")), F.col("__v")))
    return placed.groupBy(*keys, "__k", "__size").agg(at_rank(F.floor(rank)).alias("__a"), at_rank(F.ceil(rank)).alias("__b"))


def medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str], positive: bool = False) -> DataFrame:
    """(keys, columns): exact medians of several columns in one pass, of their positive finite values if asked; a null key is a group."""
    keys = list(keys)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])).alias("__x")
    held = [F.struct(*keys).alias("__keys")] if keys else []  # a struct of nulls is no null key
    long = df.select(*held, cells).select(*(["__keys"] if keys else []), F.col("__x.c").alias("__c"), F.col("__x.v").alias("__y"))
    if positive:
        long = long.where("__y > 0")
    found = quantiles(long, [*(["__keys"] if keys else []), "__c"], "__y", {"__q": 0.5})
    each = [F.max(F.when(F.col("__c") == c, F.col("__q"))).alias(c) for c in columns]
    if not keys:
        return found.agg(*each)
    return found.groupBy("__keys").agg(*each).select(*[F.col("__keys")[k].alias(k) for k in keys], *columns)


def _join(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys; without keys `other` is one row."""
    return rows.join(other, keys) if keys else rows.crossJoin(F.broadcast(other))


def finite(x: Column) -> Column:
    """False for null, NaN and infinities."""
    return x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))


def known(x: Column) -> Column:
    """x as a double, null where it is not finite."""
    return F.when(finite(x), x.cast("double"))
