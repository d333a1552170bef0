"""Exact nearest neighbours with an exclusion band, without comparing all pairs.

Candidates of a large segment are dealt to cells: the half spaces of a tree
whose cuts are medians of a bounded sample. A reference first looks into its
own cell, then into every cell that is not farther than the best found there;
within a cell the same is done on a small tree of the cell's own points. The
bounds are sums of the same products in the same order as the distances, so
they never exceed them, not by rounding either: results equal those of all
pairs, ties included.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import cut, ship_package

#: Candidates of a cell, about, and references of a task's group, at most.
CELL, GROUP = 1 << 15, 1 << 14
#: Cells of all segments together, about, and points that the cuts of each are taken from: what the driver holds at most.
CELLS, SAMPLE = 1 << 13, 16
#: Points of a leaf within a cell.
LEAF = 128
#: Rows that a task looks at together for repeated vectors; tasks of an exchange at most.
HELD, TASKS = 1 << 18, 10_000


class Tree(NamedTuple):
    """A full binary tree of half spaces: axis and cut of the inner nodes, and the box of every node (children of i are 2i + 1 and 2i + 2)."""

    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @property
    def inner(self) -> int:
        return len(self.axis)


def grown(points: np.ndarray, depth: int) -> Tree:
    """A tree of 2**depth leaves, cut at the median of the widest axis; its boxes fill the whole space."""
    inner, dim = (1 << depth) - 1, points.shape[1]
    axis, cut = np.zeros(inner, np.int64), np.zeros(inner)
    low, high = np.full((2 * inner + 1, dim), -np.inf), np.full((2 * inner + 1, dim), np.inf)
    held = {0: points}
    for i in range(inner):
        own = held.pop(i)
        if len(own):
            axis[i] = int(np.argmax(own.max(0) - own.min(0)))
            cut[i] = np.partition(own[:, axis[i]], len(own) // 2)[len(own) // 2]
        right = own[:, axis[i]] >= cut[i]
        held[2 * i + 1], held[2 * i + 2] = own[~right], own[right]
        for child, side in ((2 * i + 1, high), (2 * i + 2, low)):
            low[child], high[child] = low[i], high[i]
            side[child, axis[i]] = cut[i]
    return Tree(axis, cut, low, high)


def tightened(tree: Tree, points: np.ndarray, leaf: np.ndarray) -> Tree:
    """The tree with the boxes of the points that its leaves hold; empty leaves are infinitely far."""
    low, high = np.full_like(tree.low, np.inf), np.full_like(tree.high, -np.inf)
    np.minimum.at(low, leaf + tree.inner, points)
    np.maximum.at(high, leaf + tree.inner, points)
    for i in range(tree.inner - 1, -1, -1):
        low[i], high[i] = np.minimum(low[2 * i + 1], low[2 * i + 2]), np.maximum(high[2 * i + 1], high[2 * i + 2])
    return tree._replace(low=low, high=high)


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf that each row of x falls into."""
    node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range((tree.inner + 1).bit_length() - 1):
        node = 2 * node + 1 + (x[rows, tree.axis[node]] >= tree.cut[node])
    return node - tree.inner


def within(tree: Tree, x: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of all leaves whose box is not farther from a row than its limit (squared)."""
    row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
    for level in range((tree.inner + 1).bit_length()):
        if level:
            row, node = np.repeat(row, 2), (2 * node[:, None] + [1, 2]).ravel()
        d2 = np.zeros(len(row))
        for k in range(x.shape[1]):
            y = x[row, k]
            d2 += np.maximum(np.maximum(tree.low[node, k] - y, y - tree.high[node, k]), 0.0) ** 2
        near = d2 <= limit[row]
        row, node = row[near], node[near]
    return row, node - tree.inner


def needed(points: np.ndarray, starts: np.ndarray, band: int) -> np.ndarray:
    """Rows that can be a nearest candidate: of equal vectors the first start, those up to two bands after it, and one more.

    A reference takes the first of equal vectors, or if that is within its
    band, the next one beyond; so no other is ever taken.
    """
    order = np.lexsort((starts, *points.T))
    p, s = points[order], starts[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]).any(1)
    first = s[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
    keep = s <= first + 2 * band
    keep[1:] |= keep[:-1] & ~new[1:]
    return np.sort(order[keep])


def nearest(x: np.ndarray, at: np.ndarray, points: np.ndarray, starts: np.ndarray, band: int, best: np.ndarray, who: np.ndarray, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Best squared distances and their starts, given those known before (inf and the largest number if none)."""
    best, who = best.copy(), who.copy()
    if not len(points):
        return best, who
    size = max(LEAF, 4 * (2 * band + 1))
    tree = grown(points, max(0, (len(points) - 1) // size).bit_length())
    leaf = leaf_of(tree, points)
    order = np.lexsort((starts, leaf))
    points, starts, leaf = points[order], starts[order], leaf[order]
    tree = tightened(tree, points, leaf)
    bounds = np.searchsorted(leaf, np.arange(tree.inner + 2))

    def compare(row: np.ndarray, cells: np.ndarray) -> None:
        by = np.argsort(cells, kind="stable")
        row, cells = row[by], cells[by]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)])) if len(cells) else np.zeros(1, int)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            own = slice(bounds[cells[a]], bounds[cells[a] + 1])
            if own.start == own.stop:
                continue
            for c in range(a, b, block):
                r = row[c : min(b, c + block)]
                d2 = np.zeros((len(r), own.stop - own.start))
                for k in range(x.shape[1]):
                    d2 += (x[r, k][:, None] - points[None, own, k]) ** 2
                d2[np.abs(at[r][:, None] - starts[None, own]) <= band] = np.inf
                place = d2.argmin(1)  # the first, so the smallest start of equal ones
                value, start = d2[np.arange(len(r)), place], starts[own][place]
                better = (value < best[r]) | ((value == best[r]) & (start < who[r]) & np.isfinite(value))
                best[r[better]], who[r[better]] = value[better], start[better]

    own = leaf_of(tree, x)
    compare(np.arange(len(x)), own)
    for rows in np.array_split(np.argsort(own, kind="stable"), -(-len(x) // block)):
        row, cells = within(tree, x[rows], best[rows])
        other = cells != own[rows[row]]
        compare(rows[row[other]], cells[other])
    return best, who


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Starts and vectors of a table."""
    flat = pa.concat_arrays([c.flatten() for c in table.column("vector").chunks]) if table.num_rows else pa.array([], pa.float64())
    return table.column("start").to_numpy(), flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, len(flat) // max(1, table.num_rows))


def nearest_neighbours(refs: DataFrame, candidates: DataFrame, band: int, start: str = "start", vector: str = "embedding", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, start, neighbour, d2): the candidate of its segment nearest to each reference whose start differs by more than `band`.

    Ties go to the smallest start; references without a candidate vanish, as do
    vectors with a missing part. A start stands for one place. Both sides may
    have any length. A cell with many references is dealt to several groups; of
    a vector that repeats endlessly only those rows move that can be an answer.
    Points that are all about equally far from each other (many dimensions)
    make a reference visit most cells: then it is all pairs, as before.
    """
    spark = refs.sparkSession
    ship_package(spark)
    keys = list(keys)
    side = lambda df: df.where(F.col(vector).isNotNull() & F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))).select(*keys, F.col(start).cast("long").alias("start"), F.col(vector).cast("array<double>").alias("vector"))
    other = cut(side(candidates))
    # columns of their own, as both sides meet again
    own = other.select(*[F.col(c).alias(c) for c in other.columns]) if refs is candidates else side(refs)
    held = [f"`{k}` {refs.schema[k].dataType.simpleString()}" for k in keys]
    counts = other.groupBy(*keys).agg(F.count("*").alias("n"))
    most = counts.agg(F.sum("n").alias("total"), F.max("n").alias("n")).first()
    size = max(CELL, 4 * (2 * band + 1), (most.total or 0) // CELLS)
    large = counts.where(F.col("n") > size).collect() if (most.n or 0) > size else []  # as many as there are cells, at most
    known = _trees(other, keys, large, size)
    if large:
        numbers = spark.createDataFrame([(*[r[k] for k in keys], i) for i, r in enumerate(large)], ", ".join([*held, "tree int"]))
        numbered = lambda df: _joined(df, numbers, keys).withColumn("tree", F.coalesce("tree", F.lit(-1)))
    else:
        numbered = lambda df: df.withColumn("tree", F.lit(-1))

    def placing(thin: bool):
        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            starts, x = _arrays(table)
            tree, cell = table.column("tree").to_numpy(), np.zeros(len(starts), np.int64)
            keep = tree < 0
            for t in np.unique(tree[tree >= 0]).tolist():
                rows = np.flatnonzero(tree == t)
                cell[rows] = leaf_of(known[t], x[rows])
                keep[rows[needed(x[rows], starts[rows], band)] if thin else rows] = True
            yield from table.append_column("cell", pa.array(cell)).filter(pa.array(keep)).to_batches(max_chunksize=10_000)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting, n = [], 0
            for batch in batches:
                waiting.append(batch)
                n += batch.num_rows
                if n >= HELD:
                    yield from flush(pa.Table.from_batches(waiting))
                    waiting, n = [], 0
            if n:
                yield from flush(pa.Table.from_batches(waiting))

        return run

    place = lambda df, thin: numbered(df).withColumn("cell", F.lit(0).cast("long")) if not large else cut(numbered(df).mapInArrow(placing(thin), ", ".join([*held, "start long, vector array<double>, tree int, cell long"])))
    own, other = place(own, False), place(other, True)

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left
        (at, x), (starts, points) = _arrays(left), _arrays(right)
        best = left.column("d2").fill_null(np.inf).to_numpy()
        who = left.column("neighbour").fill_null(np.iinfo(np.int64).max).to_numpy()
        if len(starts):
            few = needed(points, starts, band)
            best, who = nearest(x, at, points[few], starts[few], band, best, who)
        none = np.isinf(best)
        left = left.drop_columns(["d2", "neighbour"])
        return left.append_column("d2", pa.array(best, mask=none)).append_column("neighbour", pa.array(who, mask=none))

    def searched(visits: DataFrame) -> DataFrame:
        """Visits (a reference and a cell) with the best that the cell has for them."""
        parts = F.ceil(F.col("n") / GROUP).cast("int")
        crowded = visits.groupBy(*keys, "cell").agg(F.count("*").alias("n"))
        found = crowded.agg(F.sum(parts).alias("groups"), F.max("n").alias("n")).first()
        left, right = visits.withColumn("part", F.lit(0)), other.withColumn("part", F.lit(0))
        if (found.n or 0) > GROUP:
            heavy = cut(crowded.where(F.col("n") > GROUP).select(*keys, "cell", parts.alias("parts")))
            n = F.coalesce("parts", F.lit(1))
            left = visits.join(heavy, [*keys, "cell"], "left").withColumn("part", F.pmod(F.xxhash64("start"), n).cast("int"))
            right = other.join(heavy, [*keys, "cell"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), n - 1)))
        # a given number of partitions, as small groups make much work and mustn't be put together
        tasks = min(max(found.groups or 1, spark.sparkContext.defaultParallelism), TASKS)
        left, right = (df.repartition(tasks, *keys, "cell", "part").groupBy(*keys, "cell", "part") for df in (left.select(*columns, "part"), right.select(*keys, "cell", "part", "start", "vector")))
        return left.cogroup(right).applyInArrow(search, ", ".join([*held, "cell long, start long, vector array<double>, tree int, part int, d2 double, neighbour long"]))

    columns = [*keys, "cell", "start", "vector", "tree", "d2", "neighbour"]
    first = searched(own.select(*keys, "cell", "start", "vector", "tree", F.lit(None).cast("double").alias("d2"), F.lit(None).cast("long").alias("neighbour")))
    if not large:
        return first.where("d2 IS NOT NULL").select(*keys, "start", "neighbour", "d2")
    first = cut(first)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                table = pa.Table.from_batches([batch.slice(at, 2048)])
                _, x = _arrays(table)
                tree, limit, home = table.column("tree").to_numpy(), table.column("d2").fill_null(np.inf).to_numpy(), table.column("cell").to_numpy()
                for t in np.unique(tree).tolist():
                    rows = np.flatnonzero(tree == t)
                    row, cell = within(known[t], x[rows], limit[rows])
                    far = cell != home[rows[row]]
                    out = table.take(pa.array(rows[row[far]]))
                    yield from out.set_column(out.column_names.index("cell"), "cell", pa.array(cell[far])).to_batches(max_chunksize=10_000)

    visits = first.where("tree >= 0").select(*columns).mapInArrow(reach, ", ".join([*held, "cell long, start long, vector array<double>, tree int, d2 double, neighbour long"]))
    second = searched(cut(visits))
    both = first.select(*keys, "start", "d2", "neighbour").union(second.select(*keys, "start", "d2", "neighbour")).where("d2 IS NOT NULL")
    best = both.groupBy(*keys, "start").agg(F.min(F.struct("d2", "neighbour")).alias("best"))
    return best.select(*keys, "start", "best.neighbour", "best.d2")


def _joined(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(F.broadcast(small), keys, "left") if keys else df.crossJoin(F.broadcast(small))


def _trees(points: DataFrame, keys: list[str], large: list, size: int) -> list[Tree]:
    """A tree for each large segment, from a sample of its points (SAMPLE for each cell, about)."""
    if not large:
        return []
    cells = [-(-r.n // size) for r in large]
    n = sum(r.n for r in large)
    share = min(1.0, SAMPLE * sum(cells) / n)
    kinds = ", ".join([f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys] + ["tree int"])
    numbers = points.sparkSession.createDataFrame([(*[r[k] for k in keys], i) for i, r in enumerate(large)], kinds)
    sampled = F.pmod(F.xxhash64("start", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))
    inner = points.where(sampled)
    table = (inner.join(F.broadcast(numbers), keys) if keys else inner.crossJoin(F.broadcast(numbers))).select("tree", "start", "vector").toArrow()
    tree = table.column("tree").to_numpy()
    _, x = _arrays(table)
    dim = x.shape[1] if len(x) else 1
    return [grown(x[tree == i] if len(x) else np.zeros((0, dim)), (c - 1).bit_length()) for i, c in enumerate(cells)]
