"""Sharding by histogram sort.

Every row has a 16-byte key, a hash of its text followed by one of its id, so
equal texts are neighbours. Rounds count the exact bytes and rows between
candidate boundaries (probes) over all partitions and refine the probes until
each splitter meets the tolerance; then the rows are exchanged once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidewright.llm import scratch
from tidewright.session import ship_package

SPACE = 1 << 128
#: Probes put into an interval that needs refinement, in each round.
FAN = 32
#: The most bytes that a splitter may be off its target, as a part of a shard.
TOLERANCE = 0.002
#: Parts of a shard that tasks sort separately, at least; none holds more than that part of a shard (or one key).
PARTS = 8
#: Bytes of a part, about, and parts in all, at most: a large corpus has more parts instead of larger ones.
PART_BYTES, MAX_PARTS = 1 << 28, 1 << 16


def _bytes16(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(16, "big") for k in keys], dtype="V16").view("S16")


def size_of(text: str = "text") -> Column:
    """What a row counts: the UTF-8 bytes of its text (null: none) plus 16."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 16


def key_columns() -> dict[str, Column]:
    """The key of a row: a hash of its text (high), then one of its id (low)."""
    return {
        "__high": F.xxhash64(F.coalesce("text", F.lit(""))),
        "__low": F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)),
    }


def _keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """16-byte keys that sort as the pair of unsigned numbers."""
    both = np.empty((len(high), 2), ">u8")
    both[:, 0], both[:, 1] = high.view(np.uint64), low.view(np.uint64)
    return both.view("S16").ravel()


def histogram(rows: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """By interval between sorted probes: bytes, rows, and the smallest and largest key in it."""
    edges = _bytes16(probes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, number = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        low, high = {}, {}
        for batch in batches:
            keys = _keys(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("__high", "__low")))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            at = np.searchsorted(edges, keys, side="right")
            np.add.at(size, at, batch.column("size").to_numpy(zero_copy_only=False)[order])
            np.add.at(number, at, 1)
            for k in np.unique(at).tolist():
                first, last = np.searchsorted(at, k), np.searchsorted(at, k, side="right") - 1
                a, b = keys[first : first + 1].tobytes(), keys[last : last + 1].tobytes()
                low[k], high[k] = min(a, low.get(k, a)), max(b, high.get(k, b))
        own = sorted(low)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int32()), pa.array(size[own]), pa.array(number[own]), pa.array([low[k] for k in own], pa.binary()), pa.array([high[k] for k in own], pa.binary())],
            ["k", "size", "number", "low", "high"],
        )

    parts = rows.select("size", "__high", "__low").mapInArrow(count, "k int, size long, number long, low binary, high binary")
    total = parts.groupBy("k").agg(F.sum("size"), F.sum("number"), F.min("low"), F.max("high"))
    # at most one row for each probe
    return {r[0]: (r[1], r[2], int.from_bytes(r[3], "big"), int.from_bytes(r[4], "big")) for r in total.collect()}


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, parts: int = PARTS) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The lower key of shards 1, 2, ..., and all known boundaries as (key, bytes below, rows below)."""
    probes = [SPACE * i // (shards * parts * 2) for i in range(1, shards * parts * 2)]
    known: dict[int, tuple[int, int]] = {}
    while True:
        held = histogram(rows, probes)
        below, count, open_ = 0, 0, []
        for k in range(len(probes) + 1):
            size, number, low, high = held.get(k, (0, 0, 0, -1))
            if size:
                open_.append((below, count, size, number, low, high))
            below, count = below + size, count + number
            if k < len(probes):
                known[probes[k]] = (below, count)
        total = below
        known[0], known[SPACE] = (0, 0), (total, count)
        allowed, cap = tolerance * total / shards, total / (shards * parts)
        targets = [total * s / shards for s in range(1, shards)]
        new: set[int] = set()
        for start, _, size, number, low, high in open_:
            inside = any(start < t < start + size and min(t - start, start + size - t) > allowed for t in targets)
            if number > 1 and high > low and (inside or size > 2 * cap):
                new |= {low + (high - low) * i // FAN for i in range(1, FAN)} | {low, high, high + 1}
                if (low >> 64) != (high >> 64):  # a frequent text in it gets boundaries of its own
                    new |= {(low >> 64) + 1 << 64, (high >> 64) << 64}
        new -= known.keys()
        if not new:
            break
        # earlier boundaries are counted again, so that all sums are of one pass
        probes = sorted(k for k in new | known.keys() if 0 < k < SPACE)
    bounds = sorted((k, *v) for k, v in known.items())
    at = np.array([b[1] for b in bounds], np.float64)
    chosen = []
    for t in targets:
        near = np.flatnonzero(np.abs(at - t) <= allowed)
        if len(near):  # of the boundaries within tolerance, rather one between different texts
            whole = [i for i in near if bounds[i][0] % (1 << 64) == 0] or list(near)
            i = min(whole, key=lambda i: abs(at[i] - t))
        else:
            i = int(np.argmin(np.abs(at - t)))
        chosen.append(max(bounds[i][0], chosen[-1] if chosen else 0))
    return chosen, bounds


def parts_for(total: int, shards: int) -> int:
    """Parts of a shard for a corpus of `total` bytes."""
    return max(PARTS, min(-(-total // (shards * PART_BYTES)), MAX_PARTS // shards))


def shard(docs: DataFrame, shards: int = 40, tolerance: float = TOLERANCE, parts: int = 0) -> DataFrame:
    """The rows of docs (doc_id, text, ...) with law, shard and slot.

    Shards are nearly equal in bytes (law `bytes`, see size_of), off by twice
    the tolerance and one row at most. Equal texts are neighbours in
    (shard, slot) order and share a shard unless a boundary must cut their
    group to meet the tolerance. slot numbers the rows of a shard without
    gaps. Rows with equal text and doc_id have equal keys; they stay in one
    shard, in any order. Columns named law, shard or slot are replaced, all
    others stay. A null text is empty, a null doc_id is a key of its own. An
    empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop("law", "shard", "slot")
    if clash := [c for c in docs.columns if c in ("__high", "__low", "__piece", "__base", "__key")]:
        out = shard(docs.withColumnsRenamed({c: f"__own{c}" for c in clash}), shards, tolerance, parts)
        return out.withColumnsRenamed({f"__own{c}": c for c in clash})
    rows = scratch.table(docs.select(size_of().alias("size"), *[c.alias(k) for k, c in key_columns().items()]), "keys")
    parts = parts or parts_for(rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], shards)
    chosen, bounds = splitters(rows, shards, tolerance, parts)
    cuts = {0, *chosen}
    total = max(bounds[-1][1], 1)
    own, last = [], None
    for k, size, count in bounds[:-1]:  # pieces of about a part of a shard
        if k in cuts or last is None or size - last >= total / (shards * parts):
            own.append((k, count))
            last = size
    edges = _bytes16([k for k, _ in own])
    shard_of = np.searchsorted(np.array([int(c) for c in chosen], dtype=object), np.array([k for k, _ in own], dtype=object), side="right").astype(np.int64)
    count_of = np.array([c for _, c in own], np.int64)
    first = np.array([count_of[np.flatnonzero(shard_of == s)[0]] for s in shard_of], np.int64)
    base = count_of - first

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _keys(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("__high", "__low")))
            at = np.searchsorted(edges, keys, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at.astype(np.int32)), pa.array(shard_of[at].astype(np.int32)), pa.array(base[at]), pa.array([k.ljust(16, b"\0") for k in keys.tolist()], pa.binary())],
                [*batch.schema.names, "__piece", "shard", "__base", "__key"],
            )

    keyed = docs.withColumns(key_columns())
    schema = T.StructType([*keyed.schema.fields, *T.StructType.fromDDL("__piece int, shard int, __base long, __key binary").fields])
    rank = F.row_number().over(W.partitionBy("__piece").orderBy("__key"))
    slot = (F.col("__base") + rank - 1).cast("long")
    return keyed.mapInArrow(place, schema).select(*[F.col(f"`{c}`") for c in docs.columns], F.lit("bytes").alias("law"), "shard", slot.alias("slot"))
