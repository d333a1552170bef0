"""MinHash near-duplicate detection with odd sketches.

Per text: the set of its word shingles, 128 MinHash samples of it, and a parity
bitmap (odd sketch) into which the samples are folded. Texts with equal sets
form one class at once. Classes that share a band of samples are compared by
the population count of the XOR of their bitmaps, which estimates similarities
near one precisely; what may reach the threshold is confirmed on the full sets.

A large bucket or cluster is compared in blocks, each member once. What its
blocks have not joined is then compared by one member of each joined part, and
only parts that stay apart are compared in full with the rest of their group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.llm import graph, scratch, textprep
from tidewright.session import ship_package

SAMPLES, ROWS = 128, 4
BANDS = SAMPLES // ROWS
BITS = 1024
#: Standard errors that an estimate may fall below the threshold before a pair is given up (one in three million).
SLACK = 5.0
#: Members of a block; larger groups are split, and no task compares more than two blocks at once.
BLOCK = 512
#: Blocks of a group up to which all pairs of blocks are compared at once.
PAIRED = 8
#: Members that a task compares by sketches, and with their sets, about.
SKETCH_ROWS, SET_ROWS = 40_000, 4_000

_RNG = np.random.default_rng(917)
_MULT = _RNG.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint32)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES minima for each non-empty set."""
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((SAMPLES, len(sets)), np.uint32)
    held, other = np.empty_like(low), np.empty_like(low)
    for i in range(SAMPLES):
        np.bitwise_xor(low, _XOR[i], out=held)
        np.multiply(held, _MULT[i], out=held)
        np.right_shift(held, np.uint32(15), out=other)
        np.bitwise_xor(held, other, out=held)
        np.multiply(held, np.uint32(0x2C1B3C6D), out=held)
        np.minimum.reduceat(held, starts, out=out[i])
    return out.T


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Bitmaps of BITS bits: bit h(i, sample i) is flipped for every i. One row for each set."""
    at = textprep.mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    bits = np.zeros((len(samples), BITS), np.uint8)
    for i in range(SAMPLES):
        bits[np.arange(len(samples)), at[:, i].astype(np.int64)] ^= 1
    return np.packbits(bits, axis=1)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of bits in which two odd sketches differ."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * differing / BITS, 1e-9))


def most_bits(threshold: float) -> int:
    """The largest number of differing bits at which a pair is still confirmed."""
    least = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / SAMPLES)
    return int(np.max(np.flatnonzero(estimate(np.arange(BITS // 2)) >= least)))


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, a 128-bit digest of the set (d1, d2), band keys and odd sketch.

    A text of any length is read whole, its set held in the task; a text
    without words, or null, has no bands and no sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textprep.slices(batch, "text"):
                sets = list(textprep.shingle_sets(part.column("text"), width))
                n = np.array([len(s) for s in sets], np.int64)
                d1 = np.array([int(np.bitwise_xor.reduce(s)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                d2 = np.array([int(np.add.reduce(textprep.mix(s))) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                bands: list = [None] * len(sets)
                sketch: list = [None] * len(sets)
                if full := np.flatnonzero(n).tolist():
                    samples = minhash([sets[i] for i in full])
                    keys = np.zeros((len(full), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                    for r in range(ROWS):
                        keys = textprep.mix(keys ^ (samples[:, r::ROWS].astype(np.uint64) + np.uint64(r << 32)))
                    maps = odd_sketch(samples)
                    for row, i in enumerate(full):
                        bands[i], sketch[i] = keys[row].view(np.int64), maps[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        part.column("text_hash"),
                        pa.array(n),
                        pa.array(d1),
                        pa.array(d2),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(sketch, pa.binary()),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "d1", "d2", "bands", "sketch"],
                )

    schema = "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


class Forest:
    """Union-find over positions; the pairs that joined two trees are the forest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def likely_pairs(words: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs of rows (bitmaps as 64-bit words) that differ in `most` bits at most, most similar first."""
    if len(words) == 2:
        return [(0, 1)] if np.bitwise_count(words[0] ^ words[1]).sum() <= most else []
    found = []
    for i in range(len(words) - 1):
        differing = np.bitwise_count(words[i] ^ words[i + 1 :]).sum(1)
        hit = np.flatnonzero(differing <= most)
        found.append(np.stack([differing[hit].astype(np.int64), np.full(len(hit), i), hit + i + 1]))
    if not found:
        return []
    pairs = np.concatenate(found, axis=1)
    return list(zip(*pairs[1:, np.argsort(pairs[0], kind="stable")].tolist()))


def link_batch(ids: np.ndarray, links: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], ["a", "b"])


def compared(placed: DataFrame, threshold: float, percent: int | None, tasks: int) -> DataFrame:
    """(a, b): in each cell (grp, x, y) of placed (id, label, sketch) stars that join what its likely pairs join.

    Members with one label are joined already. With percent a pair has to hold
    on the full sets (column shingles) as well.
    """
    most = most_bits(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in textprep.sorted_groups(batches, ["grp", "x", "y"]):
            ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
            maps = textprep.fixed_bytes(table.column("sketch"), BITS // 8).view(np.uint64)
            sets = table.column("shingles") if percent else None
            links = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if b - a < 2:
                    continue
                forest, seen = Forest(b - a), {}
                for k, label in enumerate(labels[a:b].tolist()):
                    forest.join(seen.setdefault(label, k), k)
                own = [np.frombuffer(v.as_buffer(), np.uint64) for v in sets.slice(a, b - a)] if percent else []
                for i, j in likely_pairs(maps[a:b], most) if len(seen) > 1 else []:
                    if forest.root(i) != forest.root(j) and (not percent or alike(own[i], own[j], percent)):
                        forest.join(i, j)
                # a star around the smallest id of what is joined, one edge for each label
                links += [(a + forest.root(k), a + k) for k in seen.values() if forest.root(k) != k]
            yield link_batch(ids, links)

    columns = ["grp", "x", "y", "id", "label", "sketch", *["shingles"] * bool(percent)]
    dealt = placed.select(*columns).repartition(tasks, "grp", "x", "y").sortWithinPartitions("grp", "x", "y", "id")
    return dealt.mapInArrow(run, "a long, b long")


def block_of(blocks: str | Column, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), blocks).cast("int")


def group_links(members: DataFrame, payload: Callable[[DataFrame], DataFrame], threshold: float, percent: int | None = None) -> DataFrame:
    """(a, b): links that join, in each group of members (grp, id), all that its pairs join.

    payload gives the sketches (and sets) of a table's ids. Groups of up to
    BLOCK members are one cell; of up to PAIRED blocks each pair of blocks is a
    cell, so a member is sent PAIRED times at most. Of a larger group each
    block is a cell; then, in rounds, one member of each part that is joined so
    far stands for it. What stays apart after that is compared exactly: each
    member outside a group's largest part with all members of the group. So a
    large group whose members are alike costs its size, and only what is not
    alike is sent more than a few times.
    """
    sized = members.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    other = F.explode(F.when((F.col("blocks") > 1) & (F.col("blocks") <= PAIRED), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))).alias("other")
    placed = members.join(sized, "grp").select("grp", "id", "blocks", block_of("blocks").alias("own")).select("*", other)
    placed = placed.select("grp", "id", "blocks", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    placed = scratch.table(placed, "members")

    def cells(df: DataFrame) -> DataFrame:
        """Links of the cells of a table; the number of tasks follows its rows."""
        tasks = df.count() // (SET_ROWS if percent else SKETCH_ROWS) + 1
        return scratch.table(compared(payload(df), threshold, percent, tasks), "cells")

    links = cells(placed.select("grp", "x", "y", "id", F.col("id").alias("label")))
    large = placed.where(F.col("blocks") > PAIRED).select("grp", "id")
    if large.isEmpty():
        return links
    large, step, whole = scratch.table(large, "large"), 0, False
    while True:
        step += 1
        part = graph.components(links).withColumnRenamed("component", "label")
        named = scratch.table(large.join(part, "id", "left").select("grp", "id", F.coalesce("label", "id").alias("label")), "named")
        if whole:
            break
        reps = named.groupBy("grp", "label").agg(F.min("id").alias("id"))
        apart = reps.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        meet = scratch.table(reps.join(apart, "grp").select("grp", "id", "label", "blocks", block_of("blocks", step).alias("x"), block_of("blocks", step).alias("y")), "reps")
        blocks = meet.agg(F.max("blocks")).first()[0]
        if blocks is None:
            return links
        found = cells(meet.drop("blocks"))
        if found.isEmpty():  # as many parts as before
            break
        links, whole = links.union(found), blocks == 1  # all parts of a group have met in one block
    sizes = named.groupBy("grp", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n_all"), F.count("*").alias("parts"))
    ceil = lambda c: F.ceil(c / BLOCK).cast("int")
    main = main.where("parts > 1").select("grp", "main", ceil(F.col("n_all") - F.col("n_main")).alias("others"), ceil(F.col("n_main")).alias("mains"))
    in_main = F.col("label") == F.col("main")
    own = F.when(in_main, F.col("others") + block_of("mains")).otherwise(block_of("others"))
    every = F.sequence(F.lit(0), F.when(in_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)
    rest = named.join(main, "grp").withColumn("own", own).withColumn("other", F.explode(every))
    rest = scratch.table(rest.select("grp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "label"), "rest")
    return links if rest.isEmpty() else links.union(cells(rest))


def likely_links(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join, in each band bucket, what pairs that may reach the threshold join."""
    sketches = reps.select("id", "sketch")
    return group_links(reps.select(F.explode("bands").alias("grp"), "id"), lambda df: df.join(sketches, "id"), threshold)


def confirmed_links(docs: DataFrame, clusters: DataFrame, width: int, percent: int, sketches: DataFrame) -> DataFrame:
    """(a, b): links that join, in each cluster, what pairs that hold on the full sets join."""
    text = docs.select(F.col("doc_id").alias("id"), "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textprep.slices(batch, "text"):
                sets = [s.tobytes() for s in textprep.shingle_sets(part.column("text"), width)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    def payload(df: DataFrame) -> DataFrame:
        # one row for an id, whatever repeats in docs: members are classes' smallest ids
        sets = text.join(df.select("id").distinct(), "id").mapInArrow(to_sets, "id long, shingles binary")
        return df.join(sets.groupBy("id").agg(F.first("shingles").alias("shingles")), "id").join(sketches, "id")

    return group_links(clusters.select(F.col("component").alias("grp"), "id"), payload, percent / 100, percent)


def alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection of two sorted sets is percent times the union at least."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    if len(p) > len(q):
        p, q = q, p
    at = np.searchsorted(q, p)
    at[at == len(q)] = 0
    shared = int(np.count_nonzero(q[at] == p))
    return 100 * shared >= percent * (len(p) + len(q) - shared)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash for each row of docs (doc_id, text, ...).

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest doc_id that links reach, and
    kept is doc_id = component_id. Null and empty texts and texts without
    words have no shingles and stay alone. Texts of any length are read whole;
    the set of one text is held in a task. Rows that repeat a doc_id share one
    component, found from the text of any of them. Other columns are ignored;
    an empty table gives an empty one.

    Rows find the class of their set by a shuffle join of thin rows; a set
    that very many rows share makes a large partition of it, which Spark's
    adaptive skew join splits.
    """
    spark = docs.sparkSession
    ship_package(spark)
    feats = scratch.table(features(docs, width), "features")
    full = feats.where("n_shingles > 0")
    classes = full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("id"))
    classes = scratch.table(classes, "classes")
    reps = full.join(classes.select(F.col("id").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"])
    reps = reps.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "bands", "sketch")
    reps = scratch.table(reps, "reps")
    near = likely_links(reps, percent / 100)
    links = confirmed_links(docs, graph.components(near), width, percent, reps.select("id", "sketch"))
    linked = graph.components(links)
    named = classes.join(linked, "id", "left").select("d1", "d2", "n_shingles", F.coalesce("component", "id").alias("component"))
    thin = ["doc_id", "text_hash", "n_shingles"]
    # texts without words have no class
    alone = feats.where("n_shingles = 0").select(*thin, F.lit(None).cast("long").alias("component"))
    out = full.select(*thin, "d1", "d2").join(named, ["d1", "d2", "n_shingles"], "left").select(*thin, "component").union(alone)
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"), "text_hash")


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one document of each group of near duplicates, with all columns as they are.

    The document with the smallest doc_id of a group stays; of rows that
    repeat its doc_id, that with the smallest hash of its text. Rows without
    a doc_id stay, one for each different text, unless a document with one has
    the same set of shingles. A null or empty text is a group of its own. What
    stays is decided on thin rows; texts are shuffled once. Columns named
    __none, __doc, __text and __rank are not kept apart from the function's own.
    """
    found = near_duplicates(docs, width, percent).where("component_id <=> doc_id")
    none, doc = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    each = F.when(none, F.col("text_hash"))  # rows without an id don't repeat one
    kept = found.groupBy(none.alias("__none"), doc.alias("__doc"), each.alias("__each")).agg(F.min("text_hash").alias("__text")).drop("__each")
    key = ["__none", "__doc", "__text"]
    held = docs.withColumns({"__none": none, "__doc": doc, "__text": F.xxhash64("text")}).join(kept, key, "left_semi")
    ranked = held.withColumn("__rank", F.row_number().over(W.partitionBy(*key).orderBy("__text")))
    return ranked.where("__rank = 1").select([F.col(f"`{c}`") for c in docs.columns])
