"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import scratch

#: Edges of a partition, about: a few edges make few partitions, whatever the session's number.
PART_EDGES = 400_000
#: Pairs of one node from which they are not dealt to one partition.
HUB = PART_EDGES


def with_smallest(pairs: DataFrame, rows: int, hub: int) -> DataFrame:
    """(u, v, m) for each of `rows` pairs (u, v): m is the smallest of u and of all that it is paired with.

    The pairs of a node meet in a partition. A node with more than `hub` pairs
    is looked up in a table that is broadcast instead: rows / hub nodes at
    most, each counted by a partial aggregation, so its pairs stay where they are.
    Pairs may repeat.
    """
    low = F.least(F.min("v"), F.col("u")).alias("m")
    rest, stars = pairs, None
    if rows > hub:
        hubs = scratch.table(pairs.groupBy("u").agg(low, F.count("*").alias("n")).where(F.col("n") > hub).select("u", "m"), "hubs")
        if not hubs.isEmpty():
            stars = pairs.join(F.broadcast(hubs), "u").select("u", "v", "m")
            rest = pairs.join(F.broadcast(hubs), "u", "left_anti")
    rest = rest.repartition(rows // PART_EDGES + 1, "u").distinct()
    own = rest.join(rest.groupBy("u").agg(low), "u").select("u", "v", "m")
    return own if stars is None else own.union(stars)


def components(edges: DataFrame, a: str = "a", b: str = "b", hub: int = HUB) -> DataFrame:
    """(id, component) for every id that an edge joins to another; component is the smallest id that it reaches.

    Large-star links each node's larger neighbours to its smallest one,
    small-star its smaller ones; a logarithmic number of rounds leaves stars
    around the smallest ids. A round is three exchanges of rows of two ids, in
    partitions of about PART_EDGES edges, and ends in a table; no partition
    holds more than `hub` edges of one node. Edges may repeat; loops are left
    out; an empty table gives an empty one.
    """
    e = scratch.table(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v"), "edges")
    rows, before = e.count(), None
    while rows:
        n = rows // PART_EDGES + 1
        large = with_smallest(e.union(e.select("v", "u")), 2 * rows, 2 * hub).where("v > u").select(F.col("m").alias("u"), "v").where("u < v")
        if rows > hub:  # hubs are looked for first, so it is read twice
            large = scratch.table(large, "large")
        # small-star: every edge (u < v) seen from v
        joined = with_smallest(large.select(F.col("v").alias("u"), F.col("u").alias("v")), rows, hub)
        edges_ = joined.select(F.col("m").alias("u"), F.col("u").alias("v")).union(joined.select(F.col("m").alias("u"), "v"))
        e = scratch.table(edges_.where("u < v").repartition(n, "u", "v").distinct(), "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        rows, before = state[0], state
    # stars: each v has one u, and each u is its own
    leaves = e.select(F.col("v").alias("id"), F.col("u").alias("component"))
    return leaves.union(e.select("u").distinct().select(F.col("u").alias("id"), F.col("u").alias("component")))
