"""Mixing of sources to target weights by hierarchical budgeting.

DataFrame functions only. Token counts by leaf of the tree domain - language -
source are the one aggregate of the documents; budgets are shared out on that
small table, level by level. A leaf's documents are then taken in a seeded
order, epoch by epoch, up to the leaf's budget. Prefix sums of a leaf go by
buckets of that order, so a large leaf is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.llm import scratch

LEVELS = ["domain", "language", "source"]
BLANK = r"[\\x20\\x09-\\x0D]+"
#: Hex digits of the seeded hash that make a bucket: 4,096 buckets of a leaf and epoch.
BUCKET_DIGITS = 3


def tokens_of(text: str = "text") -> Column:
    """Tokens of a text: its words (runs of other characters than blanks)."""
    return F.expr(f"CAST(size(filter(split(coalesce({text}, ''), '{BLANK}'), w -> w <> '')) AS LONG)")


def share(children: DataFrame, parent: list[str], budget: str, weight: str, capacity: str, out: str) -> DataFrame:
    """Divide each parent's budget among its children in proportion to weight, none above its capacity.

    What a child can't take goes to its siblings by weight. Children are
    ranked by capacity / weight; those up to some rank are full, and the rest
    share what is left. All of the budget is used unless all are full.
    """
    ratio = F.col(capacity) / F.col(weight)
    w = W.partitionBy(*parent).orderBy("__ratio", *[c for c in LEVELS if c in children.columns])
    before = w.rowsBetween(W.unboundedPreceding, -1)
    return (
        children.withColumn("__ratio", F.when(F.col(weight) > 0, ratio).otherwise(F.lit(float("inf"))))
        .withColumn("__full", F.coalesce(F.sum(F.col(capacity).cast("double")).over(before), F.lit(0.0)))
        .withColumn("__weight", F.sum(F.greatest(F.col(weight), F.lit(0.0))).over(w.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("__level", F.when(F.col("__weight") > 0, (F.col(budget) - F.col("__full")) / F.col("__weight")))
        # full children come first; the level of the first that isn't holds for all after it
        .withColumn("__open", (F.col(weight) > 0) & (F.col("__ratio") > F.col("__level")))
        .withColumn("__rest", F.first(F.when(F.col("__open"), F.col("__level")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn(
            out,
            F.when(F.col(weight) <= 0, F.lit(0.0))
            .when(F.col("__rest").isNull(), F.col(capacity).cast("double"))
            .otherwise(F.least(F.col(capacity).cast("double"), F.greatest(F.lit(0.0), F.col(weight) * F.col("__rest")))),
        )
        .drop("__ratio", "__full", "__weight", "__level", "__open", "__rest")
    )


def weight_of(level: list[str], weights: dict[str, float]) -> Column:
    """The weight of a node named by its path, as in 'd0/en/src3'; 1 where none is given."""
    name = F.concat_ws("/", *level)
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in kv])
    return F.coalesce(F.try_element_at(table, name), F.lit(1.0)).cast("double")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, float], max_epochs: int) -> DataFrame:
    """Leaves (domain, language, source, tokens) with the budget of each, in whole tokens."""
    caps = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    held = caps.groupBy().agg(F.sum("capacity").alias("all")).select(F.least(total.cast("double"), F.col("all").cast("double")).alias("budget0"))
    out = held
    for depth in range(1, 4):
        level = LEVELS[:depth]
        nodes = caps.groupBy(*level).agg(F.sum("capacity").alias(f"cap{depth}")).withColumn(f"w{depth}", weight_of(level, weights))
        # the parents of a level are a few aggregated rows; the root is one row
        joined = nodes.crossJoin(F.broadcast(out)) if depth == 1 else nodes.join(out, level[:-1])
        out = share(joined, level[:-1], f"budget{depth - 1}", f"w{depth}", f"cap{depth}", f"budget{depth}").select(*level, f"budget{depth}")
    return leaves.join(out, LEVELS).withColumn("budget", F.floor(F.col("budget3") + 1e-6).cast("long")).select(*LEVELS, "tokens", "budget")


def mix(
    docs: DataFrame,
    domain: Column,
    weights: dict[str, float] | None = None,
    fraction: float = 0.5,
    max_epochs: int = 1,
    seed: int = 0,
    language: str = "lang",
    source: str = "source",
) -> DataFrame:
    """doc_id, domain, language, source, tokens, epoch, position for each selection of a document.

    The whole budget is `fraction` of all tokens. In epoch e, counted from 0,
    the documents of a leaf come in the order of a hash of seed, e and doc_id
    (ties by doc_id, then by text), and one is selected if its tokens and those before it,
    earlier epochs included, fit into the budget of the leaf; position is the
    sum of the tokens before it. Null fields of the tree are the branch ''. A
    document without tokens is selected where the sum before it fits. Rows
    that repeat a doc_id count each. A node of weight 0 or less gets nothing,
    its siblings what it would have; with a fraction of 0 or less no document
    with tokens fits. Other columns are ignored. An empty table
    gives an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    named = {"domain": domain.cast("string"), "language": F.col(language).cast("string"), "source": F.col(source).cast("string")}
    rows = docs.select("doc_id", *[F.coalesce(c, F.lit("")).alias(k) for k, c in named.items()], tokens_of().alias("tokens"), F.crc32(F.encode(text, "UTF-8")).alias("tie"))
    rows = scratch.table(rows, "tokens")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    total = leaves.agg(F.coalesce(F.floor(F.sum("tokens") * F.lit(fraction)), F.lit(0)).alias("t")).first()["t"]
    plan = scratch.table(budgets(leaves, F.lit(total), weights or {}, max_epochs).withColumnRenamed("tokens", "leaf_tokens"), "budgets")
    epochs = F.explode(F.sequence(F.lit(0), F.least(F.lit(max_epochs - 1), F.floor(F.col("budget") / F.greatest(F.col("leaf_tokens"), F.lit(1))).cast("int"))))
    runs = plan.withColumn("epoch", epochs).withColumn("left", F.col("budget") - F.col("epoch") * F.col("leaf_tokens")).where("left >= 0")
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("doc_id").cast("string")).cast("binary"))
    placed = rows.join(runs, LEVELS).withColumn("key", key).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    group = [*LEVELS, "epoch", "bucket"]
    sums = placed.groupBy(*group).agg(F.sum("tokens").alias("n"))
    ahead = W.partitionBy(*LEVELS, "epoch").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    within = W.partitionBy(*group).orderBy("key", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    position = F.col("ahead") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    return (
        placed.join(sums, group)
        .withColumn("position", position)
        .where(F.col("position") + F.col("tokens") <= F.col("left"))
        .select("doc_id", *LEVELS, "tokens", "epoch", (F.col("position") + F.col("epoch") * F.col("leaf_tokens")).alias("position"))
    )


def selected(docs: DataFrame, domain: Column, weights: dict[str, float] | None = None, fraction: float = 0.5, seed: int = 0, **names: str) -> DataFrame:
    """The rows of docs that one epoch of mix() selects, with all columns as they are; rows that share a doc_id stay together.

    Null and empty texts have no tokens (see mix). A column named __chosen is
    not kept apart from the function's own.
    """
    chosen = mix(docs, domain, weights, fraction, 1, seed, **names).select(F.col("doc_id").alias("__chosen")).distinct()
    return docs.join(chosen, F.expr("doc_id <=> __chosen"), "left_semi").select([F.col(f"`{c}`") for c in docs.columns])
