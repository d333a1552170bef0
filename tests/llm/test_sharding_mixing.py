import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tests.llm import cases
from tidewright.llm import mixing, queries, sharding


def check_shards(docs, shards):
    rows = sharding.shard(docs, shards).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert len(rows) == docs.count()
    held = defaultdict(list)
    for r in rows:
        assert r.law == "bytes" and 0 <= r.shard < shards
        held[r.shard].append(r)
    for own in held.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    total, largest = sum(size(r.text) for r in rows), max(size(r.text) for r in rows)
    for s in range(shards):
        got = sum(size(r.text) for r in held[s])
        assert abs(got - total / shards) <= 2 * sharding.TOLERANCE * total / shards + 2 * largest
    # equal texts are neighbours in (shard, slot)
    order = [r.text or "" for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert sum(a != b for a, b in zip(order, order[1:])) + 1 == len(set(order))


def test_shards_of_edge_cases(spark):
    docs = cases.edge_documents(spark)
    check_shards(docs, 5)
    out = sharding.shard(docs, 5)
    assert out.schema.names == [c for c in docs.schema.names if c not in ("shard", "slot", "law")] + ["law", "shard", "slot"]


def test_shards_of_a_group_of_equal_texts(spark):
    rows = [(i, "the same text again and again" if i % 3 else f"text {i} " * (i % 17)) for i in range(3000)]
    check_shards(cases.documents(spark, rows).repartition(7), 8)


def test_a_large_corpus_has_more_parts(spark):
    assert sharding.parts_for(0, 40) == sharding.parts_for(10**9, 40) == sharding.PARTS
    assert sharding.parts_for(10**12, 40) == -(-(10**12) // (40 * sharding.PART_BYTES))
    assert sharding.parts_for(10**14, 40) == sharding.MAX_PARTS // 40
    docs = cases.edge_documents(spark)
    few, many = ({(r.doc_id, r.text): (r.shard, r.slot) for r in sharding.shard(docs, 5, parts=p).collect()} for p in (8, 40))
    assert len(few) == len(many)
    assert sorted(few.values()) != [] and {k: v[0] for k, v in few.items()}.keys() == many.keys()


def test_shards_of_an_empty_table(spark):
    empty = cases.documents(spark, [(1, "a")]).where("doc_id < 0")
    assert sharding.shard(empty, 5).collect() == []


def brute_mix(rows, weights, fraction, epochs, seed):
    """rows: (doc_id, domain, language, source, tokens); the selections, by the plain rule."""
    leaves = defaultdict(list)
    for r in rows:
        leaves[r[1:4]].append(r)
    caps = {k: epochs * sum(r[4] for r in v) for k, v in leaves.items()}
    total = min(int(sum(r[4] for r in rows) * fraction), sum(caps.values()))

    def share(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        children = sorted({k[: len(prefix) + 1] for k in caps if k[: len(prefix)] == prefix})
        cap = {c: sum(v for k, v in caps.items() if k[: len(c)] == c) for c in children}
        weight = {c: weights.get("/".join(c), 1.0) for c in children}
        got, open_, left = {}, set(children), budget
        while open_:
            level = left / sum(weight[c] for c in open_)
            full = {c for c in open_ if cap[c] <= weight[c] * level}
            if not full:
                got |= {c: weight[c] * level for c in open_}
                break
            for c in full:
                got[c] = cap[c]
                left -= cap[c]
            open_ -= full
        return {k: v for c in children for k, v in share(c, got[c]).items()}

    out = []
    for leaf, budget in share((), total).items():
        own, at = sum(r[4] for r in leaves[leaf]), 0
        for e in range(epochs):
            if e * own > int(budget + 1e-6):
                break
            for r in sorted(leaves[leaf], key=lambda r: (hashlib.md5(f"{seed}-{e}-{r[0]}".encode()).hexdigest(), r[0])):
                if at + r[4] <= int(budget + 1e-6):
                    out.append((r[0], e, at))
                at += r[4]
    return sorted(out)


def test_mix_matches_the_plain_rule(spark):
    docs = cases.edge_documents(spark).dropDuplicates(["doc_id"]).where("doc_id IS NOT NULL")
    name = lambda x: x or ""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = [(r.doc_id, "d" + str(r.doc_id % 2), name(r.lang), name(r.source), words(r.text)) for r in docs.collect()]
    domain = F.concat(F.lit("d"), (F.col("doc_id") % 2).cast("string"))
    for weights, fraction, epochs in (({}, 0.5, 1), ({"d0": 5.0, "d0/en": 3.0, "d1/de/src0": 0.1}, 0.8, 3), ({"d1": 9.0}, 2.5, 3)):
        got = mixing.mix(docs, domain, weights, fraction, epochs, seed=4)
        assert sorted((r.doc_id, r.epoch, r.position) for r in got.collect()) == brute_mix(rows, weights, fraction, epochs, 4)


def test_mix_of_edge_cases(spark):
    docs = cases.edge_documents(spark, n=5)
    assert mixing.mix(docs, F.lit("d"), fraction=1.0).count() > 0
    assert mixing.mix(docs.where("doc_id < 0"), F.lit("d")).collect() == []
    whole = mixing.selected(docs, F.lit("d"), fraction=1.0)
    assert whole.schema.names == docs.schema.names and whole.count() == docs.count()


def test_query_of_the_shards(spark, tmp_path):
    cases.edge_documents(spark, n=5).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_histogram_sharding(spark, str(tmp_path)).collect()
    import zlib

    texts = [r.text or "" for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len(t.encode()) + 16, zlib.crc32(t.encode())) for t in texts)
    assert all(r.grown_shard is None for r in got)


def test_mix_of_weights_and_fractions_of_zero_or_less(spark):
    docs = cases.documents(spark, [(i, "one two three", "en", f"src{i % 3}") for i in range(60)] + [(100, ""), (101, None)])
    domain = F.lit("d")
    got = mixing.mix(docs, domain, {"d/en/src0": 0.0, "d/en/src1": -1.0}, fraction=0.3, max_epochs=1, seed=1)
    tokens = {r.source: r.n for r in got.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    assert not tokens.get("src0") and not tokens.get("src1") and tokens["src2"] == 54  # 0.3 * 180
    for fraction in (0.0, -1.0):
        assert not mixing.mix(docs, domain, {}, fraction=fraction).agg(F.sum("tokens")).first()[0]


def test_shards_of_null_ids_and_clashing_columns(spark):
    rows = [(None, "a b c"), (None, "a b c"), (None, None), (3, None), (3, "")] + [(i, f"text {i}") for i in range(10, 40)]
    docs = cases.documents(spark, rows).withColumn("__high", F.lit(1)).withColumn("__key", F.lit("x"))
    got = sharding.shard(docs, 4)
    assert got.count() == len(rows) and set(got.columns) == {*docs.columns, "shard", "slot", "law"} and got.where("__key = 'x' AND __high = 1").count() == len(rows)
    by = {}
    for r in got.select("shard", "slot").collect():
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
