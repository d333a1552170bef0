import itertools
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.llm import cases
from tidewright.llm import graph, neardup


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, width))
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        for p, q in itertools.product(sets[a], sets[b]):
            if p and q and 100 * len(p & q) >= percent * len(p | q):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in sets}


def test_components_match_brute_force(spark):
    for width, percent in ((3, 85), (5, 80)):
        docs = cases.edge_documents(spark, seed=width)
        own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = neardup.near_duplicates(docs, width, percent).collect()
        assert len(got) == len(own)
        want = brute([r for r in own if r[0] is not None], width, percent)
        for r in got:
            if r.doc_id is not None:
                assert r.component_id == want[r.doc_id], r
                assert r.kept == (r.doc_id == r.component_id)
        number = {i: len(shingles(t, width)) for i, t in own}
        assert all(r.n_shingles == number[r.doc_id] for r in got)


def test_large_group_of_near_copies_is_split_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "PAIRED", 2)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*words[:i], f"new{i}", *words[i + 1 :]])) for i in range(60)]
    got = neardup.near_duplicates(cases.documents(spark, rows), 3, 85).collect()
    assert {r.component_id for r in got} == {0}


def test_one_document_of_each_group_stays(spark):
    docs = cases.edge_documents(spark)
    got = neardup.deduplicated(docs)
    assert got.schema.names == docs.schema.names
    kept = [r.doc_id for r in got.collect()]
    labels = neardup.near_duplicates(docs).where("kept").select("doc_id").distinct().collect()
    assert sorted(i for i in kept if i is not None) == sorted(r.doc_id for r in labels)
    assert kept.count(None) == 1


def test_empty_table(spark):
    empty = cases.documents(spark, [(1, "a")]).where("doc_id < 0")
    assert neardup.near_duplicates(empty).collect() == []
    assert neardup.deduplicated(empty).collect() == []


def test_odd_sketch_estimates_high_similarities():
    rng = np.random.default_rng(0)
    for same in (0.8, 0.9, 0.97):
        estimates = []
        for _ in range(30):
            n = 4000
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            keep = int(2 * same * n / (1 + same))
            b = np.concatenate([a[:keep], rng.integers(0, 2**63, n - keep, dtype=np.uint64)])
            maps = neardup.odd_sketch(neardup.minhash([a, b]))
            differing = np.bitwise_count(maps[0] ^ maps[1]).sum()
            estimates.append(float(neardup.estimate(np.array([differing]))[0]))
        assert abs(np.mean(estimates) - same) < 0.02


def test_graph_components(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 360)] + [(500, k) for k in range(501, 540)] + [(7, 7)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[start] == min(seen)


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_differ_by_structure_only_are_different(spark):
    rows = [(2 * n + k, thue_morse(n, *pair)) for n in (1024, 2048, 4096) for k, pair in enumerate(("ab", "ba"))]
    docs = cases.documents(spark, rows + [(1, rows[0][1])])
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert got == {i: i for i, _ in rows} | {1: 1, 2048: 1}


@pytest.mark.parametrize("paired", [1, 20])
def test_parts_of_a_large_group_that_stay_apart(spark, monkeypatch, paired):
    """Members of one group (the caller's) whose links chain across blocks, and some that link with none."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "PAIRED", paired)
    words = [f"w{i}" for i in range(60)]
    chain = [(i, " ".join([*words[i:], *[f"x{k}" for k in range(i)]])) for i in range(0, 40)]
    other = [(100 + i, " ".join(f"y{i}-{k}" for k in range(50))) for i in range(5)]
    docs = cases.documents(spark, chain + other)
    feats = neardup.features(docs, 1).select("doc_id", "sketch")
    sketches = feats.withColumnRenamed("doc_id", "id").cache()
    clusters = sketches.select("id").selectExpr("id", "0L AS component")
    links = neardup.confirmed_links(docs, clusters, 1, 85, sketches)
    got = {r.id: r.component for r in graph.components(links).collect()}
    want = brute(chain + other, 1, 85)
    assert {i: got.get(i, i) for i in want} == want


def test_members_of_alike_groups_are_sent_a_few_times(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 64)
    sent = []
    own = neardup.compared

    def counted(placed, *rest):
        placed = placed.cache()
        sent.append(placed.count())
        return own(placed, *rest)

    monkeypatch.setattr(neardup, "compared", counted)
    n = 20_000
    base = neardup.odd_sketch(neardup.minhash([np.arange(1, 400, dtype=np.uint64) << np.uint64(40)]))[0].tobytes()
    ids = spark.range(n).select("id")
    members = ids.selectExpr("7L AS grp", "id")
    links = neardup.group_links(members, lambda df: df.selectExpr("*", f"X'{base.hex()}' AS sketch"), 0.85)
    assert graph.components(links).selectExpr("count(*)", "max(component)").first() == (n, 0)
    assert sum(sent) < 1.1 * n


def test_hubs_are_not_dealt_to_one_partition(spark):
    """Stars, a hub that is the largest id of its edges, and a chain: with hubs split the components are the same."""
    edges = [(0, i) for i in range(1, 60)] + [(i, 500) for i in range(100, 160)] + [(i, 1000 - i) for i in range(200, 240)] + [(i, i + 1) for i in range(600, 640)]
    edges += [(7, 130), (500, 500), (0, 1), (0, 1)]
    df = spark.createDataFrame(edges, "a long, b long")
    whole = sorted(map(tuple, graph.components(df).collect()))
    assert sorted(map(tuple, graph.components(df, hub=10).collect())) == whole
    assert {i: c for i, c in whole}[159] == 0 and {i: c for i, c in whole}[640] == 600
    pairs = graph.with_smallest(spark.createDataFrame(edges[:59], "u long, v long"), 59, 10)
    assert sorted(map(tuple, pairs.collect())) == sorted((a, b, 0) for a, b in edges[:59])
