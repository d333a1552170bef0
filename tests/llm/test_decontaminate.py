import random

import numpy as np

from tests.llm import cases
from tidewright.llm import decontaminate as dc


def edits_within(pattern, text):
    """Least edits of the pattern against any part of the text, by the plain recurrence."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = np.array(new)
    return int(row.min())


def brute(items, text):
    seg, plain = dc.segments(items), dc.normal(text or "")
    out = {}
    for k in range(len(seg.text)):
        e = edits_within("".join(map(chr, seg.text[k])), plain)
        if e <= seg.edits[k]:
            item = int(seg.item[k])
            out[item] = min(e, out.get(item, e))
    for item, passage in items:
        if 0 < len(dc.normal(passage)) < dc.Q and f" {dc.normal(passage)} " in f" {plain} ":
            out[item] = 0
    return out


def mutate(rng, text, k):
    chars = list(text)
    for _ in range(k):
        p = rng.randrange(len(chars))
        chars[p : p + 1] = rng.choice([["q"], [], [chars[p], "z"]])
    return "".join(chars)


def fixture(seed=3):
    rng = random.Random(seed)
    items = [(1, cases.sentence(rng, 12)), (2, cases.sentence(rng, 40)), (3, cases.sentence(rng, 25)), (4, "short passage"), (5, "tiny"), (6, "a c"), (7, "a somewhat longer one")]
    texts = [None, "", "tiny", "a short passage here", "a short pasage here", "Tiny,", "tiny  A\nC.", "so A\tc", "a somewhat langer one", "a smewhat langer one", items[0][1], items[0][1].upper().replace(" ", "  \n")]
    for k in range(0, 10):
        for item, p in items[:3]:
            texts.append(cases.sentence(rng, 15) + " " + mutate(rng, p, k) + " " + cases.sentence(rng, 9))
    texts += [items[1][1][50:190], cases.sentence(rng, 300), "aaaa" * 500, items[2][1] * 3]
    return items, texts


def test_matches_equal_brute_force(spark):
    items, texts = fixture()
    docs = cases.documents(spark, list(enumerate(texts)))
    benchmark = spark.createDataFrame([*items, (None, "x" * 90), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in dc.contaminated(docs, benchmark).collect()}
    want = {(i, item): e for i, t in enumerate(texts) for item, e in brute(items, t).items()}
    assert got == want
    assert any(e > 0 for e in want.values())


def test_spans_name_the_passage(spark):
    items, _ = fixture()
    text = "Before  it,\n" + items[0][1].title() + " \t after."
    got = dc.contaminated(cases.documents(spark, [(1, text)]), spark.createDataFrame(items[:1], "item_id long, text string")).collect()
    assert [dc.normal(text[r.start : r.end]) for r in got] == [dc.normal(items[0][1])]


def test_blocks_of_a_large_benchmark_find_the_same(spark, monkeypatch):
    items, texts = fixture(5)
    docs, benchmark = cases.documents(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, dc.contaminated(docs, benchmark).collect()))
    rows = dc.blocks(benchmark, 100)
    assert len(list(rows)) > 3
    monkeypatch.setattr(dc.blocks, "__defaults__", (100,))
    assert sorted(map(tuple, dc.contaminated(docs, benchmark).collect())) == whole


def test_parts_of_long_texts_find_the_same(monkeypatch):
    items, texts = fixture(6)
    seg = dc.segments(items)
    long = [" ".join(t for t in texts if t) * 2]
    want = list(dc.found_in(long, seg))
    monkeypatch.setattr(dc, "PLACES", 300)
    monkeypatch.setattr(dc, "PAIRS", 50)
    monkeypatch.setattr(dc, "ALIGNED", 3)
    assert list(dc.found_in(long, seg)) == want


def test_clean_keeps_all_columns_and_the_other_rows(spark):
    items, texts = fixture()
    docs, benchmark = cases.documents(spark, [*enumerate(texts), (None, items[0][1])]), spark.createDataFrame(items, "item_id long, text string")
    bad = {r.doc_id for r in dc.contaminated(docs, benchmark).collect()}
    got = dc.clean(docs, benchmark)
    assert got.schema.names == docs.schema.names
    assert sorted(r.doc_id for r in got.collect()) == [i for i in range(len(texts)) if i not in bad]


def test_empty_tables(spark):
    items, texts = fixture()
    docs, benchmark = cases.documents(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string")
    none = benchmark.where("item_id < 0")
    assert dc.contaminated(docs.where("doc_id < 0"), benchmark).collect() == []
    assert dc.contaminated(docs, none).collect() == []
    assert dc.clean(docs, none).count() == len(texts)
