import random

from tests.llm import cases
from tests.llm.test_neardup import brute as near_groups
import corpus_pipeline
from tidewright.llm import decontaminate, queries


def write_tables(spark, tmp_path):
    rng = random.Random(12)
    bench = [(k, cases.sentence(rng, 30)) for k in range(6)]
    rows = []
    for i in range(120):
        text = "\n".join(cases.sentence(rng, 15) for _ in range(6))
        if i % 10 == 0:
            text += "\n" + bench[i // 10 % 6][1]
        rows.append((i, text, ["en", "de", None][i % 3], f"src{i % 5}"))
    rows += [(500 + i, rows[i][1] + " end", "en", "src1") for i in range(1, 40, 4)]  # near copies
    rows += [(600, None), (601, ""), (602, "too short"), (603, rows[1][1])]
    cases.documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, bench


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    rows, bench = write_tables(spark, tmp_path)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    seg = decontaminate.segments(bench)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        path = str(tmp_path / f"stage{k}")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r.text for r in docs.collect()}
        if name != "shard":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality":
            assert set(before) - set(after) == {600, 601, 602}
        if name == "near_dedup":
            groups = near_groups(list(before.items()), 5, 80)
            assert set(after) == {i for i, g in groups.items() if i == g}
        if name == "decontaminate":
            hit = {list(before)[i] for i, _ in decontaminate.found_in(list(before.values()), seg)}
            assert hit and set(before) - set(after) == hit
        if name == "mix":
            words = lambda d: sum(len(t.split()) for t in d.values())
            assert set(after) < set(before) and 0.8 * words(before) < words(after) <= 0.9 * words(before)
        if name == "shard":
            assert after == before
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in whole) == sorted((r.doc_id, r.shard, r.slot) for r in docs.collect())


def test_every_operator_has_one_query():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)
