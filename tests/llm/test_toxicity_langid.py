import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidewright.llm import langid, textprep, toxicity


def toxic_rows(n=400, seed=2):
    """Insult and group mention are toxic only together; each alone is in clean texts as well."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        insult, group = i % 4 in (0, 1), i % 4 in (0, 2)
        words = cases.sentence(rng, 30).split() + ["moron"] * insult + ["martians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_pairs_are_learnt(spark):
    rows = toxic_rows()
    docs = cases.documents(spark, [r[:2] for r in rows])
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels, F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    assert np.mean([(got[i] >= 0.7) == bool(t) for i, _, t in held]) > 0.95


@pytest.mark.parametrize("rule", ["both or neither", "one of two"])
def test_pairs_without_single_effects_are_learnt(rule):
    """Each word is as frequent among toxic texts as among clean ones; only both together tell them apart."""
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(1200):
        a, b = i % 4 in (0, 1), i % 4 in (0, 2)
        words = cases.sentence(rng, 30).split() + ["moron"] * a + ["martians"] * b
        rows.append(np.array(sorted(toxicity.terms_of(" ".join(words)))))
        labels.append(int((a == b) == (rule == "both or neither")))
    y = np.array(labels)
    machine = toxicity.fit(rows[:800], y[:800])
    found = machine.score(toxicity.matrix(rows[800:], machine.kept)) >= 0.5
    assert np.mean(found == y[800:]) > 0.95
    # nothing to find: no pair stands out
    noise = np.array([rng.random() < 0.5 for _ in rows], int)
    assert len(toxicity.fit(rows, noise).kept) <= 4


def test_scores_of_edge_cases(spark):
    docs = cases.edge_documents(spark, n=5)
    machine = toxicity.fit([np.array(sorted(toxicity.terms_of(t))) for t in ("good day", "bad day")] * 20, np.array([0, 1] * 20))
    got = toxicity.score(docs, machine).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs.where("doc_id < 0"), machine).collect() == []


def test_without_labels_nothing_is_toxic(spark):
    docs = cases.edge_documents(spark, n=2)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    machine = toxicity.train(docs, labels, F.lit(True))
    assert all(r.score < 0.01 for r in toxicity.score(docs, machine).collect())
    one = toxicity.train(docs, spark.createDataFrame([(4, 1), (None, 1), (5, None)], "doc_id long, toxic int"), F.lit(True))
    assert all(r.score < 0.01 for r in toxicity.score(docs, one).collect())


def language_rows(n=240, seed=3):
    rng = random.Random(seed)
    parts = {"aa": ["tha", "ing", "wer", "sho"], "bb": ["ción", "ado", "llo", "ñez"], "cc": ["ßen", "sch", "keit", "ung"]}
    return [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60))), lang) for i in range(n) for lang in [["aa", "bb", "cc"][i % 3]]]


def test_languages_of_held_out_texts(spark):
    rows = language_rows()
    docs = cases.documents(spark, rows)
    net = langid.train(docs, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in langid.predict(docs, net).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if i % 4 == 2]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_edge_cases(spark):
    net = langid.train(cases.documents(spark, language_rows(60)), F.lit(True))
    docs = cases.documents(spark, [(1, None), (2, ""), (3, " 123 ..."), (6, "½ ² Ⅷ ①"), (7, "½ é"), (4, "thaing"), (5, "sch" * 40000), (None, "ción")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, net).collect()}
    assert got[1] == got[2] == got[3] == got[6] == ("und", 0.0) and got[7][0] != "und"
    assert all(got[i][0] in ("aa", "bb", "cc") for i in (4, 5, None))
    assert langid.predict(docs.where("doc_id < 0"), net).collect() == []
    none = langid.train(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert none is None and {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    net = langid.new_network(["a", "b"])
    for p in net.parameters:
        p[:] = p.astype(np.float32)
    x, y, w = rng.integers(0, 256, (7, 5)), np.array([0, 1, 0, 1, 1]), np.ones(5, np.float32)
    _, grads = langid.gradients(net, x, y, w)
    for p, g in zip(net.parameters, grads):
        flat = p.reshape(-1)
        for i in np.argsort(-np.abs(g.reshape(-1)))[:4]:
            old, step = flat[i], 1e-2
            flat[i] = old + step
            up = langid.gradients(net, x, y, w)[0]
            flat[i] = old - step
            down = langid.gradients(net, x, y, w)[0]
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(float(g.reshape(-1)[i]), rel=0.1, abs=2e-3)


def test_windows_cover_every_byte():
    texts = pa.array(["", "x" * 64, "y" * 65, None, "zé" * 100])
    data, offsets = textprep.raw(texts)
    windows, of = langid.cut(data, offsets)
    back = [windows[of == i].tobytes().rstrip(b"\0") for i in range(5)]
    assert back == [b"", b"x" * 64, b"y" * 65, b"", ("zé" * 100).encode()]


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(5)
    m = toxicity.Machine({3: 0, 8: 1, 11: 2, 40: 3}, -0.3, rng.normal(0, 1, 4).astype(np.float32), rng.normal(0, 1, (4, toxicity.FACTORS)).astype(np.float32))
    x = rng.integers(0, 2, (30, 4)).astype(np.float32)
    for row, got in zip(x, m.score(x)):
        on = [i for i in range(4) if row[i]]
        total = float(m.w0) + sum(float(m.w[i]) for i in on) + sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(on) for j in on[k + 1 :])
        assert got == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-4)


def test_network_equals_a_plain_loop():
    net = langid.new_network(["a", "b", "c"], seed=7)
    texts = pa.array(["zwölf Boxkämpfer", None, "1 2 3", "abc" * 50])
    data, offsets = textprep.raw(texts)
    got = langid.pooled(net, data, offsets)
    k = langid.UNITS
    for n, text in enumerate(texts.to_pylist()):
        raw = (text or "").encode()
        total, letters = np.zeros(3), 0
        for at in range(0, len(raw), langid.STEPS):
            window = raw[at : at + langid.STEPS].ljust(langid.STEPS, b"\0")
            states = []
            for way in (0, 1):
                h, own = np.zeros(k), []
                for c in window if way == 0 else reversed(window):
                    e, u = net.e[way][:, c], net.u[way]
                    z, r = np.clip(e[:k] + u[:k] @ h, 0, 1), np.clip(e[k : 2 * k] + u[k : 2 * k] @ h, 0, 1)
                    h = z * h + (1 - z) * np.tanh(e[2 * k :] + r * (u[2 * k :] @ h))
                    own.append(h)
                states.append(own if way == 0 else own[::-1])
            for c, f, b in zip(window, *states):
                if chr(c).isascii() and chr(c).isalpha() or c >= 0x80:
                    p = np.exp(net.o @ np.concatenate([f, b]) + net.b)
                    total, letters = total + p / p.sum(), letters + 1
        assert got[n] == pytest.approx(total / max(letters, 1), abs=1e-4)


def test_rare_languages_are_sampled_too(spark):
    rows = language_rows(240) + [(1000 + i, "zzyx qqox " * 20, "rare") for i in range(3)]
    net = langid.train(cases.documents(spark, rows), F.lit(True), sample=40, most=300)
    assert net.languages == ["aa", "bb", "cc", "rare"]
