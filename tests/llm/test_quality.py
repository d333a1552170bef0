import random
import re
from collections import Counter, defaultdict

from tests.llm import cases
from tidewright.llm import quality

BLANK = r"[\x20\x09-\x0D]+"


def split(text):
    return [w for w in re.split(BLANK, text) if w]


def normal(line):
    return " ".join(split("".join(c.lower() if "A" <= c <= "Z" else c for c in line)))


def measures(text):
    text = text or ""
    words = split(text)
    lines = [x for x in text.split("\n") if split(x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def brute(rows, max_docs, percent=0, copies_once=False):
    """(doc_id, text, host) -> measures, failed, kept."""
    host_docs, line_docs = defaultdict(set), defaultdict(set)
    for i, text, host in rows:
        document = text or "" if copies_once or i is None else i
        host_docs[host].add(document)
        for line in (text or "").split("\n"):
            if split(line):
                line_docs[host, normal(line)].add(document)
    frequent = {k for k, v in line_docs.items() if len(v) > max_docs and 100 * len(v) > percent * len(host_docs[k[0]])}
    out = []
    for i, text, host in rows:
        own = measures(text)
        removed = sum(len(split(x)) for x in (text or "").split("\n") if split(x) and (host, normal(x)) in frequent)
        failed = own[0] < 50 or 100 * own[4] > 50 * own[0]
        out.append((i, *own, removed, failed, not failed and 100 * removed <= 70 * own[0]))
    return out


def fixture():
    rng = random.Random(8)
    rows = [(i, t, "en", ["src0", None, "src1"][i % 3]) for i, t in enumerate(cases.texts(5, 20))]
    shared = [cases.sentence(rng, 12) for _ in range(20)]
    common = "Subscribe to our NEWS letter\ttoday"
    for i in range(100, 150):
        body = "\n".join(cases.sentence(rng, 12) for _ in range(rng.randint(3, 7)))
        line = common if i % 2 else common.upper() + "  "
        filler = (line + "\n") * (60 if i % 7 == 0 else 2) if i % 3 else ""
        if i % 2:
            filler += "\n".join(shared[: 20 if i % 5 else 2]) + "\n"
        rows.append((i, filler + body, "en", "src0"))
    rows += [(200, "a b c " * 40, "en", "src0"), (201, "# * $ % & | < >\n" * 3 + cases.sentence(rng, 60), "en", "src0")]
    copy = "\n".join(cases.sentence(rng, 12) for _ in range(6))
    rows += [(300 + i, copy, "en", "src1") for i in range(12)]  # copies make their lines frequent
    return rows + [rows[3], rows[40], rows[40], (None, cases.sentence(rng, 60), "en", "src0")]


def test_verdicts_match_brute_force(spark):
    rows = fixture()
    docs = cases.documents(spark, rows)
    for percent, once in ((0, False), (10, True), (0, True)):
        got = quality.judged(docs, max_line_docs=10, min_line_percent=percent, copies_once=once)
        got = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept").collect()
        want = brute([(i, t, s or "") for i, t, _, s in rows], 10, percent, once)
        key = lambda r: (r[0] is None, r[0] or 0)
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
        assert any(r[6] for r in want) and any(not r[7] and not r[8] for r in want)
        assert all(r[8] == once for r in want if r[0] in range(300, 312))


def test_clean_removes_lines_and_depleted_documents(spark):
    rows = fixture()
    docs = cases.documents(spark, rows)
    got = quality.clean(docs, max_line_docs=10)
    assert got.schema.names == docs.schema.names
    out = got.collect()
    want = {i: k for i, *_, k in brute([(i, t, s or "") for i, t, _, s in rows], 10)}
    assert {r.doc_id for r in out if r.doc_id is not None} == {i for i, k in want.items() if k and i is not None}
    assert all("subscribe to our" not in r.text.lower() for r in out if r.source == "src0")
    assert all(r.n_chars == len(r.text) for r in out)


def test_rows_without_an_id_are_judged_and_kept_as_others(spark):
    rng = random.Random(9)
    line = "subscribe to our news letter today"
    rows = [(i, line + "\n" + cases.sentence(rng, 60), "en", "src0") for i in range(30)]
    alone, part, full = cases.sentence(rng, 60), line + "\n" + cases.sentence(rng, 60), (line + "\n") * 3 + "\n".join(f"{line}\n{cases.sentence(rng, 2)}" for _ in range(30))
    rows += [(None, t, "en", "src0") for t in (alone, part, full, part)]
    docs = cases.documents(spark, rows)
    got = quality.judged(docs, max_repeat_percent=100).where("doc_id IS NULL").select("n_words", "removed_words", "kept").collect()
    assert sorted(map(tuple, got)) == sorted([(60, 0, True), (66, 6, True), (66, 6, True), (258, 198, False)])
    out = quality.clean(docs, max_repeat_percent=100)
    assert out.count() == 33
    rest = part.split("\n")[1]
    assert sorted(r.text for r in out.where("doc_id IS NULL").collect()) == sorted([alone, rest, rest])


def test_empty_table(spark):
    empty = cases.documents(spark, [(1, "a")]).where("doc_id < 0")
    assert quality.judged(empty).collect() == [] and quality.clean(empty).collect() == []
