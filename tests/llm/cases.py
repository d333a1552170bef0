"""Documents for the tests: ordinary ones and edge cases, with extra columns whose names operators also use."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, size long, n long, key string, cluster int, shard string, slot int, law int, words int, "
    "lines int, host int, tokens int, domain int, epoch int, position int, component int, kept int, score int, bands int, text_hash int, removed int, item_id int, label int, piece int, base int"
)
VOCABULARY = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "so", "ti", "vu") for b in ("ran", "del", "mos", "pix", "tor", "wen", "zul", "ha", "be", "o")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def texts(seed: int = 1, n: int = 40) -> list[str | None]:
    """Edge cases first: null, empty, blanks, one word, a tie, a long text; then texts with exact and near copies."""
    rng = random.Random(seed)
    out: list[str | None] = [None, "", " \n\t ", "word", "two words", "two words", "Ünï çödé 漢字 text x", sentence(rng, 20000), "x" * 50000]
    for _ in range(n):
        base = sentence(rng, rng.randint(30, 120))
        out.append(base)
        if rng.random() < 0.4:
            out.append(base)
        if rng.random() < 0.5:
            words = base.split()
            words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
    return out


def row(doc_id, text, lang="en", source="src0") -> tuple:
    return (doc_id, text, lang, source, len(text or ""), *[None] * 3, "k", 1, "a", *[2] * (len(SCHEMA.split(",")) - 11))


def documents(spark, rows: list[tuple]):
    """A table of (doc_id, text[, lang, source])."""
    full = [row(*r) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def edge_documents(spark, seed: int = 1, n: int = 40):
    own = [(i + 1, t, ["en", None, "de", ""][i % 4], ["src0", "src1", None][i % 3]) for i, t in enumerate(texts(seed, n))]
    own += [own[3], own[12], own[12]]  # repeated rows
    own += [(None, "a text without an id that is long enough to be judged", "en", "src0")]
    return documents(spark, own)
