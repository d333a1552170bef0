"""SentencePiece by distinct marked words, and fill-in-middle, against the library and plain rules."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidewright.llm import infill, pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "a", "a ", " a", " a  b ", "▁", "▁▁a", "a▁b", "a ▁ b▁", "x\n y\t z", "<s> </s>", "<0x41>", "\x00b", "漢字 🦙", "a\xa0b　c", "ﬁ Ａ", "\r\n\r\n", "é é", "a" * 3000, "🦙" * 50]


def odd_texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    return [t or "" for t in cases.texts(seed, 12)] + ODD + ["".join(rng.choice(" \n\t▁ab'1é.漢🦙<S>") for _ in range(rng.randint(0, 60))) for _ in range(800)]


def test_words_equal_the_library():
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=MODEL)
    own = pieces.Segmenter(MODEL)
    assert own.apart
    texts = odd_texts(3)
    for _ in range(2):  # the second time from the table
        for t, ids in zip(texts, own.encode(pa.array(texts)), strict=True):
            assert ids.tolist() == library.encode(t), repr(t)


def test_table_of_words_is_bounded():
    own = pieces.Segmenter(MODEL)
    own.KEEP = 50
    texts = odd_texts(4)
    want = [x.tolist() for x in pieces.Segmenter(MODEL).encode(pa.array(texts))]
    for at in range(0, len(texts), 40):
        assert [x.tolist() for x in own.encode(pa.array(texts[at : at + 40]))] == want[at : at + 40]
    assert max(map(len, own.young)) <= own.SHORT


def message(*parts: tuple[int, int | bytes]) -> bytes:
    out = b""
    for field, value in parts:
        if isinstance(value, int):
            out += bytes([field << 3, value]) if field < 16 else bytes([(field << 3 & 127) | 128, field >> 4, value])
        else:
            out += bytes([field << 3 | 2, len(value)]) + value
    return out


def test_models_whose_words_are_not_apart():
    def model(texts, kind=1, bpe=2, trim=0, chars=b""):
        rows = [(1, message((1, t.encode()), (3, kind))) for t in texts]
        return message(*rows, (2, message((3, bpe))), (3, message((2, chars), (3, 1), (4, trim), (5, 1))))

    assert pieces.words_apart(model(["▁", "▁a", "▁▁", "b"]))
    assert not pieces.words_apart(model(["▁", "a▁b"]))  # a piece over the start of a marker
    assert not pieces.words_apart(model(["▁a"]))  # no piece for a lone marker
    assert not pieces.words_apart(model(["▁", "a"], kind=4))  # symbols of the user's
    assert not pieces.words_apart(model(["▁", "a"], bpe=1))  # no BPE
    assert not pieces.words_apart(model(["▁", "a"], trim=1)) and not pieces.words_apart(model(["▁", "a"], chars=b"x"))


def test_other_models_take_texts_whole():
    own = pieces.Segmenter(MODEL)
    own.apart = False
    assert [x.tolist() for x in own.encode(pa.array(["a b", None]))] == [own.model.encode("a b"), []]


def test_encode_and_decode_of_tables(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=MODEL)
    docs = cases.edge_documents(spark)
    both = pieces.decode(pieces.encode(docs, MODEL), MODEL).withColumn("n", pieces.n_ids(F.col("ids")))
    found = sorted((str(r.doc_id), r.n, bytes(r.ids), r.text) for r in both.collect())
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((str(r.doc_id), len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids)))
    assert found == sorted(want)
    assert pieces.encode(docs.where("false"), MODEL).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), MODEL).first().text is None
    bare = pieces.encode(docs.where("doc_id = 2"), MODEL, begin=False, end=False).first()
    assert bytes(bare.ids) == b""


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_infill(text: str, doc_id, percent=50, spm=80) -> tuple:
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_the_plain_rule():
    for i, t in enumerate(odd_texts(5) + ["<P", "S>x <S", "\x1c \x85   a", "\x0b\x0c"]):
        assert infill.rearranged(t, i, 42, 100, 50, infill.MARKS) == plain_infill(t, i, 100, 50), repr(t)
        assert infill.unit_ends(t) == sum(1 << (m.end() - 1) for m in UNIT.finditer(t))


def test_ranked_bits():
    rng = random.Random(1)
    for width in (1, 2, 3, 64, 65, 1000):
        mask = rng.getrandbits(width) | 1
        places = [i for i in range(width) if mask >> i & 1]
        assert [infill.ranked_bit(mask, r + 1, width) for r in range(len(places))] == places


def test_infill_of_tables(spark):
    texts = odd_texts(6)[:300] + ["<P> x", "a<S>", "<<M>", "<S <P x y < z"]
    docs = cases.documents(spark, [(i, t) for i, t in enumerate(texts)] + [(None, "one two three"), (7, None)])
    made = infill.transform(docs, percent=90, spm_percent=50).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    rows = made.collect()
    assert sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output) for r in rows) == sorted(
        (str(r.doc_id), x[0], x[1], str(x[2]), str(x[3]), x[4]) for r in docs.collect() for x in [plain_infill(r.text or "", r.doc_id, 90, 50)]
    )
    assert sorted((str(r.doc_id), r.back) for r in rows) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert infill.transform(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        infill.transform(docs, marks=("<P>", "<P>", "<M>"))
