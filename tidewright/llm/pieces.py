"""SentencePiece ids of whole texts by a table of their distinct marked words, and texts from ids.

A SentencePiece model writes a marker for each space and one before the text.
If no piece of a BPE model has a marker after another character, no merge
reaches over the start of a marker run, so a text falls into marked words that
are segmented alone. The different ones of many texts are segmented once, by
the library, and their ids are joined back by position.

The table of words belongs to a task, not to the cluster: one of all tasks
would need a shuffle of words that costs more than segmenting a word again in
another task, and grows with the corpus.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import textprep
from tidewright.session import ship_package

MARKER = "▁"
# Fields and kinds of a model file (protocol buffer wire format).
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_KIND, MODEL_KIND, SUFFIX_MARKERS = 1, 3, 3, 24
CHARACTER_MAP, DUMMY_PREFIX, TRIM_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
NORMAL, USER_DEFINED, UNUSED, BPE = 1, 4, 5, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: whole numbers, or the bytes of everything else."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, data[at : at + size]
            at += size


def words_apart(model: bytes) -> bool:
    """Whether marked words of this model are segmented alone: BPE with one marker before the text, spaces kept and nothing else normalised, no symbols of the user's, and no piece with a marker after another character."""
    trainer = {MODEL_KIND: 1, SUFFIX_MARKERS: 0}
    normalizer = {CHARACTER_MAP: b"", DUMMY_PREFIX: 1, TRIM_SPACES: 1, ESCAPE_SPACES: 1}
    markers = False
    for field, value in fields(model):
        if field == TRAINER:
            trainer |= dict(fields(value))
        elif field == NORMALIZER:
            normalizer |= dict(fields(value))
        elif field == PIECES:
            piece = {PIECE_KIND: NORMAL} | dict(fields(value))
            text = piece[PIECE_TEXT].decode()
            if piece[PIECE_KIND] in (USER_DEFINED, UNUSED) or MARKER in text.lstrip(MARKER):
                return False
            markers |= text == MARKER and piece[PIECE_KIND] == NORMAL
    rules = {k: normalizer[k] for k in (CHARACTER_MAP, DUMMY_PREFIX, TRIM_SPACES, ESCAPE_SPACES)}
    plain = rules == {CHARACTER_MAP: b"", DUMMY_PREFIX: 1, TRIM_SPACES: 0, ESCAPE_SPACES: 1}
    return plain and markers and trainer[MODEL_KIND] == BPE and not trainer[SUFFIX_MARKERS]


def marked_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the marked words of texts, each without its first marker, and the first word of each text (one more at the end).

    A word begins with a text or where a marker (a space, or the marker itself)
    follows another character. The marker before a text is the model's own, so
    the first word of a text begins with the text.
    """
    n = len(data)
    space = data == 0x20
    begins, ends, width = space.copy(), space.copy(), np.ones(n, np.int64)
    if n > 2:
        # The UTF-8 bytes of the marker
        full = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        begins[full], ends[full + 2], width[full] = True, True, 3
    begins[1:] &= ~ends[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first], width[first] = True, 0
    own = np.flatnonzero(begins)
    # a word ends where the next begins, with its marker; no text ends within a word, as each begins one
    return own + width[own], np.append(own[1:], n), np.searchsorted(own, offsets)


class Segmenter:
    """Ids of whole texts by a SentencePiece model, with a table of the words that it has segmented."""

    #: Words of each of two generations of the table, and the bytes of a word and of its ids that are kept; what is used again moves to the younger.
    KEEP, SHORT = 150_000, 256

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            self.apart = words_apart(f.read())
        self.lone = np.array([self.model.piece_to_id(MARKER)], "<u4").tobytes()  # a marker with nothing after it
        self.young: dict[bytes, bytes] = {b"": self.lone}
        self.old: dict[bytes, bytes] = {}

    def _segment(self, texts: list[str]) -> list[bytes]:
        ids = self.model.encode(texts, num_threads=1)
        bounds = np.cumsum([0, *map(len, ids)]) * 4
        flat = np.fromiter(chain.from_iterable(ids), "<u4", bounds[-1] // 4).tobytes()
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words: from the table, the missing ones by the library."""
        if len(self.young) > self.KEEP:
            self.young, self.old = {b"": self.lone}, self.young
        out = [self.young.get(w) for w in words]
        missing = []
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = ids = self.old.get(words[i])
                if ids is None:
                    missing.append(i)
                else:
                    self.young[words[i]] = ids
        for i, ids in zip(missing, self._segment([words[i].decode() for i in missing]) if missing else ()):
            out[i] = ids
            if len(words[i]) <= self.SHORT:
                self.young[words[i]] = ids
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, without begin and end."""
        if not self.apart:
            return [np.frombuffer(b, "<u4") for b in self._segment(texts.fill_null("").to_pylist())]
        data, offsets = textprep.raw(texts)
        if not len(data):
            return [np.zeros(0, "<u4") for _ in range(len(texts))]
        starts, ends, first = marked_words(data, offsets)
        where, inverse = textprep.distinct_runs(data, starts, ends)
        raw = data.tobytes()
        own = self._words([raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())])
        count = np.array([len(b) for b in own], np.int64) // 4
        each, begin = count[inverse], (np.cumsum(count) - count)[inverse]
        bounds = np.concatenate(([0], np.cumsum(each)))
        flat = np.frombuffer(b"".join(own), "<u4")[np.repeat(begin - bounds[:-1], each) + np.arange(bounds[-1])]
        return [flat[a:b] for a, b in zip(bounds[first[:-1]].tolist(), bounds[first[1:]].tolist())]


@functools.lru_cache(maxsize=1)
def segmenter_of(path: str) -> Segmenter:
    """The segmenter of a worker process: its table serves all tasks of the worker."""
    return Segmenter(path)


def encode(docs: DataFrame, model: str, begin: bool = True, end: bool = True) -> DataFrame:
    """(doc_id, ids) of docs (doc_id, text): ids as little-endian unsigned 32-bit integers, with the model's begin and end ids if asked.

    `model` is the path of a model file on every machine. A null text counts as
    empty and has begin and end alone. Texts are segmented whole, whatever
    their length; so is a word. Rows that repeat, and a null doc_id, have a row
    each. An empty table gives an empty one; other columns are ignored. A model
    whose words aren't segmented alone (see words_apart) takes texts whole. No
    shuffle; memory is that of a few megabytes of text or of the longest text.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter_of(model)
        head, tail = (np.array([i] if asked else [], "<u4") for i, asked in ((own.model.bos_id(), begin), (own.model.eos_id(), end)))
        for batch in batches:
            for part in textprep.slices(batch, "text"):
                ids = [np.concatenate((head, x, tail)).tobytes() for x in own.encode(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.large_binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str, name: str = "text") -> DataFrame:
    """encoded (doc_id, ids), as encode() returns it, with the text that the library decodes from the ids; null for null ids."""
    ship_package(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter_of(model).model
        for batch in batches:
            for part in textprep.slices(batch, "ids"):
                lists = [np.frombuffer(b or b"", "<u4").tolist() for b in part.column("ids").to_pylist()]
                missing = np.asarray(part.column("ids").is_null())
                texts = pa.array(own.decode(lists, num_threads=1), pa.large_string(), mask=missing)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), texts], ["doc_id", "ids", name])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id long, ids binary, `{name}` string")


def n_ids(ids: Column) -> Column:
    """How many ids a value of encode() holds."""
    return (F.octet_length(ids) / 4).cast("long")
