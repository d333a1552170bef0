"""Token ids in fixed-width bit packing, with block offsets for random access.

A file holds, for documents in ascending doc_id order: a header; blocks of
BLOCK ids, each id in the fewest bits that hold every id of the vocabulary,
each block starting at a byte; then the byte offsets of the blocks, the
document table (ids, a null mask, first id of each) and a trailer.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.llm import files, scratch, textprep
from tidewright.session import ship_package

MAGIC = b"TWPACK01"
HEADER = struct.Struct("<8sII")  # magic, bits of an id, ids of a block
TRAILER = struct.Struct("<QQQQ8s")  # ids, blocks, documents, where the offsets begin, magic
BLOCK = 1 << 14
#: Ids after which a task starts another file; ids of a piece that a task reads at once.
FILE_IDS, PIECE_IDS = 1 << 26, 1 << 22
#: Bytes of text that a task encodes, about, and tasks at most.
TASK_BYTES, TASKS = 1 << 25, 100_000


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits one after the other, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(planes, axis=1, bitorder="little")[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first count ids of packed data, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * bits].reshape(count, bits)
    padded = np.zeros((count, 32), np.uint8)
    padded[:, :bits] = flat
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Writes one file; add() takes the documents in order."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.held: list[np.ndarray] = []
        self.waiting = self.ids = 0
        self.offsets, self.docs, self.starts = [], [], []
        out.write(HEADER.pack(MAGIC, bits, block))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.ids)
        self.ids += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            self._flush(self.waiting - self.waiting % self.block)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        for at in range(0, n, self.block):
            self.offsets.append(self.out.tell())
            self.out.write(pack(ids[at : min(at + self.block, n)], self.bits))
        self.held, self.waiting = [ids[n:]], len(ids) - n

    def close(self) -> None:
        self._flush(self.waiting)
        at = self.out.tell()
        self.out.write(np.array(self.offsets, "<u8").tobytes())
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self.out.write(np.array([d is None for d in self.docs], np.uint8).tobytes())
        self.out.write(np.array(self.starts, "<u8").tobytes())
        self.out.write(TRAILER.pack(self.ids, len(self.offsets), len(self.docs), at, MAGIC))
        self.out.close()


class Reader:
    """Random access to a file: ids(start, stop) reads only the blocks it needs."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        magic, self.bits, self.block = HEADER.unpack(source.read_at(HEADER.size, 0))
        self.n, blocks, docs, at, last = TRAILER.unpack(source.read_at(TRAILER.size, end - TRAILER.size))
        if magic != MAGIC or last != MAGIC:
            raise ValueError("not a packed token file")
        table = source.read_at(end - TRAILER.size - at, at)
        self.offsets = np.concatenate([np.frombuffer(table, "<u8", blocks), np.array([at], np.uint64)]).astype(np.int64)
        self.docs = np.frombuffer(table, "<i8", docs, 8 * blocks)
        self.null = np.frombuffer(table, np.uint8, docs, 8 * blocks + 8 * docs).astype(bool)
        self.starts = np.append(np.frombuffer(table, "<u8", docs, 8 * blocks + 9 * docs), np.uint64(self.n)).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        data = self.source.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            a = int(self.offsets[b] - self.offsets[first])
            count = min(self.block, self.n - b * self.block)
            parts.append(unpack(data[a : a + (count * self.bits + 7) // 8], self.bits, count))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


# How byte-level BPE cuts a text (here over the common letters only), and the characters that stand for bytes.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
COMMON = re.compile(rf"[\t\n -~{LETTERS}]*")
TOKEN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves
_HIDDEN = sorted(set(range(256)) - _SHOWN)
BYTE_CHARS = {b: b if b in _SHOWN else 256 + _HIDDEN.index(b) for b in range(256)}
#: By the byte after a space: whether a blank may begin there, so that the text has to be looked at.
_MAY_BE_BLANK = np.zeros(256, bool)
_MAY_BE_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0xC2, 0xE1, 0xE2, 0xE3]] = True


#: The pre-tokenizer whose cuts textprep.sure_pieces and TOKEN know; texts of others are encoded whole.
KNOWN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def cuts_known(path: str) -> bool:
    """Whether a tokenizer file cuts texts as KNOWN does, without a normalizer, padding or truncation, and adds no token without a "<|"."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    own = data.get("pre_tokenizer") or {}
    plain = not any(data.get(k) for k in ("normalizer", "truncation", "padding")) and data["model"].get("type") == "BPE" and not data["model"].get("dropout")
    return plain and {k: own.get(k) for k in KNOWN} == KNOWN and all("<|" in t["content"] for t in data.get("added_tokens", []))


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer, with a cache of the pieces that it encodes alone.

    Such a tokenizer cuts a text before a space that stands between two other
    characters of which the second is no blank, and at some other places
    (textprep.sure_pieces). All pieces of many texts are grouped by a hash,
    compared byte by byte with the first of their group, and each different
    one is encoded once. Texts with another space, or with a special token's
    "<|", and all texts of a tokenizer that cuts otherwise, are encoded whole.
    """

    #: Pieces of each of two generations of the cache; what is used again moves to the younger.
    KEEP = 300_000
    ODD = re.compile(r" (?=\s|\Z)|<\|")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.known = cuts_known(path)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _token(self, token: str) -> bytes:
        shown = token.encode().decode("latin-1").translate(BYTE_CHARS)
        return b"".join([t.id.to_bytes(self.kind.itemsize, "little") for t in self.model.tokenize(shown)])

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece: of its tokens by the model where the cut is certain, else by the whole tokenizer."""
        if len(piece) <= 4096 and COMMON.fullmatch(piece):
            return b"".join([self._token(t) for t in TOKEN.findall(piece)])
        return self._whole(piece)

    def _odd(self, texts: list[str], data: np.ndarray, offsets: np.ndarray) -> list[int]:
        """Texts that can't be cut at spaces."""
        after = np.append(data[1:], np.uint8(32))
        after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = 32  # the end of a text counts as a blank
        at = np.flatnonzero(((data == 32) & _MAY_BE_BLANK[after]) | ((data == 60) & (after == 124)))
        return [i for i in np.unique(np.searchsorted(offsets, at, side="right") - 1).tolist() if self.ODD.search(texts[i])]

    def _cached(self, piece: bytes) -> bytes:
        ids = self.young.get(piece)
        if ids is None:
            ids = self.old.get(piece) or self._piece(piece.decode())
            if len(ids) <= 256:
                self.young[piece] = ids
        return ids

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        strings = texts.fill_null("").to_pylist()
        data, offsets = textprep.raw(texts)
        if not len(data):
            return [np.zeros(0, self.kind) for _ in strings]
        if not self.known:
            return [np.frombuffer(self._whole(t), self.kind) for t in strings]
        starts, first, hashes = textprep.sure_pieces(data, offsets)
        odd = self._odd(strings, data, offsets)
        used = np.ones(len(starts), bool)
        for i in odd:
            used[first[i] : first[i + 1]] = False
        ends = np.append(starts[1:], len(data))
        different, where, inverse = np.unique(np.where(used, hashes, np.uint64(0)), return_index=True, return_inverse=True)
        # pieces that share a hash with another one, if ever, come after the different ones
        apart = np.flatnonzero(used & textprep.differing(data, starts, ends, where[inverse]))
        inverse[apart] = len(where) + np.arange(len(apart))
        if len(self.young) > self.KEEP:
            self.young, self.old = {}, self.young
        raw = data.tobytes()
        own = [self._cached(raw[a:b]) if key else b"" for key, a, b in zip(different.tolist(), starts[where].tolist(), ends[where].tolist())]
        own += [self._cached(raw[starts[k] : ends[k]]) for k in apart.tolist()]
        count = np.array([len(b) for b in own], np.int64) // self.kind.itemsize
        each = np.where(used, count[inverse], 0)
        begin = (np.cumsum(count) - count)[inverse]
        bounds = np.concatenate(([0], np.cumsum(each)))
        flat = np.frombuffer(b"".join(own), self.kind)[np.repeat(begin - bounds[:-1], each) + np.arange(bounds[-1])]
        out = [flat[a:b] for a, b in zip(bounds[first[:-1]].tolist(), bounds[first[1:]].tolist())]
        for i in odd:
            out[i] = np.frombuffer(self._whole(strings[i]), self.kind)
        return out


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a worker process: its caches serve all tasks of the worker."""
    return Encoder(path)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """Write the packed files of docs (doc_id, text) and return their index: file, first, tie, ids, docs.

    Documents are dealt by ranges of doc_id (of equal ones by a hash of the
    text), about TASK_BYTES of text each, encoded and written where they are;
    a row of the index stands for each file of a task that ended well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        bits = bits_for(max(encoder.size, end_id + 1))
        store, path = files.place(folder)
        store.create_dir(path)
        writer, name, first, rows = None, "", 0, []

        def close():
            writer.close()
            rows.append((name, writer.docs[0], first, writer.ids, len(writer.docs)))

        for batch in batches:
            for part in textprep.slices(batch, "text"):
                columns = (part.column(c).to_pylist() for c in ("doc_id", "tie"))
                for doc_id, tie, ids in zip(*columns, encoder.encode(part.column("text"))):
                    if writer is None or writer.ids >= FILE_IDS:
                        if writer:
                            close()
                        name, first = files.attempt_name(".ids"), tie
                        writer = Writer(store.open_output_stream(f"{path}/{name}", compression=None), bits)
                    writer.add(doc_id, np.append(ids.astype(np.uint32), np.uint32(end_id)))
        if writer:
            close()
        if rows:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["file", "first", "tie", "ids", "docs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartitionByRange(min(TASKS, total // TASK_BYTES + 1), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return dealt.mapInArrow(run, "file string, first long, tie long, ids long, docs long")


def read(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of an index.

    A file is read in pieces of about PIECE_IDS ids, which are dealt evenly:
    a piece takes the document table and the blocks of its own documents.
    """
    order = W.orderBy(F.col("first").asc_nulls_first(), "tie", "file").rowsBetween(W.unboundedPreceding, -1)
    based = index.withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0)).cast("long"))
    pieces = F.ceil(F.col("ids") / PIECE_IDS)
    number = index.agg(F.sum(pieces)).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = files.place(folder)
        for batch in batches:
            for name, base, piece in zip(*(batch.column(c).to_pylist() for c in ("file", "base", "piece"))):
                with store.open_input_file(f"{path}/{name}") as source:
                    reader = Reader(source)
                    low, high = np.searchsorted(reader.starts[:-1], [piece * PIECE_IDS, (piece + 1) * PIECE_IDS])
                    for at in range(int(low), int(high), 256):
                        stop = min(at + 256, int(high))
                        starts = reader.starts[at : stop + 1]
                        ids = reader.ids(int(starts[0]), int(starts[-1]))
                        crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip((starts[:-1] - starts[0]).tolist(), (starts[1:] - starts[0]).tolist())]
                        own = slice(at, stop)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(reader.docs[own], mask=reader.null[own]), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    spread = based.select("file", "base", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece")).repartition(min(TASKS, number))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write packed files of docs in ascending doc_id order and return what read() finds in them.

    A null text counts as empty and has the end id alone. A null doc_id comes
    first; rows that repeat a doc_id are one after the other, by a hash of
    their texts. Texts of any length are encoded whole. An empty table writes
    no file and gives an empty one. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = scratch.new_path(spark, "token-files")
    index = scratch.table(write(docs, tokenizer, folder, end_id), "token-index")
    return read(index, folder)
