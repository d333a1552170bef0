"""Vectorised hashing of the words of whole texts, straight from Arrow buffers.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z.
Hashes have 64 bits: a word is read eight bytes at a time, and each part is
mixed into what came before it, so no arithmetic of the letters cancels out.
Words of more than LONG bytes are hashed by BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER, _STOP, _PRINTED, _LATIN = (np.isin(np.arange(256), list(c)) for c in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b".,;:!?", range(33, 127), range(0xC3, 0xE0)))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes up to which a word is hashed in parts of eight.
LONG = 64
_STEP = U(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)  # the first k bytes of eight


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the SplitMix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros stand for bytes after the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def parts(view: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of runs of bytes the first eight bytes, the next eight, ...: which runs have that part, and their parts as numbers."""
    own = np.arange(len(starts))
    for at in range(0, LONG, 8):
        own = own[sizes[own] > at]
        if not len(own):
            return
        yield own, view[starts[own] + at] & _MASK[np.minimum(sizes[own] - at, 8)]


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each run [start, end) of data."""
    sizes = ends - starts
    out = mix(sizes.astype(U) + _STEP)
    for own, part in parts(eights(data), starts, sizes):
        out[own] = mix((out[own] ^ part) + _STEP)
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of text; a longer text is a part of its own."""
    sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and where each begins (nulls are empty)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not offsets[-1] - offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word, and for each text the index of its first word (one more at the end)."""
    data, offsets = raw(texts)
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    blank = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = edge[:-1].copy()
    before[1:] |= blank[:-1]
    after = edge[1:].copy()
    after[:-1] |= blank[1:]
    inside = ~blank
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return run_hashes(_LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def sure_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut where byte-level BPE surely cuts: piece starts, the first piece of each text (one more at the end), and hashes (never 0).

    Cuts are before each space, before common punctuation after a letter, and
    on both sides of a single line feed between characters that are no blanks.
    """
    n = len(data)
    cut = data == 0x20
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    cut[1:] |= _LETTER[data[:-1]] & _STOP[data[1:]]
    feed = np.flatnonzero((data[1:-1] == 0x0A) & _PRINTED[data[:-2]] & (_PRINTED | _LATIN)[data[2:]]) + 1
    cut[feed] = True
    cut[feed + 1] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets), run_hashes(data, starts, np.append(starts[1:], n)) | U(1)


def differing(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each run of bytes differs in any byte from the run whose number is other[i]."""
    sizes, twin = ends - starts, starts[other]
    out = sizes != sizes[other]
    view = eights(data)
    for at in range(0, LONG, 8):
        own = np.flatnonzero(~out & (sizes > at))
        if not len(own):
            break
        out[own] = (view[starts[own] + at] ^ view[twin[own] + at]) & _MASK[np.minimum(sizes[own] - at, 8)] != 0
    for i in np.flatnonzero(~out & (sizes > LONG) & (twin != starts)).tolist():
        out[i] = data[starts[i] : ends[i]].tobytes() != data[twin[i] : twin[i] + sizes[i]].tobytes()
    return out


def distinct_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One run of each different content, and for each run the place of its content among those; equal hashes are compared byte by byte."""
    _, where, inverse = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
    # runs that share a hash with another content, if ever, come after the different ones
    apart = np.flatnonzero(differing(data, starts, ends, where[inverse]))
    inverse[apart] = len(where) + np.arange(len(apart))
    return np.concatenate((where, apart)), inverse


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles.

    A text of fewer words than `width` has its whole sequence as the one
    shingle; one without words has none.
    """
    words, first = word_hashes(texts)
    keys = mix(np.arange(1, width + 1, dtype=U)) | U(1)
    count = max(0, len(words) - width + 1)
    joined = np.zeros(count, U)
    for i in range(width):
        joined += words[i : i + count] * keys[i]
    joined = mix(joined)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out = np.sort(joined[a : b - width + 1])
            yield out[np.concatenate(([True], out[1:] != out[:-1]))]
        elif b > a:
            with np.errstate(over="ignore"):
                yield mix(np.array([np.sum(words[a:b] * keys[: b - a]) ^ U(b - a)], U))
        else:
            yield np.zeros(0, U)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Tables of whole groups, from batches sorted by integer keys, with the bounds of the groups in each.

    A group that a batch cuts is held until its end; so memory is that of a
    batch and one group, and no call of Python is made for each small group.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cut = int(new[-1]) if len(new) else 0
        if cut:
            yield table.slice(0, cut).combine_chunks(), np.concatenate(([0], new))
        held = table.slice(cut)
    if held is not None:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def fixed_bytes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A matrix of the binary values of a column, all of one width."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)
