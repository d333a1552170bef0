"""Fill-in-middle: cut whole texts into prefix, middle and suffix and put the middle last.

A text's units are words with the white space before them; white space at the
end is a unit of its own. Boundaries are bits of one big integer: a translated
copy of the text is the mask of its word characters, the ends of words are
those bits without the mask shifted by one, and a ranked bit is found by
halving, so no unit is ever an object of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import textprep
from tidewright.session import ship_package

#: The marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_IS_WORD = bytes(ord("0" if b == 0x20 or 0x09 <= b <= 0x0D else "1") for b in range(256))


def unit_ends(text: str) -> int:
    """A mask whose bit i is set if a unit ends with code point i."""
    if not text:
        return 0
    # one byte for each code point; those beyond Latin-1 become "?", which is no white space either
    words = int(text.encode("latin-1", "replace")[::-1].translate(_IS_WORD), 2)
    last = 1 << (len(text) - 1)
    return (words & ~(words >> 1)) | last


def ranked_bit(mask: int, rank: int, width: int) -> int:
    """The place of the rank-th set bit (from 1) of a mask of `width` bits, by halving."""
    place = 0
    while width > 1:
        half = width >> 1
        low = mask & ((1 << half) - 1)
        count = low.bit_count()
        if rank <= count:
            mask, width = low, half
        else:
            mask, width, rank, place = mask >> half, width - half, rank - count, place + half
    return place


def numbers(seed: int, doc_id: int | None) -> tuple[int, ...]:
    """Four numbers below 2**32 of a document: the first eight-digit groups of the SHA-256 of seed:doc_id (a null id is empty)."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[8 * k : 8 * k + 8], 16) for k in range(4))


def rearranged(text: str, doc_id: int | None, seed: int, percent: int, spm_percent: int, marks: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and of middle (None if plain), and the output of a text."""
    ends = unit_ends(text)
    n = ends.bit_count()
    h = numbers(seed, doc_id)
    if not text or h[2] % 100 >= percent or any(m in text for m in marks):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ranked_bit(ends, r, len(text)) + 1 if r else 0 for r in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def transform(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of docs (doc_id, text), one row for each row.

    `percent` of the documents are rearranged, `spm_percent` of those with the
    suffix first; seed and doc_id alone decide, so any partitioning gives the
    same rows and equal texts under one id are cut alike. A null text counts
    as empty; an empty text, and one that holds a mark, stays plain. A null
    doc_id is a seed of its own. Texts of any length are cut whole, in memory
    of a few copies of the text. An empty table gives an empty one, and other
    columns are ignored. No shuffle.
    """
    if len(set(marks)) < 3 or not all(re.fullmatch(r"<[^<>]+>", m) for m in marks):
        raise ValueError("marks are three different ones like <P>, so that none begins within another or in the text before it")
    ship_package(docs.sparkSession)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string())
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textprep.slices(batch, "text"):
                rows = [(i, *rearranged(t or "", i, seed, percent, spm_percent, marks)) for i, t in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text")))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of, by its form; null for a null output or an unknown form."""
    p, s, m = map(re.escape, marks)
    part = lambda first, second: F.split(output, f"{first}|{second}", 4)
    psm, spm = part(f"{p}|{s}", m), part(f"{s}|{p}", m)  # "", then the three parts in the order of the form
    text = F.when(form == "plain", output)
    text = text.when(form == "psm", F.concat(F.get(psm, F.lit(1)), F.get(psm, F.lit(3)), F.get(psm, F.lit(2))))
    return text.when(form == "spm", F.concat(F.get(spm, F.lit(2)), F.get(spm, F.lit(3)), F.get(spm, F.lit(1))))
