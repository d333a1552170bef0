"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark passages are cut into overlapping segments. A text that holds a
segment with at most k edits shares at least (length - Q + 1) - k * Q of its
q-grams with it, all on nearby diagonals (place in the text minus place in the
segment). Shared q-grams are counted in overlapping bands of diagonals, bands
that meet the bound are kept, and a banded alignment verifies them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import textprep
from tidewright.session import ship_package

#: Characters of a q-gram; of a segment; between the starts of segments.
Q, SEGMENT, STEP = 8, 80, 40
#: Edits allowed in a segment, as a part of its length, if the lemma can filter for so many: each destroys Q q-grams at most.
EDITS = 0.08
#: Characters of benchmark passages that are searched for together; more are searched for in blocks.
BLOCK_CHARS = 8_000_000
#: Bits of the table that tells whether a q-gram is in any segment.
FILTER_BITS = 22
#: Q-gram places of a text, and their pairs with segments, that are counted at once.
PLACES, PAIRS = 1 << 20, 1 << 22
#: Regions that are aligned at once.
ALIGNED = 4096

_MULT = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    """Lower case, runs of white space as one space, none at the ends."""
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit value of the q code points from each place on; equal code points give equal values."""
    n = max(0, len(points) - q + 1)
    small = (points * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
    if q == 8 and n:  # eight bytes from each place on, as one number
        return np.ndarray((n,), "<u8", small.data, strides=(1,)) * _MULT
    out = np.zeros(n, np.uint64)
    for i in range(q):
        out = out * np.uint64(257) + small[i : i + n]
    return out * _MULT


@dataclass
class Segments:
    """Segments of passages with an index of their q-grams (sorted keys, and who has each where)."""

    item: np.ndarray  # item_id of each segment
    text: list[np.ndarray]  # code points
    edits: np.ndarray  # allowed
    least: np.ndarray  # shared q-grams at least
    width: np.ndarray  # of a half band
    keys: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    table: np.ndarray  # by the top bits of a key: in any segment
    short: dict[str, list[int]]  # passages of fewer than Q characters, with their items

    @property
    def longest(self) -> int:
        return max(map(len, self.text), default=0)


def segments(items: list[tuple[int, str]]) -> Segments:
    """Cut normalised passages; those of fewer than Q characters have no q-gram and are kept as strings."""
    ids, texts, edits, short = [], [], [], {}
    for item, text in items:
        points = codes(normal(text))
        n = len(points)
        if n < Q:
            if n:
                short.setdefault(normal(text), []).append(item)
            continue
        starts = [0] if n < SEGMENT + STEP // 2 else [*range(0, n - SEGMENT, STEP), n - SEGMENT]
        for s in starts:
            own = points[s:] if len(starts) == 1 else points[s : s + SEGMENT]
            ids.append(item)
            texts.append(own)
            edits.append(min(int(EDITS * len(own)), (len(own) - Q) // Q))
    k = np.array(edits, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    found = [grams(t) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(g) for g in found])
    place = np.concatenate([np.arange(len(g)) for g in found]) if found else np.zeros(0, np.int64)
    flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    keys, first = np.unique(flat[order], return_index=True)
    table = np.zeros(1 << FILTER_BITS, bool)
    table[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    least = np.maximum(1, sizes - Q + 1 - k * Q)
    return Segments(np.array(ids, np.int64), texts, k, least, k + 1, keys, np.append(first, len(flat)), owner[order], place[order], table, short)


def regions(points: np.ndarray, seg: Segments) -> np.ndarray:
    """(segment, first diagonal) of the bands with enough shared q-grams; a band has 2 * width diagonals.

    Each diagonal is in two bands, and the width exceeds the edits, so all
    diagonals that an alignment can use lie together in one of them.
    """
    found = [np.zeros((0, 2), np.int64)]
    if not len(seg.keys):
        return found[0]
    span = 2 * seg.longest  # parts of a long text overlap by more than a region
    for start in range(0, max(1, len(points) - Q + 1), PLACES):
        part = grams(points[start : start + PLACES + span + Q - 1])
        at = np.flatnonzero(seg.table[(part >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        slot = np.searchsorted(seg.keys, part[at])
        slot[slot == len(seg.keys)] = 0
        held = seg.keys[slot] == part[at]
        at, slot = at[held] + start, slot[held]
        number = seg.first[slot + 1] - seg.first[slot]
        bounds = np.concatenate(([0], np.cumsum(number)))
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + PAIRS, side="right")) - 1)
            rows = np.repeat(np.arange(a, b), number[a:b])
            entry = seg.first[slot[rows]] + np.arange(len(rows)) - (bounds[rows] - bounds[a])
            who = seg.owner[entry]
            band = (at[rows] - seg.place[entry]) // seg.width[who]
            # a diagonal counts in the band that begins with its stripe, and in the one before
            both = np.concatenate([band, band - 1])
            counts.append(np.unique((np.concatenate([who, who]) << 40) + both + (1 << 39), return_counts=True))
            a = b
        if not counts:
            continue
        key, inverse = np.unique(np.concatenate([c[0] for c in counts]), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([c[1] for c in counts]))
        who = key >> 40
        enough = total >= seg.least[who]
        who, band = who[enough], (key[enough] & ((1 << 40) - 1)) - (1 << 39)
        found.append(np.stack([who, band * seg.width[who]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def align(points: np.ndarray, low: np.ndarray, high: np.ndarray, patterns: np.ndarray, diagonals: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits, start and end of the best alignment of each pattern with points[low:high], within its band of `width` diagonals.

    The rows of all alignments are computed together; a value holds the edits
    above its start's place in the band, so ties go to the first start.
    """
    n, m = patterns.shape
    unit = 1 << 20
    big = unit << 12
    lane = np.arange(width)
    at = diagonals[:, None] + lane  # place in the text before row 0 on each diagonal
    first, last = low[:, None], high[:, None]
    now = np.where((at >= first) & (at <= last), lane, big)
    after = np.full((n, width), big)
    for i in range(m):
        j = at + i  # character that the diagonal step uses
        inside = (j >= first) & (j < last)
        same = points[np.where(inside, j, 0)] == patterns[:, i : i + 1]
        after[:, :-1] = now[:, 1:]
        # the diagonal step, or a character of the pattern left out
        best = np.minimum(np.where(inside, now + np.where(same, 0, unit), big), after + unit)
        # characters of the text left out: a step to the next diagonal costs one edit
        best = np.minimum.accumulate(best - lane * unit, axis=1) + lane * unit
        now = np.where((j + 1 >= first) & (j + 1 <= last), np.minimum(best, big), big)
    end = now.argmin(1)
    value = now[np.arange(n), end]
    return value // unit, diagonals + value % unit, diagonals + end + m


def found_in(texts: list[str], seg: Segments) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """(index, [(item, start, end, edits)]) of the texts that hold a segment, places being those of the normal text.

    The texts are searched in one piece; a region that touches several texts
    is aligned with each of them alone.
    """
    plain = [normal(t) for t in texts]
    held: dict[int, dict[int, tuple[int, int, int]]] = {}
    for passage, items in seg.short.items():
        pattern = re.compile(rf"(?<!\S){re.escape(passage)}(?!\S)")
        for i, t in enumerate(plain):
            if passage in t and (own := [m.span() for m in pattern.finditer(t)]):
                held.setdefault(i, {}).update({item: (own[0][0], own[-1][1], 0) for item in items})
    if len(seg.keys):
        _held_segments(plain, seg, held)
    for i in sorted(held):
        yield i, sorted((item, *v) for item, v in held[i].items())


def _held_segments(plain: list[str], seg: Segments, held: dict[int, dict[int, tuple[int, int, int]]]) -> None:
    """Add the segments that normal texts hold to held: by text and item (start, end, edits)."""
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in plain])))
    joined = codes("\0".join(plain) + "\0")
    near = regions(joined, seg)
    if not len(near):
        return
    who, diagonal = near[:, 0], near[:, 1]
    lengths = np.array([len(t) for t in seg.text], np.int64)
    a = np.searchsorted(starts, np.clip(diagonal, 0, len(joined) - 1), side="right") - 1
    b = np.searchsorted(starts, np.clip(diagonal + 2 * seg.width[who] + lengths[who], 0, len(joined) - 1), side="right") - 1
    row = np.repeat(np.arange(len(near)), b - a + 1)
    text = a[row] + np.arange(len(row)) - np.repeat(np.cumsum(b - a + 1) - (b - a + 1), b - a + 1)
    who, diagonal = who[row], diagonal[row]
    shape = lengths[who] << 20 | seg.width[who]
    for kind in np.unique(shape).tolist():  # alignments of one size together
        own = np.flatnonzero(shape == kind)
        for part in np.array_split(own, -(-len(own) // ALIGNED)):
            patterns = np.stack([seg.text[k] for k in who[part]])
            edits, start, end = align(joined, starts[text[part]], starts[text[part] + 1] - 1, patterns, diagonal[part], 2 * int(seg.width[who[part[0]]]))
            for k in np.flatnonzero(edits <= seg.edits[who[part]]).tolist():
                i, item = int(text[part[k]]), int(seg.item[who[part[k]]])
                x, y, e = int(start[k] - starts[i]), int(end[k] - starts[i]), int(edits[k])
                was = held.setdefault(i, {}).get(item, (x, y, e))
                held[i][item] = (min(x, was[0]), max(y, was[1]), min(e, was[2]))


def original_places(text: str, places: list[int]) -> list[int]:
    """Places in a text of places in normal(text); both in code points."""
    source, blank = [], True
    for i, c in enumerate(text):
        if c.isspace():
            if not blank:
                source.append(i)
            blank = True
        else:
            source += [i] * len(c.lower())
            blank = False
    source.append(len(text))
    return [source[min(p, len(source) - 1)] for p in places]


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Passages (item_id, text) in blocks of about `most` characters, each of which fits into a task.

    The blocks come to the driver one by one: a benchmark is a stated query
    set, searched for in all documents, and a block is all that is ever held.
    """
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    number = max(1, -(-total // most))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(number))
    for b in range(number):
        own = rows if number == 1 else rows.where(part == b)
        yield sorted((r[0], r[1]) for r in own.collect())


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits) for each passage found in a text of docs (doc_id, text).

    A passage is found where one of its segments (its whole, if short) occurs
    in the lower-cased text, white space runs as one space, with at most EDITS
    of its length in edits (none under 2 * Q characters); passages under Q
    characters have to occur exactly, between white space. start and end are
    code points of the text, from the first to the last segment found. Texts of
    any length are searched whole. Null and empty texts hold nothing, as does a
    null or empty passage. Rows that repeat a doc_id are searched each. Other
    columns are ignored; an empty table on either side gives an empty one.

    A benchmark of up to BLOCK_CHARS characters takes one pass over the texts;
    a larger one takes a pass for each block of that size.
    """
    spark = docs.sparkSession
    ship_package(spark)
    out = None
    for items in blocks(benchmark):
        seg = spark.sparkContext.broadcast(segments(items))

        def run(batches: Iterator[pa.RecordBatch], seg=seg) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64()] * 5
            for batch in batches:
                for part in textprep.slices(batch, "text"):
                    texts, ids, rows = part.column("text").fill_null("").to_pylist(), part.column("doc_id").to_pylist(), []
                    for i, own in found_in(texts, seg.value):
                        at = original_places(texts[i], [p for _, a, b, _ in own for p in (a, max(a, b - 1))])
                        rows += [(ids[i], item, at[2 * k], at[2 * k + 1] + 1, edits) for k, (item, _, _, edits) in enumerate(own)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "item_id", "start", "end", "edits"])

        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long")
        out = own if out is None else out.union(own)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in whose text no passage of the benchmark is found; all columns stay as they are.

    Null and empty texts stay, as nothing is found in them; repeated rows stay
    or go together; a null doc_id makes no difference. An empty benchmark
    leaves all rows, an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship_package(spark)
    out = docs
    for items in blocks(benchmark):
        seg = spark.sparkContext.broadcast(segments(items))
        at = docs.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch], seg=seg) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in textprep.slices(batch, at):
                    hit = {i for i, _ in found_in(part.column(at).fill_null("").to_pylist(), seg.value)}
                    yield part.filter(pa.array([i not in hit for i in range(part.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out
