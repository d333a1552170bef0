"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words, their prefixes of four to six letters,
and the prefixes that two words or more share, hashed into 2**20 buckets. A text scores w0 + sum of w_i + sum over
pairs of <v_i, v_j>; the pairs catch what no single weight shows, such as an
insult beside the mention of a group.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import textprep
from tidewright.session import ship_package

BUCKETS = 1 << 20
#: Labelled texts that the model is fitted on, about; terms that it keeps; factors of a term.
SAMPLE, TERMS, FACTORS = 12_000, 1500, 8
#: Standard errors by which a kept term's rate must differ between the labels.
SIGNAL = 4.0
#: Frequent terms whose pairs are looked at, standard errors by which a pair's effect must stand out, and terms that such pairs add at most.
PAIRED, PAIR_SIGNAL, ADDED = 2048, 6.0, 256
#: Terms that each step of the fit hides, so that one that tells enough by itself needn't share its weight with those beside it.
HIDDEN = 0.25
PREFIXES = (4, 5, 6)
WORD = re.compile(r"[^\W\d_]+")


def bucket(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def buckets_of(word: str) -> tuple[list[int], list[int]]:
    """Buckets of a word and its prefixes, and those that hold from the second word with a prefix on."""
    prefixes = [f"{n}:{word[:n]}" for n in PREFIXES if len(word) > n]
    return [bucket(t) for t in (word, *prefixes)], [bucket(f"2{t}") for t in prefixes]


def terms_of(text: str, known: Callable[[str], tuple] = buckets_of) -> set[int]:
    """All terms of a text, as numbers that `known` gives for its words."""
    own: set[int] = set()
    seen: set[int] = set()
    for w in set(WORD.findall(text.lower())):
        once, twice = known(w)
        own.update(once)
        for t in twice:
            if t in seen:
                own.add(t)
            else:
                seen.add(t)
    return own


@dataclass
class Machine:
    """Kept buckets and the weights; score() takes texts' kept terms as a 0/1 matrix."""

    kept: dict[int, int] = field(default_factory=dict)
    w0: float = -30.0
    w: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, FACTORS), np.float32))

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.w):
            return np.full(len(x), 1 / (1 + np.exp(-self.w0)))
        pairs = 0.5 * ((x @ self.v) ** 2 - x @ self.v**2).sum(1)
        return 1 / (1 + np.exp(-np.clip(self.w0 + x @ self.w + pairs, -30, 30)))


def paired(rows: list[np.ndarray], labels: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Buckets of pairs of terms that tell the labels apart together, whatever each does alone; the strongest pairs first.

    Of the PAIRED terms that divide the texts best, all pairs are tested by
    the sum of the label's and both terms' deviations from their means, over
    its standard error; pairs too rare to be expected five times among the
    rarer label are left out.
    """
    n, mean = len(labels), float(labels.mean())
    part = count / n
    pool = np.argsort(-part * (1 - part), kind="stable")[:PAIRED]
    pool = np.sort(pool[(part[pool] > 0) & (part[pool] < 1)])
    if len(pool) < 2:
        return pool[:0]
    known = {int(b): i for i, b in enumerate(pool)}
    off = (labels - mean).astype(np.float32)
    both, own = np.zeros((len(pool), len(pool))), np.zeros(len(pool))
    for at in range(0, n, 1024):
        x = matrix(rows[at : at + 1024], known)
        both += (x * off[at : at + 1024, None]).T @ x
        own += off[at : at + 1024] @ x
    p = part[pool]
    both -= p[:, None] * own[None] + own[:, None] * p[None]  # the deviations of the labels sum to zero
    spread = np.sqrt(p * (1 - p))
    z = np.abs(both) / (np.sqrt(n * mean * (1 - mean)) * spread[:, None] * spread[None])
    z[n * min(mean, 1 - mean) * np.minimum(p, 1 - p)[:, None] * np.minimum(p, 1 - p)[None] < 5] = 0
    a, b = np.nonzero(np.triu(z >= PAIR_SIGNAL, 1))
    order = np.argsort(-z[a, b], kind="stable")
    flat = np.stack((pool[a[order]], pool[b[order]]), 1).ravel()
    return flat[np.sort(np.unique(flat, return_index=True)[1])]


def fit(rows: list[np.ndarray], labels: np.ndarray, steps: int = 250, seed: int = 3) -> Machine:
    """Fit a machine on the buckets of labelled texts, by Adam on the logistic loss.

    The terms are those whose own rate differs between the labels, and those
    of pairs that differ together (paired()). Without both labels there is nothing to learn, and every text scores 0.
    """
    positive = float(labels.sum())
    negative = len(labels) - positive
    if not positive or not negative:
        return Machine()
    flat, of = np.concatenate(rows), np.repeat(labels, [len(r) for r in rows])
    hit = np.bincount(flat[of == 1], minlength=BUCKETS)
    miss = np.bincount(flat[of == 0], minlength=BUCKETS)
    rate = (hit + miss) / len(labels)
    error = np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / positive + 1 / negative))
    signal = np.where(hit + miss >= 3, np.abs(hit / positive - miss / negative) / error, 0)
    best = np.argsort(-signal, kind="stable")[:TERMS]
    best = best[signal[best] >= SIGNAL]
    more = paired(rows, labels, hit + miss)
    best = np.sort(np.concatenate((best, more[~np.isin(more, best)][:ADDED])))
    kept = {int(b): i for i, b in enumerate(best)}
    x = matrix(rows, kept)
    rng = np.random.default_rng(seed)
    m = Machine(kept, float(np.log(positive / negative)), np.zeros(len(best), np.float32), rng.normal(0, 0.01, (len(best), FACTORS)).astype(np.float32))
    state = [np.zeros_like(m.w), np.zeros_like(m.w), np.zeros_like(m.v), np.zeros_like(m.v)]
    mean = [np.zeros_like(m.w), np.zeros_like(m.v), np.zeros(())]
    y = labels.astype(np.float32)
    b1 = b2 = 0.0
    for t in range(1, steps + 1):
        seen = (rng.random(len(best)) >= HIDDEN).astype(np.float32)
        w, v = m.w * seen, m.v * seen[:, None]
        g = ((Machine(kept, m.w0, w, v).score(x) - y) / len(y)).astype(np.float32)
        xg = x.T @ g
        gw = seen * xg + 2e-5 * m.w
        gv = seen[:, None] * (x.T @ (g[:, None] * (x @ v)) - xg[:, None] * v) + 2e-4 * m.v
        for p, grad, i in ((m.w, gw, 0), (m.v, gv, 2)):
            state[i] += 0.1 * (grad - state[i])
            state[i + 1] += 0.01 * (grad**2 - state[i + 1])
            p -= 0.05 * (state[i] / (1 - 0.9**t)) / (np.sqrt(state[i + 1] / (1 - 0.99**t)) + 1e-8)
        b1, b2 = 0.9 * b1 + 0.1 * g.sum(), 0.99 * b2 + 0.01 * float(g.sum()) ** 2
        m.w0 -= 0.05 * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-8)
        if 2 * t > steps:  # what is hidden varies, so the last half of the steps is averaged
            for held, own in zip(mean, (m.w, m.v, m.w0)):
                held += own / (steps - steps // 2)
    return Machine(kept, float(mean[2]), mean[0], mean[1])


def matrix(rows: list[np.ndarray], kept: dict[int, int]) -> np.ndarray:
    out = np.zeros((len(rows), len(kept)), np.float32)
    at = np.full(BUCKETS, -1, np.int32)
    at[list(kept)] = list(kept.values())
    for i, r in enumerate(rows):
        own = at[r]
        out[i, own[own >= 0]] = 1
    return out


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Fit on about `sample` labelled documents for which `learn` (over labels' doc_id) holds.

    The sample is by a hash of doc_id; its size bounds what is broadcast and
    what comes to the driver (the sampled texts' buckets). Without rows, or
    with one label alone, the machine scores every text 0, but for rounding.
    """
    ship_package(docs.sparkSession)
    rows = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    n = rows.count()
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < int(1e6 * min(1.0, sample / max(n, 1)))
    chosen = rows.where(part).select("doc_id", F.col("label").cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in textprep.slices(batch, "text"):
                own = [sorted(terms_of(t)) for t in p.column("text").fill_null("").to_pylist()]
                yield pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("label"), pa.array(own, pa.list_(pa.int32()))], ["doc_id", "label", "terms"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    got = found.mapInArrow(run, "doc_id long, label int, terms array<int>").toArrow().sort_by("doc_id")
    if not got.num_rows:
        return Machine()
    flat = got.column("terms").combine_chunks()
    ends = np.cumsum(np.asarray(pc.list_value_length(flat)))
    return fit(np.split(np.asarray(flat.flatten()), ends[:-1]), got.column("label").to_numpy())


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text of docs (doc_id, text).

    A null or empty text has no terms and the score of the bias alone; of a
    text of any length all words are read, and a set of its terms is held. Rows
    that repeat a doc_id are scored each; other columns are ignored; an empty
    table gives an empty one.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}

        def places(w: str) -> tuple:
            own = known.get(w)
            if own is None:
                own = tuple(tuple(machine.kept[b] for b in part if b in machine.kept) for part in buckets_of(w))
                if len(w) < 40:
                    known[w] = own
            return own

        for batch in batches:
            for p in textprep.slices(batch, "text"):
                if len(known) > 500_000:
                    known.clear()
                x = np.zeros((p.num_rows, len(machine.kept)), np.float32)
                for i, text in enumerate(p.column("text").fill_null("").to_pylist()):
                    x[i, list(terms_of(text, places))] = 1
                yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(machine.score(x).astype(np.float64))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
