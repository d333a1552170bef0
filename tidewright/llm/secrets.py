"""Secret scans: fixed patterns, and two character Markov models of tokens.

One model is of random strings, the other of ordinary identifiers; a token is
reported when its log-likelihood ratio passes a threshold, in total and per
character. Both are trained from labelled samples: a table's or made ones, and
the tokens of a corpus, of which those that the fixed patterns find are
secrets. The corpus teaches what is ordinary in it, such as its own language.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import textprep
from tidewright.session import ship_package

# The base patterns, their least lengths and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Tokens that the models judge: runs of these characters.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
#: The log-likelihood ratio per character, and in all, from which a token is a secret.
RATIO, EVIDENCE = 0.75, 18.0
#: Lengths of the made strings.
MADE = (20, 64)

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_ALPHABET = _LETTERS + _LETTERS.upper() + "0123456789+/_=-"

# Ordinary words from which identifiers of the labelled sample are made.
WORDS = (
    "account action array base block buffer cache check class client code color column config count create data default delete "
    "error event field file filter find format group handle header height image index input item label length level list load "
    "message method model module name node number object option output page parent path position process query range read record "
    "request result row schema score search select server session size source state status string style table target text time "
    "title type update upload user value vector version view width window worker write haben werden schaft lichkeit ungen nicht "
    "mente ciones para como cuando tionnement ement quelle cette pourquoi erheit keiten sprache ación mundo español français"
).split()


def samples(n: int = 3000, seed: int = 5) -> list[tuple[str, int]]:
    """Labelled strings: 1 for random ones, 0 for ordinary identifiers, paths and long words."""
    rng = np.random.default_rng(seed)
    sets = ["0123456789abcdef", _ALPHABET[:62], _ALPHABET[:62] + "+/", _ALPHABET[26:62], _LETTERS + "0123456789", _ALPHABET[:62] + "-_"]
    out = []
    for i in range(n):
        chars = sets[i % len(sets)]
        out.append(("".join(chars[k] for k in rng.integers(0, len(chars), int(rng.integers(*MADE)))), 1))
        words = [WORDS[k].encode("ascii", "ignore").decode() for k in rng.integers(0, len(WORDS), int(rng.integers(3, 8)))]
        style = i % 7
        if style == 0:
            name = "_".join(words)
        elif style == 1:
            name = words[0] + "".join(w.title() for w in words[1:])
        elif style == 2:
            name = "-".join(words)
        elif style == 3:
            name = "/".join(words)
        elif style == 4:
            name = "_".join(words).upper()
        elif style == 5:
            name = "".join(words)
        else:
            name = "_".join(words) + "_" + str(int(rng.integers(0, 2000)))
        out.append((name, 0))
    return out


_CLASS = np.full(256, len(_ALPHABET), np.int64)
_CLASS[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
_N = len(_ALPHABET) + 1


def sample_counts(labelled: Iterable[tuple[str, int]]) -> np.ndarray:
    """Transitions (label, from, to) of labelled strings; the start and other characters are one symbol."""
    counts = np.zeros((2, _N, _N))
    for text, label in labelled:
        codes = np.concatenate(([_N - 1], _CLASS[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]))
        np.add.at(counts[int(label)], (codes[:-1], codes[1:]), 1)
    return counts


def labelled_counts(table: DataFrame, token: str = "token", label: str = "label") -> np.ndarray:
    """Transitions (label, from, to) of a table of labelled strings: 1 for secrets, 0 for ordinary ones; rows with a null are left out.

    A task adds up its own; 2 * 65 * 65 sums come to the driver, however large
    the table is.
    """
    ship_package(table.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _N, _N), np.int64)
        for batch in batches:
            counts += sample_counts(zip(batch.column("t").to_pylist(), batch.column("l").to_pylist())).astype(np.int64)
        flat = counts.ravel()
        own = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(flat[own])], ["k", "n"])

    rows = table.select(F.col(token).alias("t"), F.col(label).cast("int").alias("l")).where("t IS NOT NULL AND l IN (0, 1)")
    out = np.zeros(2 * _N * _N)
    for k, n in rows.mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out.reshape(2, _N, _N)


def train(labelled: Iterable[tuple[str, int]] | np.ndarray, corpus: np.ndarray | None = None, weight: float = 1.0) -> np.ndarray:
    """Log-likelihood ratio of each transition, smoothed by the frequencies of symbols; all zeros, so that nothing is reported, where a label has no string.

    labelled may be transitions (see labelled_counts). corpus (see
    corpus_counts) counts as it is, and as `weight` times the labelled strings
    at most, however large it is.
    """
    counts = labelled.copy() if isinstance(labelled, np.ndarray) else sample_counts(labelled)
    if not counts[0].any() or not counts[1].any():
        return np.zeros((_N, _N))
    if corpus is not None:
        for label in (0, 1):
            if corpus[label].sum():
                counts[label] += corpus[label] * min(1.0, weight * counts[label].sum() / corpus[label].sum())
    # what a symbol was rarely followed by is taken from how frequent symbols are at all
    alone = counts.sum(1, keepdims=True) + 1
    counts += _N * alone / alone.sum(2, keepdims=True)
    logs = np.log(counts / counts.sum(2, keepdims=True))
    return logs[1] - logs[0]


def ratio(token: str, model: np.ndarray) -> float:
    """Mean log-likelihood ratio of an ASCII token; above 0 it is likelier random."""
    codes = np.concatenate(([_N - 1], _CLASS[np.frombuffer(token.encode("ascii"), np.uint8)]))
    return float(model[codes[:-1], codes[1:]].mean())


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (bytes) and text of each token of texts, and the symbol before and at each byte."""
    code = _CLASS[data]
    before = np.concatenate(([_N - 1], code[:-1]))
    before[offsets[:-1][offsets[:-1] < len(data)]] = _N - 1
    inside = code < _N - 1
    starts = np.flatnonzero(inside & (before == _N - 1))
    after = np.append(before[1:], _N - 1)  # a text that begins next ends a token as well
    ends = np.flatnonzero(inside & ((after == _N - 1) | ~np.append(inside[1:], False))) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, before, code


def with_long_tokens(starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> set[int]:
    """Texts that have a token of 32 bytes or more, as a run of hex digits is inside one."""
    return set(np.unique(of[ends - starts >= 32]).tolist())


def base_spans(text: str, long: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of what the fixed patterns find; without a long token there is no hex one."""
    found, low = [], text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)] if long else found


def hits(starts: np.ndarray, ends: np.ndarray, before: np.ndarray, code: np.ndarray, model: np.ndarray, threshold: float, evidence: float) -> np.ndarray:
    """Which tokens (see tokens()) the models take for secrets."""
    total = np.add.reduceat(np.where(code < _N - 1, model[before, code], 0.0), starts)
    return np.flatnonzero((total >= evidence) & (total >= threshold * (ends - starts)))


def likely(data: np.ndarray, offsets: np.ndarray, model: np.ndarray, threshold: float, evidence: float) -> tuple[list[list[tuple[int, int]]], set[int]]:
    """For each text (start, end) in code points of the tokens that the models take for secrets; and the texts with long tokens."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
    starts, ends, of, before, code = tokens(data, offsets) if len(data) else (np.zeros(0, np.int64),) * 5
    if not len(starts):
        return out, set()
    hit = hits(starts, ends, before, code, model, threshold, evidence)
    if len(hit):
        point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
        for k in hit.tolist():
            first = point[offsets[of[k]]]
            out[of[k]].append((int(point[starts[k]] - first), int(point[ends[k]] - first)))
    return out, with_long_tokens(starts, ends, of)


def spans(text: str, hits: list[tuple[int, int]], long: bool = True) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind: the base spans, and the models' hits that overlap none of them."""
    found = base_spans(text, long)
    base = sorted((a, b) for _, a, b in found)
    k, reach = 0, 0  # the furthest end of the base spans that start before a hit's end
    for a, b in hits:
        while k < len(base) and base[k][0] < b:
            reach = max(reach, base[k][1])
            k += 1
        if reach <= a:
            found.append(("markov", a, b))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def corpus_counts(docs: DataFrame, model: np.ndarray | None = None) -> np.ndarray:
    """Transitions (label, from, to) of all tokens of all texts: label 1 within base spans, 0 elsewhere.

    Tokens of the length of made secrets that `model` takes for secrets, but no
    pattern finds, count for neither, lest secrets pass for ordinary. A task adds up its own; 2 * 65 * 65 sums come to the driver. Null and
    empty texts, and an empty table, count nothing.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * _N * _N, np.int64)
        for batch in batches:
            for part in textprep.slices(batch, "text"):
                data, offsets = textprep.raw(part.column("text"))
                if not len(data):
                    continue
                *places, before, code = tokens(data, offsets)
                long = with_long_tokens(*places)
                label = np.zeros(len(data), np.int64)
                for i, text in enumerate(part.column("text").fill_null("").to_pylist()):
                    if own := base_spans(text, i in long):
                        size = np.diff(offsets)[i]
                        lead = np.flatnonzero((data[offsets[i] : offsets[i + 1]] & 0xC0) != 0x80) if size != len(text) else None
                        place = lambda p: int(size if p >= len(text) else p if lead is None else lead[p])  # noqa: B023, E731
                        for kind, a, b in own:
                            value = ASSIGN.match(text, a).start(2) if kind == "assign" else a  # the name before it is no secret
                            label[offsets[i] + place(value) : offsets[i] + place(b)] = 1
                if model is not None and len(places[0]):
                    found = hits(places[0], places[1], before, code, model, RATIO, EVIDENCE)
                    for k in found[places[1][found] - places[0][found] >= MADE[0]].tolist():
                        own = label[places[0][k] : places[1][k]]
                        own[own == 0] = 2
                at = ((label * _N + before) * _N + code)[(code < _N - 1) & (label < 2)]
                counts += np.bincount(at, minlength=len(counts))
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(counts[own])], ["k", "n"])

    out = np.zeros(2 * _N * _N)
    for k, n in docs.select("text").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out.reshape(2, _N, _N)


def scan(docs: DataFrame, model: np.ndarray | None = None, threshold: float = RATIO, evidence: float = EVIDENCE, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov for each row of docs (doc_id, text).

    Without a model one is trained from the labelled strings (token, label), or
    from samples() if there are none, and from docs themselves.
    Null and empty texts have no spans; a text of any length is scanned whole.
    Rows that repeat a doc_id are scanned each; other columns are ignored; an
    empty table gives an empty one.
    """
    ship_package(docs.sparkSession)
    if model is None:
        own = sample_counts(samples()) if labelled is None else labelled_counts(labelled)
        model = train(own, corpus_counts(docs, train(own)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textprep.slices(batch, "text"):
                rows = []
                hits, long = likely(*textprep.raw(part.column("text")), model, threshold, evidence)
                for i, text in enumerate(part.column("text").fill_null("").to_pylist()):
                    own = spans(text, hits[i], i in long)
                    base = ",".join(f"{k}:{a}:{b}" for k, a, b in own if k != "markov")
                    count = [sum(k == kind for k, _, _ in own) for kind in KINDS]
                    rows.append((*count[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in own), count[3]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                columns = [part.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")
