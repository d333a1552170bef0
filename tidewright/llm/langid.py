"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time. It reads
windows of a text's UTF-8 bytes in both directions and gives every position
probabilities of the languages; a document's are the mean over its letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import textprep
from tidewright.session import ship_package

#: Bytes of a window, units in each direction, windows that are computed together.
STEPS, UNITS, TOGETHER = 64, 10, 2048
#: Labelled documents of the training sample, about, all languages getting the same number if they have them.
SAMPLE = 3000
#: Windows of the sampled documents to train on, about; more are thinned, each with the same chance.
WINDOWS = 16_000
_WORDLIKE = re.compile(r"[^\W\d_]")
_IS_LETTER = np.zeros(256, np.float32)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 256)]] = 1


def has_letter(text: str) -> bool:
    """Whether a character of a text is a letter (numbers such as a half or a Roman numeral are none)."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


@dataclass
class Network:
    """e: input of each byte to (update, reset, candidate) by direction; u: recurrent weights; o, b: output layer."""

    languages: list[str]
    e: np.ndarray  # 2, 3 UNITS, 256
    u: np.ndarray  # 2, 3 UNITS, UNITS
    o: np.ndarray  # languages, 2 UNITS
    b: np.ndarray  # languages

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.e, self.u, self.o, self.b]

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (steps, 2, units, windows) of bytes (steps, windows); the second direction runs from the end."""
        steps, n = x.shape
        k = UNITS
        h = np.zeros((2, k, n), np.float32)
        out = np.empty((steps, 2, k, n), np.float32)
        g = np.empty((2, 3 * k, n), np.float32)
        a = np.empty((2, 3 * k, n), np.float32)
        for t in range(steps):
            np.take(self.e[0], x[t], axis=1, out=g[0], mode="clip")
            np.take(self.e[1], x[steps - 1 - t], axis=1, out=g[1], mode="clip")
            np.matmul(self.u, h, out=a)
            gates = g[:, : 2 * k]
            gates += a[:, : 2 * k]
            np.clip(gates, 0, 1, out=gates)  # the hard sigmoid's slope and shift are in the weights
            z, r = gates[:, :k], gates[:, k:]
            c = a[:, 2 * k :] * r
            c += g[:, 2 * k :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, z.copy(), r.copy(), a[:, 2 * k :].copy(), c))
            h = (h - c) * z
            h += c
            out[t, 0], out[steps - 1 - t, 1] = h[0], h[1]
        return out

    def probabilities(self, h: np.ndarray) -> np.ndarray:
        """(steps, languages, windows) from hidden states."""
        logits = np.matmul(self.o, h.reshape(len(h), 2 * UNITS, -1)) + self.b[:, None]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits


def new_network(languages: list[str], seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)
    k, n = UNITS, len(languages)
    e = rng.normal(0, 0.3, (2, 3 * k, 256)).astype(np.float32)
    e[:, : 2 * k] = e[:, : 2 * k] * 0.25 + 0.5
    u = rng.normal(0, 0.3, (2, 3 * k, k)).astype(np.float32)
    u[:, : 2 * k] *= 0.25
    return Network(languages, e, u, rng.normal(0, 0.3, (n, 2 * k)).astype(np.float32), np.zeros(n, np.float32))


def gradients(net: Network, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of all positions of windows x (steps, windows) labelled y, and its gradients."""
    steps, n = x.shape
    k = UNITS
    keep: list = []
    h = net.states(x, keep)
    p = net.probabilities(h)
    at = np.arange(n)
    loss = float(-(np.log(p[:, y, at] + 1e-9) * weight).mean())
    d = p.copy()
    d[:, y, at] -= 1
    d *= weight / (steps * n)
    flat = h.reshape(steps, 2 * k, n)
    go = np.einsum("tln,tkn->lk", d, flat, optimize=True)
    gb = d.sum((0, 2))
    dh_all = np.matmul(net.o.T, d).reshape(steps, 2, k, n)
    ge, gu = np.zeros_like(net.e), np.zeros_like(net.u)
    back = np.zeros((2, k, n), np.float32)
    for t in range(steps - 1, -1, -1):
        before, z, r, a, c = keep[t]
        back = back + np.stack([dh_all[t, 0], dh_all[steps - 1 - t, 1]])
        dc = back * (1 - z) * (1 - c * c)
        dz = back * (before - c) * ((z > 0) & (z < 1))
        dr = dc * a * ((r > 0) & (r < 1))
        dg = np.concatenate([dz, dr, dc], axis=1)
        du = np.concatenate([dz, dr, dc * r], axis=1)
        gu += np.matmul(du, before.transpose(0, 2, 1))
        for way, own in ((0, x[t]), (1, x[steps - 1 - t])):
            one = np.zeros((n, 256), np.float32)
            one[at, own] = 1
            ge[way] += dg[way] @ one
        back = back * z + np.matmul(net.u.transpose(0, 2, 1), du)
    return loss, [ge, gu, go, gb]


def fit(windows: np.ndarray, labels: list[str], batch: int = 256, epochs: int = 4, rate: float = 0.02, seed: int = 2) -> Network:
    """Train on windows (n, STEPS) of bytes by Adam; languages weigh the same however many windows they have."""
    languages = sorted(set(labels))
    net = new_network(languages)
    code = {v: i for i, v in enumerate(languages)}
    y = np.array([code[v] for v in labels], np.int64)
    weight = (len(y) / len(languages) / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)
    rng = np.random.default_rng(seed)
    first, second = [np.zeros_like(p) for p in net.parameters], [np.zeros_like(p) for p in net.parameters]
    t, total = 0, max(1, epochs * -(-len(y) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            own = order[i : i + batch]
            _, grads = gradients(net, np.ascontiguousarray(windows[own].T), y[own], weight[own])
            t += 1
            scale = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((g**2).sum() for g in grads)))))
            for p, g, m, v in zip(net.parameters, grads, first, second):
                m += 0.1 * (scale * g - m)
                v += 0.01 * ((scale * g) ** 2 - v)
                p -= (rate * (1 - 0.9 * t / total) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
    return net


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, STEPS) that cover all bytes of all texts, the last of each filled with zeros, and their texts."""
    size = np.diff(offsets)
    count = -(-size // STEPS)
    of = np.repeat(np.arange(len(size)), count)
    rank = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[of] + rank * STEPS
    at = start[:, None] + np.arange(STEPS)
    inside = at < offsets[of + 1][:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(of) else np.zeros((0, STEPS), np.uint8), of


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probabilities (texts, languages) over the letters of each text."""
    total = np.zeros((len(offsets) - 1, len(net.languages)))
    letters = np.zeros(len(offsets) - 1)
    windows, of = cut(data, offsets)
    for i in range(0, len(windows), TOGETHER):
        own = windows[i : i + TOGETHER]
        x = np.ascontiguousarray(own.T)
        p = net.probabilities(net.states(x))
        letter = _IS_LETTER[x]
        np.add.at(total, of[i : i + TOGETHER], np.einsum("tln,tn->nl", p, letter, optimize=True))
        np.add.at(letters, of[i : i + TOGETHER], letter.sum(0))
    return total / np.maximum(letters, 1)[:, None]


def train(docs: DataFrame, learn: Column, label: str = "lang", sample: int = SAMPLE, most: int = WINDOWS) -> Network | None:
    """Train on windows of about `sample` documents with a label for which `learn` holds.

    The sample is drawn by a hash of doc_id from each language alike, so a rare
    one is learnt as well; there are few languages, and a row for each comes to
    the driver. All windows of the sampled texts take part with the same
    chance, wherever they are in a text: all of them, or about `most`. Both
    bounds are parameters, and the windows are all that comes to the driver.
    Null texts and ids, and texts without a letter, teach nothing. Without a
    labelled text there is no network.
    """
    ship_package(docs.sparkSession)
    rows = docs.where(learn & F.col(label).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("string").alias("label"), "text")
    held = {r[0]: r[1] for r in rows.groupBy("label").agg(F.count("*")).collect()}
    if not held:
        return None
    part = {k: min(1.0, sample / len(held) / n) for k, n in held.items()}
    chance = F.create_map(*[F.lit(x) for kv in sorted(part.items()) for x in kv])[F.col("label")]
    chosen = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(1_000_000)) < chance * 1e6)
    total = chosen.agg(F.sum(F.ceil(F.octet_length("text") / STEPS))).first()[0] or 0
    share = min(1.0, most / max(total, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in textprep.slices(batch, "text"):
                known = np.array([has_letter(t) for t in p.column("text").to_pylist()], bool)
                windows, of = cut(*textprep.raw(p.column("text")))
                doc = p.column("doc_id").to_numpy(zero_copy_only=False)[of]
                first = np.searchsorted(of, of)
                lot = textprep.mix(textprep.mix(doc.astype(np.uint64)) + (np.arange(len(of)) - first).astype(np.uint64))
                own = np.flatnonzero(known[of] & (lot <= np.uint64(share * (2**64 - 2**11))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[own]), p.column("label").take(pa.array(of[own])), pa.array([w.tobytes() for w in windows[own]], pa.binary())], ["doc_id", "label", "window"]
                )

    got = chosen.mapInArrow(run, "doc_id long, label string, window binary").toArrow()
    if not got.num_rows:
        return None
    got = got.sort_by([("doc_id", "ascending"), ("label", "ascending"), ("window", "ascending")])
    return fit(np.frombuffer(b"".join(got.column("window").to_pylist()), np.uint8).reshape(-1, STEPS), got.column("label").to_pylist())


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score (the pooled probability) of every whole text of docs (doc_id, text).

    Every byte of a text of any length is labelled. A null text, an empty one
    and one without a letter get `und` and 0, as does every text without a
    network. Equal probabilities go to the first language
    by name. Rows that repeat a doc_id are predicted each; other columns are
    ignored; an empty table gives an empty one.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in textprep.slices(batch, "text"):
                known = np.array([net is not None and has_letter(t) for t in p.column("text").fill_null("").to_pylist()], bool)
                lang, value = ["und"] * p.num_rows, np.zeros(p.num_rows)
                if known.any():
                    shares = pooled(net, *textprep.raw(p.column("text")))
                    best = shares.argmax(1)
                    lang = [net.languages[b] if k else "und" for b, k in zip(best, known)]
                    value = np.where(known, shares.max(1), 0.0)
                yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.minimum(value, 1.0))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
