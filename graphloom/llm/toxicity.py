"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as two vectors: its own, which starts from what the training rows say of
the word (its smoothed log-odds and how sure they are) and is trained from there, and the
learned mean over its character trigrams, so that a word in a new spelling or with marks
around it still resembles itself. A word of over 48 characters enters as its parts, cut after marks, and those still long as
overlapping pieces, so that none of it is left out. A window of 32 words goes through a gated recurrent layer in both
directions; attention pools the states; windows overlap by half, and the document's
logit is the log-sum-exp of its windows', put on the scale of probabilities by a
logistic fit on rows held back from training.

Everything is numpy, forward and backward. Training takes a bounded sample of
labelled rows in one task, whose network is all that the driver gets; scoring runs on the
executors over whole texts.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import byte_slices, small_batches, text_or_empty

#: Words of a window and from one window's start to the next.
WINDOW, STRIDE = 32, 16
#: Hidden units of a direction; word and character dimensions; their table sizes.
HIDDEN, DIM, SEEN, WORDS, GRAMS = 8, 8, 6, 1 << 17, 1 << 13
#: Labelled rows that training takes at most, and the characters of them all together.
TRAIN_ROWS, TRAIN_CHARS = 5000, 40_000_000
#: Passes over so many rows; fewer rows are passed over more often, by the square root.
PASSES, PASSES_ROWS = 4, 4000
_MARKS = ".,;:!?()[]{}<>\"'`#*$%&-_+=~|/\\@^…“”‘’«»¿¡"
_PAD = 0
#: Characters of a word that is taken whole, and of a piece of a longer one.
LONG, PIECE = 48, 8
_PARTS = re.compile("[^{0}]+[{0}]*|[{0}]+".format(re.escape(_MARKS)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.reciprocal(1 + np.exp(-x, dtype=np.float32), dtype=np.float32)


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the key as text, mod 4, is 2."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(4)) == 2


def words_of(text: str) -> list[str]:
    """The words between white space; one of over ``LONG`` characters as its pieces."""
    words = text.lower().split()
    if len(text) <= LONG or all(len(w) <= LONG for w in words):
        return words
    return [p for w in words for p in ([w] if len(w) <= LONG else _pieces(w))]


def _pieces(word: str) -> list[str]:
    """The parts of a long word, cut after marks; those still long as overlapping pieces."""
    out = []
    for part in _PARTS.findall(word):
        if len(part) <= LONG:
            out.append(part)
        else:
            out += [part[i : i + PIECE] for i in range(0, len(part) - PIECE // 2, PIECE // 2)]
    return out


def _word_ids(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32((w.strip(_MARKS) or w).encode("utf-8", "surrogatepass")) % WORDS for w in words], np.int64)


def _gram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram ids of all words on end, and where each word's begin."""
    raw = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    sizes = np.array([len(r) for r in raw], np.int64)
    at = np.cumsum(sizes) - sizes
    grams = (data[:-2] * np.uint32(40503) + data[1:-1] * np.uint32(2654435) + data[2:] * np.uint32(97)) * np.uint32(2654435761)
    inside = np.ones(len(data), bool)
    inside[at + sizes - 1] = inside[at + sizes - 2] = False
    return (grams[inside[:-2]] >> np.uint32(19)).astype(np.int64) % GRAMS, at - 2 * np.arange(len(raw))


def _sums(values: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``values`` added up by ``index``: one sort, then runs."""
    out = np.zeros((size, values.shape[1]), np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        ranked = index[order]
        at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        out[ranked[at]] = np.add.reduceat(values[order], at, axis=0)
    return out


class _Names(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class _Vocabulary:
    """The words of training rows, each hashed once: its row and its trigrams."""

    def __init__(self, texts: Iterable[str]):
        names = _Names()
        # one text's words at a time: as strings those of all texts take much memory
        self.docs = [np.array([names[w] for w in words_of(t)], np.int32) for t in texts]
        words, ids, grams, counts = list(names), [], [], []
        del names
        for i in range(0, len(words), 20_000):
            lot = words[i : i + 20_000]
            found, at = _gram_ids(lot)
            ids.append(_word_ids(lot))
            grams.append(found.astype(np.uint16))  # less than GRAMS
            counts.append(np.diff(np.append(at, len(found))))
        none = [np.empty(0, np.int64)]
        self.ids, self.counts = np.concatenate(ids or none), np.concatenate(counts or none)
        self.grams = np.concatenate(grams or [np.empty(0, np.uint16)])
        self.at = np.cumsum(self.counts) - self.counts

    def grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Trigrams of ``words`` on end, and how many each has."""
        counts = self.counts[words]
        ends = np.cumsum(counts)
        return self.grams[np.repeat(self.at[words] - (ends - counts), counts) + np.arange(ends[-1])], counts


def windows_of(n: int, stride: int) -> np.ndarray:
    """Starts of windows that cover ``n`` words; the last ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.unique(np.append(np.arange(0, n - WINDOW, stride), n - WINDOW))


class Net:
    """Parameters and passes of the network."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        self.p = {
            "gram": f(GRAMS, DIM, s=0.1), "word": np.zeros((WORDS, SEEN), np.float32),
            "wx": f(2, SEEN + DIM, 3 * HIDDEN, s=0.35), "wh": f(2, HIDDEN, 3 * HIDDEN, s=0.35), "b": np.zeros((2, 3 * HIDDEN), np.float32),
            "att": f(2 * HIDDEN, s=0.3), "out": f(2 * HIDDEN, s=0.5), "bias": np.array([-3.0], np.float32),
        }
        self.scale = (1.0, 0.0)

    def inputs(self, ids: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Vectors of words from their rows and trigrams, ``counts`` to a word."""
        mean = np.add.reduceat(self.p["gram"][grams], np.cumsum(counts) - counts) / counts[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][ids], mean.astype(np.float32)], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """A word's share of the gates in both directions: 2 x n x 3H."""
        return np.stack([x @ self.p["wx"][d] + self.p["b"][d] for d in (0, 1)])

    @staticmethod
    def pad() -> np.ndarray:
        """The gates of no word: the state passes unchanged."""
        row = np.zeros((2, 1, 3 * HIDDEN), np.float32)
        row[:, :, :HIDDEN] = 30
        return row

    def forward(self, table: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows (rows of ``index`` into the projected ``table``; 0 pads)."""
        n, t_max, h_ = len(index), index.shape[1], HIDDEN
        states = np.empty((2, t_max, n, h_), np.float32)
        saved: list = [[None] * t_max, [None] * t_max]
        for d in (0, 1):
            h = np.zeros((n, h_), np.float32)
            wh = self.p["wh"][d]
            gates = table[d]
            for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
                x = gates[index[:, t]]
                u = h @ wh
                zr = _sigmoid(x[:, : 2 * h_] + u[:, : 2 * h_])
                z, r = zr[:, :h_], zr[:, h_:]
                c = np.tanh(x[:, 2 * h_ :] + r * u[:, 2 * h_ :])
                if keep:
                    saved[d][t] = (h, z, r, c, u[:, 2 * h_ :])
                h = c + z * (h - c)
                states[d, t] = h
        both = np.concatenate([states[0], states[1]], axis=2)  # t x n x 2H
        score = both @ self.p["att"]
        score[index.T == _PAD] = -1e9
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, both, optimize=True)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, (both, weight, pooled, saved)) if keep else logit

    def backward(self, index: np.ndarray, kept: tuple, g: np.ndarray, size: int) -> tuple[dict, np.ndarray]:
        """Gradients for ``g``, that of the window logits; and of the table's rows."""
        both, weight, pooled, saved = kept
        h_ = HIDDEN
        out = {"out": pooled.T @ g, "bias": np.array([g.sum()])}
        gp = g[:, None] * self.p["out"]
        gw = np.einsum("nh,tnh->tn", gp, both, optimize=True)
        gs = weight * (gw - (weight * gw).sum(axis=0))
        out["att"] = np.einsum("tn,tnh->h", gs, both, optimize=True)
        gb = weight[:, :, None] * gp + gs[:, :, None] * self.p["att"]
        rows = []
        out["wh"] = np.zeros_like(self.p["wh"])
        for d in (0, 1):
            wh, gh = self.p["wh"][d], np.zeros((len(index), h_), np.float32)
            gates = np.empty((index.shape[1], len(index), 3 * h_), np.float32)
            for t in range(index.shape[1] - 1, -1, -1) if d == 0 else range(index.shape[1]):
                h, z, r, c, un = saved[d][t]
                gh = gh + gb[t][:, d * h_ : (d + 1) * h_]
                gc = gh * (1 - z) * (1 - c * c)
                gz = gh * (h - c) * z * (1 - z)
                gr = gc * un * r * (1 - r)
                gu = np.concatenate([gz, gr, gc * r], axis=1)
                out["wh"][d] += h.T @ gu
                gates[t, :, : 2 * h_], gates[t, :, 2 * h_ :] = gu[:, : 2 * h_], gc
                gh = gh * z + gu @ wh.T
            rows.append(gates.reshape(-1, 3 * h_))
        total = _sums(np.concatenate(rows, axis=1), index.T.ravel(), size).reshape(size, 2, 3 * h_)
        total[_PAD] = 0
        return out, total


def _pool(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-sum-exp over each document's windows."""
    top = np.maximum.reduceat(logits, at)
    sizes = np.diff(np.append(at, len(logits)))
    return top + np.log(np.add.reduceat(np.exp(logits - np.repeat(top, sizes)), at))


def _layout(counts: list[int], stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Window rows over words on end (1-based; 0 pads), and each document's first."""
    rows, at, base = [], [], 1
    seen = 0
    for n in counts:
        start = windows_of(n, stride)
        w = base + start[:, None] + np.arange(WINDOW)
        w[w >= base + n] = _PAD
        rows.append(w)
        at.append(seen)
        seen += len(start)
        base += n
    return np.concatenate(rows), np.array(at)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Net:
    """Fit a network; a fifth of the rows sets the scale of probabilities."""
    net, r = Net(seed), np.random.default_rng(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():  # nothing to tell apart: the base rate
        net.p["out"][:] = 0
        net.scale = (0.0, float(np.clip(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), -5, 5)) if len(y) else 0.0)
        return net
    order = r.permutation(len(texts))
    known = _Vocabulary(texts[i] for i in order[len(order) // 5 :])
    docs = dict(zip(order[len(order) // 5 :].tolist(), known.docs))
    fit = [i for i, d in docs.items() if len(d)]
    _start_from_odds(net, [known.ids[docs[i]] for i in fit], y[fit])
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, passes = 0, max(1, round(PASSES * (PASSES_ROWS / max(1, len(fit))) ** 0.5))
    for turn in range(passes):
        for batch in _batches([fit[i] for i in r.permutation(len(fit))], docs):
            step += 1
            words, places = np.unique(np.concatenate([docs[i] for i in batch]), return_inverse=True)
            index, at = _layout([len(docs[i]) for i in batch], WINDOW)
            index = np.append(0, places + 1)[index]
            grams, counts = known.grams_of(words)
            x = net.inputs(known.ids[words], grams, counts)
            table = np.concatenate([net.pad(), net.project(x)], axis=1)
            logit, kept = net.forward(table, index, keep=True)
            doc = _pool(logit, at)
            err = (_sigmoid(doc) - y[batch]) / len(batch)
            sizes = np.diff(np.append(at, len(logit)))
            g = (np.repeat(err, sizes) * np.exp(logit - np.repeat(doc, sizes))).astype(np.float32)
            grads, rows = net.backward(index, kept, g, table.shape[1])
            rows = rows[1:]
            grads["wx"] = np.stack([x.T @ rows[:, d] for d in (0, 1)])
            grads["b"] = rows.sum(axis=0)
            gx = sum(rows[:, d] @ net.p["wx"][d].T for d in (0, 1))
            grads["gram"] = _sums(np.repeat(gx[:, SEEN:] / counts[:, None], counts, axis=0), grams, GRAMS)
            own = known.ids[words]
            grads["word"] = _sums(gx[:, :SEEN], own, WORDS)
            # every row of the tables is touched by few words: they move slowly
            speed = 0.02 * 0.6 ** (PASSES * turn / passes)
            for k, grad in grads.items():
                # of the words only those of the batch move
                at = np.unique(own) if k == "word" else slice(None)
                m, v, g = state[k][0][at], state[k][1][at], grad[at]
                m = m + 0.1 * (g - m)
                v = v + 0.01 * (g * g - v)
                state[k][0][at], state[k][1][at] = m, v
                rate = speed * (0.1 if k in ("gram", "word") else 1)
                net.p[k][at] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    back = order[: max(1, len(order) // 5)]
    net.scale = _fit_scale(logits_of(net, [texts[i] for i in back]), y[back])
    return net


def _start_from_odds(net: Net, docs: list[np.ndarray], y: np.ndarray) -> None:
    """Words (by their rows) enter as their smoothed log-odds in the training rows."""
    hits = np.zeros((2, WORDS))
    for ids, label in zip(docs, y):
        hits[int(label), np.unique(ids)] += 1
    total = np.array([(y == 0).sum(), (y == 1).sum()])[:, None]
    rate = (hits + 0.5) / (total + 1)
    seen = hits.sum(axis=0)
    # a word of one or two rows says more about those rows than about words
    sure = np.maximum(seen - 2, 0) / (seen + 3)
    net.p["word"][:, 0] = np.clip(np.log(rate[1] / rate[0]), -4, 4) * sure
    net.p["word"][:, 1] = sure


def _batches(order: list[int], docs: dict[int, np.ndarray], most: int = 12_000) -> Iterator[list[int]]:
    batch: list[int] = []
    held = 0
    for i in order:
        if batch and (len(batch) == 32 or held + len(docs[i]) > most):
            yield batch
            batch, held = [], 0
        batch.append(i)
        held += len(docs[i])
    if batch:
        yield batch


def _fit_scale(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, held near (1, 0) by a prior."""
    a, b = 1.0, 0.0
    x = np.clip(logits.astype(np.float64), -30, 30)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + 2 * (a - 1), (p - y).sum() + 0.5 * b])
        hess = np.array([[(w * x * x).sum() + 2, (w * x).sum()], [(w * x).sum(), w.sum() + 0.5]])
        d = np.linalg.solve(hess, g)
        a, b = max(0.05, a - d[0]), b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(a), float(b)


class _Memo(dict):
    """Rows of projected words; new words wait until a batch's are computed at once."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self) + 1
        self.fresh.append(word)
        return row


class Scorer:
    """A network with a bounded memory of words it has met."""

    def __init__(self, net: Net, most: int = 60_000):
        self.net, self.most = net, most
        self._reset()

    def _reset(self) -> None:
        self.memo, self.table, self.used = _Memo(), np.concatenate([self.net.pad(), np.empty((2, 1024, 3 * HIDDEN), np.float32)], axis=1), 1

    def logits(self, texts: list[str]) -> np.ndarray:
        """The document logits of texts over all their overlapping windows."""
        if len(self.memo) > self.most:
            self._reset()
        docs = [words_of(t) for t in texts]
        flat = np.array([0, *[row for d in docs for row in map(self.memo.__getitem__, d)]])
        if fresh := self.memo.fresh:
            need = self.used + len(fresh)
            if need > self.table.shape[1]:
                self.table = np.concatenate([self.table[:, : self.used], np.empty((2, need, 3 * HIDDEN), np.float32)], axis=1)
            grams, at = _gram_ids(fresh)
            self.table[:, self.used : need] = self.net.project(self.net.inputs(_word_ids(fresh), grams, np.diff(np.append(at, len(grams)))))
            self.used = need
            self.memo.fresh = []
        index, at = _layout([len(d) for d in docs], STRIDE)
        index = flat[index]
        parts = [self.net.forward(self.table, index[i : i + 4096]) for i in range(0, len(index), 4096)]
        return _pool(np.concatenate(parts).astype(np.float64), at)


def logits_of(net: Net, texts: list[str]) -> np.ndarray:
    scorer = Scorer(net)
    return np.concatenate([scorer.logits(texts[i : i + 64]) for i in range(0, len(texts), 64)]) if texts else np.empty(0)


def fit_on(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS
) -> Net:
    """Train on at most ``rows`` labelled documents of ``chars`` characters together,
    picked by a hash of their keys among those that are not held out; each is taken
    whole. Null labels and keys are left out; of several labels for one key the largest
    counts. Without labelled rows the network gives everything one score. Neither the
    texts nor what training needs beside them come to the driver."""
    ids = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_k"), "_k").limit(rows)
    )
    # as many ids as the bound says, so they may be broadcast
    found = docs.select(F.col(key).alias("_k"), text_or_empty(text).alias("_t")).join(F.broadcast(ids), "_k")
    sample = found.orderBy(F.xxhash64("_k"), "_k", "_t").limit(rows)
    so_far = F.sum(F.length("_t")).over(Window.orderBy(F.xxhash64("_k"), "_k", "_t").rowsBetween(Window.unboundedPreceding, 0))
    sample = sample.withColumn("_c", so_far).filter(F.col("_c") <= chars).select("_t", "_y")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        labels: list[int] = []
        for b in batches:
            texts += b.column("_t").to_pylist()
            labels += b.column("_y").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, labels))], pa.binary())], ["net"])

    # the window has put all rows into one partition, in order; a plan known to be empty has none
    made = small_batches(sample).mapInArrow(fit, "net binary").collect()
    return pickle.loads(made[0]["net"]) if made else train([], [])


_SCORERS: dict[int, Scorer] = {}


def score(df: DataFrame, net: Net, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """All columns of ``df`` and ``score`` (0 to 1) and ``predicted``; columns of these
    names are replaced, the others come back as they are, whatever their types. Null
    texts count as empty; a text without words gets the score of one blank window. Rows
    are taken as they are, whole texts in all windows."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    keep = [c for c in df.columns if c not in ("score", "predicted")]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        if id(net) not in _SCORERS:  # one network's words are remembered at a time
            _SCORERS.clear()
            _SCORERS[id(net)] = Scorer(net)
        scorer, (a, b) = _SCORERS[id(net)], net.scale
        for batch in batches:
            for part in byte_slices(batch, text, 400_000):
                logits = scorer.logits([t or "" for t in part.column(text).to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(a * logits + b, -60, 60)))
                made = [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], [*keep, "score", "predicted"])

    return small_batches(df).mapInArrow(run, schema)
