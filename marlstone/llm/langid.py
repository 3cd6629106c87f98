"""Language identification by a convolutional network over bytes, trained in numpy.

A text's UTF-8 bytes (A-Z lower-cased) are cut into windows of ``WINDOW`` bytes, the last one
padded; filters of several widths slide over each window, their largest responses (max pooling,
after ReLU) feed one softmax layer. A filter of width w over embedded bytes is a sum of w tables
of 256 rows, one for each place; training adapts the tables. Applying it, places are taken in
pairs, so that two bytes cost one lookup. A text's language is that of the largest mean
log-probability over all its windows, weighted by their bytes, and its score the softmax of those
means.

Training takes a bounded sample of labelled texts (``SAMPLE`` rows of each language, the smallest
hashes of the id) and a few windows of each; prediction reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm import words as W
from marlstone.session import Sent

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SAMPLE = 600
SAMPLE_WINDOWS = 6
UNKNOWN = "und"
RESULT = "lang string, score double"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def windows(data: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows of one text as rows of bytes (0 beyond its end), and the bytes in each."""
    n = max(1, -(-len(data) // size))
    out = np.zeros(n * size, np.uint8)
    out[: len(data)] = _LOWER[data]
    return out.reshape(n, size), np.minimum(size, np.maximum(1, len(data) - size * np.arange(n)))


class Network:
    """tables[w]: (w, 256, filters); bias[w]; out, out_bias: the softmax layer; langs: its classes."""

    def __init__(self, langs: list[str], seed: int = 0, widths=WIDTHS, filters: int = FILTERS):
        rng = np.random.default_rng(seed)
        self.langs, self.widths, self.filters = langs, widths, filters
        self.tables = {w: rng.normal(0, 0.5 / np.sqrt(w), (w, 256, filters)).astype(np.float32) for w in widths}
        self.bias = {w: np.zeros(filters, np.float32) for w in widths}
        self.out = rng.normal(0, 0.1, (len(widths) * filters, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)
        self.pairs: dict = {}

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        """Pooled responses of windows x and where each came from (training)."""
        parts, where = [], {}
        for w in self.widths:
            n = x.shape[1] - w + 1
            r = sum(self.tables[w][j][x[:, j : j + n]] for j in range(w)) + self.bias[w]
            at = r.argmax(1)
            where[w] = at
            parts.append(np.maximum(np.take_along_axis(r, at[:, None], 1)[:, 0], 0))
        return np.concatenate(parts, 1), where

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 700, batch: int = 96, rate: float = 4e-3, decay: float = 1e-4, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.tables.values(), *self.bias.values(), self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(x), min(batch, len(x)))
            b = x[rows]
            h, where = self.pooled(b)
            drop = (rng.random(h.shape) > 0.2) / np.float32(0.8)
            z = (h * drop) @ self.out + self.out_bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = p
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            grads_out, grads_bias = (h * drop).T @ g, g.sum(0)
            dh = (g @ self.out.T) * drop * (h > 0)
            tables, biases = [], []
            for i, w in enumerate(self.widths):
                d = dh[:, i * self.filters : (i + 1) * self.filters].astype(np.float32)
                gt = np.zeros_like(self.tables[w])
                f = np.broadcast_to(np.arange(self.filters), d.shape)
                for j in range(w):
                    np.add.at(gt[j], (np.take_along_axis(b, where[w] + j, 1), f), d)
                tables.append(gt)
                biases.append(d.sum(0))
            for k, (q, grad) in enumerate(zip(params, [*tables, *biases, grads_out, grads_bias], strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                q -= (rate * (1 - step / (steps + 1)) * ((m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * q)).astype(np.float32)

    def paired(self, w: int, j: int) -> np.ndarray:
        """The table of places j and j + 1 together, by 256 x first + second byte."""
        if (w, j) not in self.pairs:
            t = self.tables[w]
            self.pairs[w, j] = (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1)
        return self.pairs[w, j]

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of windows."""
        two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        parts = []
        for w in self.widths:
            n = x.shape[1] - w + 1
            r = None
            for j in range(0, w - 1, 2):
                t = np.take(self.paired(w, j), two[:, j : j + n], axis=0)
                r = t if r is None else np.add(r, t, out=r)
            if w % 2:
                t = np.take(self.tables[w][w - 1], x[:, w - 1 : w - 1 + n], axis=0)
                r = t if r is None else np.add(r, t, out=r)
            parts.append(np.maximum(r.max(1) + self.bias[w], 0))
        z = np.concatenate(parts, 1) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def learn(texts: Iterable[tuple[str, str]], seed: int = 0, each: int = SAMPLE_WINDOWS, **how) -> Network:
    """A network trained on (text, lang) pairs, on windows spread over each text."""
    xs, ys = [], []
    for t, lang in texts:
        x, _ = windows(np.frombuffer(t.encode(), np.uint8))
        pick = np.unique(np.linspace(0, len(x) - 1, each).astype(int))
        xs.append(x[pick])
        ys += [lang] * len(pick)
    known = sorted(set(ys))
    net = Network(known, seed)
    if len(known) > 1:
        net.train(np.concatenate(xs), np.searchsorted(known, ys), **how)
    return net


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Network:
    """Learn from at most sample rows of each language; rows with a null text or lang are left out.

    Rows that agree in key, text and lang are one row, so repeats and shared keys change nothing.
    """
    h = F.xxhash64(F.lit(5), F.col(key).cast("string"), F.xxhash64(F.col(text)))
    told = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = told.select(F.col(lang).alias("l"), h.alias("h"))
    # a few times as many rows as are wanted, by hash, so that no language's rows meet in one task
    many = rows.groupBy("l").agg(F.count("*").alias("n"))  # a row a class of the model
    share = F.shiftrightunsigned("h", 11) * F.lit(2.0**-53)
    rows = rows.join(F.broadcast(many), "l").where(share < F.lit(4.0 * sample) / F.col("n")).select("l", "h").distinct()
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= sample).select("l", "h")
    texts = told.select(F.col(text).alias("t"), F.col(lang).alias("l"), h.alias("h")).join(F.broadcast(best), ["l", "h"]).dropDuplicates(["l", "h"])
    return learn((r.t, r.l) for r in texts.orderBy("h", "l").select("t", "l").toLocalIterator())


def _predict(net):
    def predict(text: pa.Array) -> pa.Array:
        model = net.value
        k = len(model.langs)
        data, at = W.utf8(text)
        sums, sizes = np.zeros((len(at) - 1, max(k, 1))), np.diff(at)
        held, owner, weight = [], [], []

        def flush() -> None:
            if held and k > 1:
                x = np.concatenate(held)
                for lo in range(0, len(x), 128):
                    np.add.at(sums, owner[lo : lo + 128], model.logs(x[lo : lo + 128]) * np.array(weight[lo : lo + 128])[:, None])
            held.clear(), owner.clear(), weight.clear()

        for i in np.flatnonzero(sizes > 0):
            for lo in range(at[i], at[i + 1], 256 * WINDOW):  # a long text in parts
                x, n = windows(data[lo : min(lo + 256 * WINDOW, at[i + 1])])
                held.append(x)
                owner += [i] * len(x)
                weight += n.tolist()
                if len(owner) >= 1024:
                    flush()
        flush()
        mean = sums / np.maximum(sizes, 1)[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        names = model.langs or [UNKNOWN]
        return pa.StructArray.from_arrays([pa.array([names[b] for b in best], pa.string()), pa.array(p[np.arange(len(best)), best])], ["lang", "score"])

    return predict


def predicted(docs: DataFrame, net: Network, text: str = "text") -> Column:
    """A struct column (RESULT). A text that is null or has no letter is ``und`` with score 0."""
    found = F.arrow_udf(_predict(Sent(docs.sparkSession, net)), RESULT)(F.col(text))
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    return F.when(letters, found).otherwise(unknown)
