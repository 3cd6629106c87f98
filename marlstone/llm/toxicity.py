"""Toxicity by cumulative-link (proportional-odds) ordinal regression.

P(grade <= k | x) = sigmoid(theta_k - w . x), theta_0 < theta_1 < ...: one weight vector serves
every threshold. Features are sparse and binary: which words, and which beginnings of words
(``PREFIXES`` bytes long), a text has. Words are those of marlstone.llm.words. The reported
severity is the expected grade, sum over k of P(grade > k).

Training takes a bounded sample of labelled rows (``SAMPLE`` of each class, the smallest hashes
of the id, and ``SAMPLE_BYTES`` of text); scoring reads every text whole, in one pass without a shuffle.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import words as W
from marlstone.session import Sent

SAMPLE = {"toxic": 2500, "clean": 7500}  # labelled rows to learn from, at most
SAMPLE_BYTES = 48 << 20  # and their text
PREFIXES = (4, 5, 6)
FEATURES = 4096
LEAST = 3  # documents that a feature must occur in
GRADES = 3
RESULT = "severity double, grade int, toxic boolean"


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, of a group of texts: words and beginnings of words."""
    h, s, e, bounds = W.words(data, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    size = e - s
    ids, docs = [h], [doc]
    padded = np.concatenate([data, np.zeros(max(PREFIXES), np.uint8)])
    for n in PREFIXES:
        long = np.flatnonzero(size > n)
        v = np.zeros(len(long), np.uint64)
        for j in range(n):
            v = v << np.uint64(8) | W.FOLD[padded[s[long] + j]].astype(np.uint64)
        ids.append(W.mix(v ^ np.uint64(n << 58)))
        docs.append(doc[long])
    return np.concatenate(docs), np.concatenate(ids)


def bags(texts: Iterable[str | None]) -> list[np.ndarray]:
    """The sorted distinct features of each text, a megabyte of texts at a time."""
    out: list[np.ndarray] = []
    held: list[str] = []

    def flush() -> None:
        data, at = W.utf8(pa.array(held, pa.string()))
        d, f = features(data, at)
        order = np.lexsort((f, d))
        d, f = d[order], f[order]
        first = np.ones(len(d), bool)
        first[1:] = (d[1:] != d[:-1]) | (f[1:] != f[:-1])
        d, f = d[first], f[first]
        out.extend(x.copy() for x in np.split(f, np.searchsorted(d, np.arange(1, len(held)))))
        held.clear()

    size = 0
    for t in texts:
        held.append(t or "")
        size += len(held[-1])
        if size > W.PIECE:
            flush()
            size = 0
    if held:
        flush()
    W.forget()
    return out


class Ordinal:
    """The fitted model: sorted feature hashes, their weights, and the thresholds."""

    def __init__(self, keys, weights, theta):
        self.keys, self.weights, self.theta = keys, weights, theta

    def severity(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the most that can be said of P(grade > 0)."""
        above = 1 / (1 + np.exp(np.clip(self.theta[None, :] - score[:, None], -500, 500)))
        return above.sum(1), above[:, 0]

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at) - 1)
        if not len(self.keys):
            return out
        for lo, hi in W.groups(at):
            d, f = features(data, at[lo : hi + 1])
            k = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[k] == f)
            pair = np.unique(d[hit] * len(self.keys) + k[hit])  # each feature once a text
            out[lo:hi] = np.bincount(pair // len(self.keys), self.weights[pair % len(self.keys)], hi - lo)
        return out


def chosen(found: list[np.ndarray], toxic: np.ndarray, most: int = FEATURES, least: int = LEAST) -> np.ndarray:
    """The features whose presence tells the classes apart best, by their G statistic."""
    none = [np.zeros(0, np.uint64)]
    u1, k1 = np.unique(np.concatenate(none + [f for f, t in zip(found, toxic, strict=True) if t]), return_counts=True)
    u0, k0 = np.unique(np.concatenate(none + [f for f, t in zip(found, toxic, strict=True) if not t]), return_counts=True)
    uniq = np.union1d(u1[k1 >= -(-least // 2)], u0[k0 >= -(-least // 2)])
    of = lambda u, k: np.where(u[i := np.minimum(np.searchsorted(u, uniq), len(u) - 1)] == uniq, k[i], 0) if len(u) else np.zeros(len(uniq))
    c1, c0 = of(u1, k1).astype(float), of(u0, k0).astype(float)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    seen = c1 + c0
    rate, all_rate = seen / (n1 + n0), (n1 / (n1 + n0), n0 / (n1 + n0))
    part = lambda o, x: np.where(o > 0, o * np.log(np.maximum(o, 1e-12) / np.maximum(x, 1e-12)), 0)
    g = 2 * (part(c1, seen * all_rate[0]) + part(c0, seen * all_rate[1]) + part(n1 - c1, n1 * (1 - rate)) + part(n0 - c0, n0 * (1 - rate)))
    ok = np.flatnonzero((seen >= least) & (g > 15))
    return uniq[np.sort(ok[np.argsort(-g[ok], kind="stable")[:most]])]


def fit(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, width: int, grades: int, penalty: float = 3e-5, steps: int = 500):
    """Weights and thresholds by Adam on the penalised log-likelihood (full batch)."""
    n, k = len(grade), grades - 1
    base = np.cumsum(np.bincount(grade, minlength=grades)[:-1]) / max(n, 1)
    base = np.clip(base, 1e-3, 1 - 1e-3)
    theta = np.log(base / (1 - base))
    gaps = np.log(np.maximum(np.diff(theta), 1e-2))  # theta_0, then log gaps: the order can't break
    p = np.concatenate([np.zeros(width), theta[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    low, high = grade > 0, grade < k
    for step in range(1, steps + 1):
        w = p[:width]
        th = np.concatenate([p[width : width + 1], p[width] + np.cumsum(np.exp(p[width + 1 :]))])
        s = np.bincount(rows, w[cols], n)
        up = np.where(high, sig(th[np.minimum(grade, k - 1)] - s), 1.0)
        down = np.where(low, sig(th[np.maximum(grade - 1, 0)] - s), 0.0)
        mass = np.maximum(up - down, 1e-9)
        du, dd = up * (1 - up) * high / mass, down * (1 - down) * low / mass
        g_s = (du - dd) / n  # of -log mass by s
        g_th = np.zeros(k)
        np.add.at(g_th, np.minimum(grade, k - 1)[high], -du[high] / n)
        np.add.at(g_th, (grade - 1)[low], dd[low] / n)
        g = np.concatenate([np.bincount(cols, g_s[rows], width) + penalty * w / max(1, k), [g_th.sum()], np.exp(p[width + 1 :]) * np.cumsum(g_th[::-1])[::-1][1:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:width], np.concatenate([p[width : width + 1], p[width] + np.cumsum(np.exp(p[width + 1 :]))])


def learn(texts: Iterable[str | None], toxic: list[bool], grade: list[int] | None = None, grades: int = GRADES) -> Ordinal:
    """Fit on labelled texts. grade: 0 for clean, 1.. for toxic ones by severity.

    Where there are no grades they are derived: a toxic text with more telling features than
    the median toxic text (for three grades; other quantiles for more) has the higher grade.
    texts may be an iterator that fills toxic and grade as it goes.
    """
    found = bags(texts)
    toxic = np.array(toxic, bool)
    keys = chosen(found, toxic) if toxic.any() and not toxic.all() else np.zeros(0, np.uint64)
    if not len(keys):
        return Ordinal(keys, np.zeros(0), np.full(grades - 1, 30.0))
    cols = [np.flatnonzero(np.isin(keys, f, assume_unique=True)) for f in found]
    told = np.array([len(x) for x in cols])
    r, c = np.repeat(np.arange(len(cols)), told), np.concatenate(cols)
    if grade is None:
        cuts = np.quantile(told[toxic], np.arange(1, grades - 1) / (grades - 1))
        grade = np.where(toxic, 1 + np.searchsorted(cuts, told, "left"), 0)
    weights, theta = fit(r, c, np.array(grade, np.int64), len(keys), grades)
    return Ordinal(keys, weights, theta)


def fitting(rows: list[tuple[bool, int]], sample: dict, most: int) -> list[bool]:
    """Which of the (toxic, bytes) rows to take in turn: a class has its share of most, as in sample, and what the other leaves.

    A row that doesn't fit is passed over, not the end.
    """
    total = {t: sum(n for x, n in rows if x == t) for t in (True, False)}
    share = most * sample["toxic"] // max(1, sample["toxic"] + sample["clean"])
    left = {t: max(s, most - total[not t]) for t, s in ((True, share), (False, most - share))}
    out = []
    for t, n in rows:
        out.append(n <= left[t])
        left[t] -= n * out[-1]
    return out


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", grade: str | None = None,
          sample: dict | None = None, sample_bytes: int = SAMPLE_BYTES) -> Ordinal:
    """Learn from at most sample labelled rows of each class and sample_bytes of their text.

    Repeated label rows count once; a key with both labels has both.

    Labels and documents meet by key; null keys, labels and texts are left out. Fails where a class
    has texts but each alone is beyond the bytes of its class (see fitting).
    """
    sample = sample or SAMPLE
    extra = [F.col(grade).cast("int").alias("__g")] if grade else [F.lit(0).alias("__g")]
    h = F.xxhash64(F.lit(11), F.col(key).cast("string"))
    marks = labels.select(F.col(key), (F.col(toxic) > 0).alias("__t"), *extra).where(F.col("__t").isNotNull() & F.col(key).isNotNull()).distinct().withColumn("__h", h)
    part = [marks.where(F.col("__t") == t).orderBy("__h", key, "__g").limit(n) for t, n in ((True, sample["toxic"]), (False, sample["clean"]))]
    picked = part[0].unionByName(part[1])
    found = docs.select(key, F.col(text).alias("__x")).where(F.col("__x").isNotNull()).join(F.broadcast(picked), key).select("__x", "__t", "__g", "__h")
    found = found.withColumn("__d", F.xxhash64("__x"))
    row = ["__h", "__d", "__t"]
    sizes = found.groupBy(*row).agg(F.sum(F.octet_length("__x")).alias("n")).orderBy(*row).collect()  # as many as sample at most, but for repeated keys
    kept = fitting([(r["__t"], r["n"]) for r in sizes], sample, sample_bytes)
    lost = {r["__t"] for r in sizes} - {r["__t"] for r, k in zip(sizes, kept, strict=True) if k}
    if lost:
        raise ValueError(f"no text of the class toxic = {sorted(lost)} fits in the training sample of {sample_bytes} bytes")
    if not all(kept):
        few = docs.sparkSession.createDataFrame([tuple(r[c] for c in row) for r, k in zip(sizes, kept, strict=True) if k], "__h long, __d long, __t boolean")
        found = found.join(F.broadcast(few), row)
    marked, graded = [], []

    def texts():
        for r in found.select("__x", "__t", "__g", "__h").orderBy("__h", "__x").toLocalIterator():
            marked.append(r[1])
            graded.append(r[2])
            yield r[0]

    model = learn(texts(), marked, graded if grade else None)
    if len(set(marked)) == 2 and not len(model.keys):
        warnings.warn(f"no feature tells {marked.count(True)} toxic from {marked.count(False)} clean texts: nothing is judged toxic", stacklevel=2)
    # the sample's classes aren't in the labels' proportion: put the thresholds where they would be
    all_ = {r[0]: r[1] for r in marks.groupBy("__t").count().collect()}
    if len(all_) == 2 and len(set(marked)) == 2:
        model.theta = model.theta + np.log(all_[False] / marked.count(False) / (all_[True] / marked.count(True)))
    return model


def _score(model, threshold: float):
    def score(text: pa.Array) -> pa.Array:
        m = model.value
        data, at = W.utf8(text)
        severity, any_grade = m.severity(m.scores(data, at))
        grade = np.rint(severity).astype(np.int32)
        return pa.StructArray.from_arrays([pa.array(severity), pa.array(grade), pa.array(any_grade >= threshold)], ["severity", "grade", "toxic"])

    return score


def scored(docs: DataFrame, model: Ordinal, text: str = "text", threshold: float = 0.5) -> Column:
    """A struct column (RESULT) for each document: expected grade, nearest grade, P(grade > 0) >= threshold.

    A null text, or one without words, has no features: its score is the thresholds' alone.
    """
    return F.arrow_udf(_score(Sent(docs.sparkSession, model), threshold), RESULT)(F.col(text))
