"""Benchmark decontamination as a prefix-filtered set join.

Every window of an item (``window`` consecutive words; an item of fewer words is one window) is a
set of shingles that a document must contain whole. At containment 1 the prefix that any match
must share is one token long, so each window is filed under its rarest shingle only. Rarity is
the number of times a shingle occurs in the whole corpus, counted first. Then, for each document:

* prefix tokens: its shingles are looked up among the windows' rarest shingles;
* positional bound: a window whose prefix shingle lies ``offset`` words in has to start that many
  words before the match, inside the document;
* length bound: it has to end inside the document;
* verification: the words themselves are compared, byte for byte.

Benchmark items are a stated query set against all documents. They are taken in blocks of at most
``block_bytes`` text, which are arrays (about ten times their text) in files of the shared folder:
the driver and each task hold one block at a time, however large the benchmark is. Documents
are read once for counting and once for joining, whatever the number of blocks, and never shuffled.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import words as W
from marlstone.session import cut, scratch

WINDOW = 13
SHINGLE = 3
BLOCK_BYTES = 4 << 20

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Lists of (id as a string, text), each list of about block_bytes at most (one item at least)."""
    held, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for r in rows.where(F.col("t").isNotNull()).toLocalIterator():
        n = len(r.t.encode())
        if held and size + n > block_bytes:
            yield held
            held, size = [], 0
        held.append((r.i, r.t))
        size += n
    if held:
        yield held


class Windows:
    """All distinct windows of a block of items, as arrays.

    text: the items' words, lower-cased, a space after each; first: where each begins (and the end);
    shingle: the hash of the run of words that begins there. Windows have a start (word), a length,
    a hash of all their words, and the items at items[has[w] : has[w + 1]].
    """

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        self.ids = sorted({"" if i is None else i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        texts, sizes, shingles = [], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        starts, lengths, hashes, owners, at = [], [], [], [], 0
        for item, text in items:
            data, bounds = W.utf8(pa.array([text], pa.string()))
            h, s, e, _ = W.words(data, bounds)
            n = min(window, len(h))
            if not n:
                continue
            texts.append(b"".join(W.plain(data, a, b) + b" " for a, b in zip(s, e, strict=True)))
            sizes.append(e - s + 1)
            run = W.shingles(h, min(shingle, n))
            shingles += [run, np.zeros(len(h) - len(run), np.uint64)]
            whole = W.shingles(h, n)
            starts.append(at + np.arange(len(whole)))
            hashes.append(whole)
            lengths.append(np.full(len(whole), n))
            owners.append(np.full(len(whole), number["" if item is None else item]))
            at += len(h)
        W.forget()
        none = np.zeros(0, np.int64)
        join = lambda x: np.concatenate([none, *x]).astype(np.int64)
        self.text, self.first, self.shingle = b"".join(texts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(shingles)
        start, length, owner = join(starts), join(lengths), join(owners)
        hash_ = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.lexsort((owner, hash_, length))
        start, length, owner, hash_ = start[order], length[order], owner[order], hash_[order]
        new = np.ones(len(start), bool)
        new[1:] = (length[1:] != length[:-1]) | (hash_[1:] != hash_[:-1])
        for k in np.flatnonzero(~new).tolist():  # equal hashes: almost always equal words
            new[k] = self._words(start[k], length[k]) != self._words(start[k - 1], length[k - 1])
        self.start, self.length, self.hash = start[new], length[new], hash_[new]
        self.has, self.items = np.append(np.flatnonzero(new), len(start)), owner
        self.sizes = sorted({min(shingle, int(n)) for n in set(self.length.tolist())})
        self.width = shingle

    def _words(self, start: int, length: int) -> bytes:
        return self.text[self.first[start] : self.first[start + length]]

    def vocabulary(self) -> np.ndarray:
        """All shingles of windows, sorted."""
        return np.unique(self.shingle)

    def file(self, shingles: np.ndarray, counts: np.ndarray) -> None:
        """File each window under its rarest shingle (ties: the smaller hash, then the earlier); shingles are sorted."""
        of = np.zeros(len(self.shingle), np.int64)
        if len(shingles):
            i = np.minimum(np.searchsorted(shingles, self.shingle), len(shingles) - 1)
            of = np.where(shingles[i] == self.shingle, counts[i], 0)
        offset = np.zeros(len(self.start), np.int64)
        for n in np.unique(self.length):
            w = np.flatnonzero(self.length == n)
            for lo in range(0, len(w), 1 << 16):
                part = w[lo : lo + (1 << 16)]
                at = self.start[part][:, None] + np.arange(n - min(self.width, n) + 1)
                c = of[at]
                offset[part] = np.where(c == c.min(1, keepdims=True), self.shingle[at], np.uint64(2**64 - 1)).argmin(1)
        prefix = self.shingle[self.start + offset]
        self.order = np.argsort(prefix, kind="stable")
        self.offset = offset[self.order]
        self.keys, self.starts, self.sizes_of = np.unique(prefix[self.order], return_index=True, return_counts=True)
        del self.shingle

    def find(self, h: np.ndarray, data: np.ndarray, first: np.ndarray, end: np.ndarray, doc: np.ndarray, bounds: np.ndarray):
        """(window, first word) of every occurrence; doc: each word's document, bounds: each document's words."""
        hits = []
        if not len(self.keys):
            return hits
        for size in self.sizes:
            sh = W.shingles(h, size)
            if not len(sh):
                continue
            k = np.minimum(np.searchsorted(self.keys, sh), len(self.keys) - 1)
            pos = np.flatnonzero(self.keys[k] == sh)
            if not len(pos):
                continue
            k = k[pos]
            many = self.sizes_of[k]
            entry = np.repeat(self.starts[k] - np.cumsum(many) + many, many) + np.arange(many.sum())
            pos = np.repeat(pos, many)
            win = self.order[entry]
            start = pos - self.offset[entry]
            d = doc[pos]
            ok = (start >= bounds[d]) & (start + self.length[win] <= bounds[d + 1])
            win, start = win[ok], start[ok]
            for n in np.unique(self.length[win]):
                w, s = win[self.length[win] == n], start[self.length[win] == n]
                run = np.zeros(len(s), np.uint64)
                for j in range(int(n)):
                    run = run * np.uint64(0x100000001B3) + h[s + j]
                same = W.mix(run + np.uint64(n)) == self.hash[w]
                for x, a in zip(w[same].tolist(), s[same].tolist(), strict=True):
                    if b"".join(W.plain(data, first[a + j], end[a + j]) + b" " for j in range(int(n))) == self._words(self.start[x], n):
                        hits.append((x, a))
        return hits


class File:
    """A dictionary of arrays in a file of the shared folder; a process holds the one it used last."""

    held: tuple = (None, None)

    def __init__(self, path: str):
        self.path = path

    def _at(self):
        uri = "file://" + self.path[5:] if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path
        return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")

    def write(self, value: dict) -> None:
        fs, path = self._at()
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out:
            pickle.dump(value, out, protocol=5)

    def read(self) -> dict:
        if File.held[0] != self.path:
            File.held = (None, None)  # not two at a time
            fs, path = self._at()
            with fs.open_input_stream(path) as f:
                File.held = (self.path, pickle.loads(f.read()))
        return File.held[1]

    def windows(self) -> Windows:
        out = object.__new__(Windows)
        out.__dict__ |= self.read()
        return out


def _counter(parts, sizes):
    """A function of Arrow batches: how often each of the shingles occurs in a partition."""

    def count(batches):
        total: list = [0] * len(parts)
        for b in batches:
            data, at = W.utf8(b.column(0))
            for k, p in enumerate(parts):
                v = p.read()["vocabulary"]
                total[k] += np.zeros(len(v), np.int64)
                for lo, hi in W.groups(at):
                    h, _, _, bounds = W.words(data, at[lo : hi + 1])
                    doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
                    for size in sizes:
                        sh = W.shingles(h, size)
                        sh = sh[doc[: len(sh)] == doc[size - 1 :]] if len(sh) else sh
                        i = np.minimum(np.searchsorted(v, sh), len(v) - 1)
                        total[k] += np.bincount(i[v[i] == sh], minlength=len(v))
        for k, p in enumerate(parts):
            if isinstance(total[k], np.ndarray) and len(seen := np.flatnonzero(total[k])):
                v = p.read()["vocabulary"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(seen), k, np.int32)), pa.array(v[seen].view(np.int64)), pa.array(total[k][seen])],
                    ["block", "shingle", "n"],
                )

    return count


def _judge(held, ratio: int):
    def judge(text: pa.Array) -> pa.Array:
        data, at = W.utf8(text)
        groups = W.groups(at)
        items: list[set] = [set() for _ in range(len(at) - 1)]
        words = np.zeros(len(at) - 1, np.int64)
        spans: list[list] = [[] for _ in groups]  # (first word, words) of each group's hits
        for k in range(max(1, len(held))):  # one block after the other
            win = held[k].windows() if held else None
            for g, (lo, hi) in enumerate(groups):
                h, first, end, bounds = W.words(data, at[lo : hi + 1])
                words[lo:hi] = np.diff(bounds)
                if win is None:
                    continue
                doc = np.repeat(np.arange(hi - lo), np.diff(bounds))
                for x, a in win.find(h, data, first, end, doc, bounds):
                    spans[g].append((a, int(win.length[x])))
                    items[lo + doc[a]].update(win.ids[i] for i in win.items[win.has[x] : win.has[x + 1]].tolist())
        hits = np.zeros(len(at) - 1, np.int64)
        for (lo, hi), found in zip(groups, spans, strict=True):
            if found:
                ends = np.cumsum(words[lo:hi])
                edge = np.zeros(int(ends[-1]) + 1, np.int64)
                for a, n in found:
                    edge[a] += 1
                    edge[a + n] -= 1
                hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                hits[lo:hi] = np.bincount(np.searchsorted(ends, hit, "right"), minlength=hi - lo)
        digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
        columns = [pa.array(words), pa.array(hits), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array((hits > 0) & (ratio * hits >= words))]
        return pa.StructArray.from_arrays(columns, ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return judge


def judged(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    ratio: int = 20,
    block_bytes: int = BLOCK_BYTES,
) -> Column:
    """A struct column (RESULT) for each document of docs.

    ``contaminated`` is n_hit > 0 and ratio * n_hit >= n_words. A null text has no words; a null
    item text or one without words has no windows; equal items count under each of their ids, a
    repeated (id, text) row once, a null id as the empty string. With no windows at all nothing
    is hit. ``items_sha256`` of no items is that of the empty string. Counting runs when this is
    called; the join itself is lazy.
    """
    spark = docs.sparkSession
    folder, held, sizes = scratch(spark, "windows"), [], set()
    for items in blocks(benchmark, item_id, item_text, block_bytes):
        win = Windows(items, window, shingle)
        if len(win.start):
            held.append(tuple(File(f"{folder}/{len(held)}.{kind}") for kind in ("vocabulary", "block", "windows")))
            held[-1][0].write({"vocabulary": win.vocabulary()})
            held[-1][1].write(vars(win))
            sizes |= set(win.sizes)
    if held:
        counted = (
            docs.select(F.col(text).alias("t"))
            .mapInArrow(_counter([v for v, _, _ in held], sorted(sizes)), "block int, shingle long, n long")
            .groupBy("block", "shingle")
            .agg(F.sum("n").alias("n"))
        )
        counted = cut(counted, "shingles")
        for k, (_, block, out) in enumerate(held):
            # as many rows as the block has shingles at most
            found = counted.where(F.col("block") == k).select("shingle", "n").toArrow()
            shingles, n = found["shingle"].to_numpy().view(np.uint64), found["n"].to_numpy()
            order = np.argsort(shingles)
            win = block.windows()
            win.file(shingles[order], n[order])
            out.write(vars(win))
            File.held = (None, None)  # neither kept here nor sent with the functions
    return F.arrow_udf(_judge([out for _, _, out in held], ratio), RESULT)(F.col(text))


def decontaminate(docs: DataFrame, benchmark: DataFrame, quotes: bool = True, **how) -> DataFrame:
    """The documents that aren't ``contaminated``, with their columns unchanged.

    Without quotes those that hold any window of an item go too, however short a part of them it is.
    """
    kept = docs.withColumn("__judged", judged(docs, benchmark, **how))
    return kept.where(~F.col("__judged.contaminated") if quotes else F.col("__judged.n_hit") == 0).drop("__judged")
