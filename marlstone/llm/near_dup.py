"""Near-duplicates by BagMinHash: weighted-Jaccard signatures, banding, verified multiset overlap.

A text is the multiset of its runs of five words (a text of one to four words: of all its words).
Its signature has ``registers`` registers. Every element d is given a family of Poisson processes
over weight and time, the same wherever d occurs: the weight axis is cut into [0,1), [1,2),
[2,4), [4,8), ..., and each interval has a process of a rate equal to its length, whose points
have a time, a register and a place in the interval. A text in which d occurs w times sees the
points placed below w. A register holds the earliest point seen; two texts agree in a register
with the probability of their weighted Jaccard similarity. Points come in order of time, so a
process is followed only until it is later than every register: about registers x ln(registers)
points a text beyond the first of each element, instead of registers x elements. Times are whole
numbers (units of 2**-32), so a signature depends on its text's words alone: not on the batch,
the partitioning or the order in which points are summed.

Texts with the same words are one node of the graph. Bands of ``rows`` registers put nodes into
buckets; nodes of one bucket are candidates, and a link is a verified overlap of at least 4/5.
With 32 bands of 6 registers a pair at similarity 0.8 shares a bucket with probability 0.99994.
Buckets aren't expanded into all pairs. Of buckets with the same nodes one is kept. Each compares
its smallest node with the others; then, in rounds, components are formed and

* a bucket whose nodes are all connected is done;
* a node goes from a bucket in which it can't have a partner: an overlap is at most the number of
  its elements that any other remaining node has too, which one count of all elements bounds;
* the others compare a few pivots (eight times as many each round) with the nodes of other
  components that the same bound and that on lengths allow; the pivots are done then.

So every pair of a bucket is compared, connected otherwise or too different by an exact bound, and
classes are those of all links between bucket mates. What stays quadratic is a bucket of
many texts without links whose elements nearly all recur among them. The joins of whole
tables (texts, buckets, bags) are merge joins at every size, which adaptive execution splits
where a key is hot.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm import words as W
from marlstone.llm.components import components
from marlstone.session import cut, scope

SHINGLE = 5
BANDS, ROWS = 32, 6
THRESHOLD = (4, 5)
PIVOTS = 16
GROWTH = 8  # of the pivots from round to round
UNIT = 2.0**32  # of a point's time
NONE = np.iinfo(np.int64).max  # the time of a register that no point has reached
SIGNATURE = "node binary, n long, bands array<long>"


def elements(h: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of every occurrence; bounds: where each text's words begin."""
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    sh = W.shingles(h, size)
    inside = doc[: len(sh)] == doc[size - 1 :] if len(sh) else np.zeros(0, bool)
    docs, ids = [doc[: len(sh)][inside]], [sh[inside]]
    for k in range(1, size):  # short texts whole
        short = np.flatnonzero(n == k)
        if len(short):
            v = np.zeros(len(short), np.uint64)
            for j in range(k):
                v = v * np.uint64(0x100000001B3) + h[bounds[short] + j]
            docs.append(short)
            ids.append(W.mix(v + np.uint64(k)))
    return np.concatenate(docs), np.concatenate(ids)


def bag(doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle), sorted, with how often each occurs."""
    order = np.lexsort((ids, doc))
    doc, ids = doc[order], ids[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (ids[1:] != ids[:-1])
    at = np.flatnonzero(first)
    return doc[at], ids[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, ids: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """texts x m registers: times of the earliest points, NONE where a text has no elements."""
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0) + 1
    src = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(src)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    share = np.floor(np.minimum((weight[src] - low) / width, 1.0) * 2.0**32).astype(np.uint64)  # of the interval that lies below the weight
    halved = np.maximum(level - 1, 0)  # a process of twice the rate has half the gaps
    seed = W.mix(ids[src] ^ W.mix(level.astype(np.uint64) + np.uint64(0x51ED27)))
    d, t = doc[src], np.zeros(len(src), np.int64)
    held = np.full(texts * m, NONE)
    latest = np.full(texts, NONE)
    i = 0
    while len(d):
        k = 1 if len(d) > 4096 else 16 if len(d) > 256 else 128  # points at a time: any number gives the same sums
        step = np.arange(i + 1, i + k + 1, dtype=np.uint64)
        a = W.mix(seed[:, None] + step[None, :] * np.uint64(0x9E3779B97F4A7C15))
        gap = np.rint(-np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * UNIT).astype(np.int64)
        times = t[:, None] + np.cumsum(gap >> halved[:, None], 1)
        b = W.mix(a ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        register = ((b >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        seen = (times < latest[d][:, None]) & ((b & np.uint64(0xFFFFFFFF)) < share[:, None])
        np.minimum.at(held, (d[:, None] * m + register.astype(np.int64))[seen], times[seen])
        u = np.unique(d)
        latest[u] = held.reshape(texts, m)[u].max(1)
        live = times[:, -1] < latest[d]
        d, t, halved, share, seed = d[live], times[live, -1], halved[live], share[live], seed[live]
        i += k
    return held.reshape(texts, m)


def _signer(size: int, bands: int, rows: int):
    def sign(text: pa.Array) -> pa.Array:
        data, at = W.utf8(text)
        nodes, counts, held = [], [], []
        for lo, hi in W.groups(at):
            h, _, _, bounds = W.words(data, at[lo : hi + 1])
            n = np.diff(bounds)
            doc, ids, weight = bag(*elements(h, bounds, size))
            sig = signatures(doc, ids, weight, hi - lo, bands * rows).view(np.uint64).reshape(hi - lo, bands, rows)
            v = np.zeros((hi - lo, bands), np.uint64) + np.arange(bands, dtype=np.uint64)
            for j in range(rows):
                v = W.mix(v * np.uint64(0x100000001B3) + sig[:, :, j])
            held.append(v.view(np.int64).reshape(-1))
            counts.append(np.bincount(doc, weight, hi - lo).astype(np.int64))
            raw = h.tobytes()
            for k in range(hi - lo):
                nodes.append(hashlib.blake2b(raw[8 * bounds[k] : 8 * bounds[k + 1]], digest_size=16).digest() if n[k] else None)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        flat = np.concatenate(held) if held else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), pa.array(flat))
        return pa.StructArray.from_arrays([pa.array(nodes, pa.binary()), pa.array(count), lists], ["node", "n", "bands"])

    return sign


def _bagger(size: int):
    def bags(text: pa.Array) -> pa.Array:
        """Each text's occurrences as sorted distinct values: shingle and number of the occurrence."""
        data, at = W.utf8(text)
        values, counts = [], []
        for lo, hi in W.groups(at):
            h, _, _, bounds = W.words(data, at[lo : hi + 1])
            doc, ids, weight = bag(*elements(h, bounds, size))
            number = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            v = W.mix(np.repeat(ids, weight) + number.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            values.append(v.view(np.int64))
            counts.append(np.bincount(np.repeat(doc, weight), minlength=hi - lo))
        flat = np.concatenate(values) if values else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
        return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.int64()))

    return bags


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
            threshold: tuple[int, int] = THRESHOLD, pivots: int = PIVOTS) -> DataFrame:
    """(k, t, node, root, class_id, class_size), a row a row of docs: its key and its text's hash.

    ``node`` names a text's words, ``root`` the class; ``class_id`` is the class's smallest key
    (null if all are null). Rows with equal words are of one class, whatever their keys. A null
    text or one without words is a class of its own (node, root null, class_id its key).
    """
    with scope(docs.sparkSession):
        return _classes(docs, key, text, size, bands, rows, threshold, pivots)


def _classes(docs: DataFrame, key: str, text: str, size: int, bands: int, rows: int, threshold: tuple[int, int], pivots: int) -> DataFrame:
    signed = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), F.arrow_udf(_signer(size, bands, rows), SIGNATURE)(F.col(text)).alias("s"))
    signed = cut(signed.select("k", "t", "s.node", "s.n", "s.bands"), "signed")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("k", "t")).alias("at"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = cut(nodes, "nodes")
    members = _members(nodes)
    bags = _bags(docs, key, text, size, signed, nodes, members)
    links = _links(members.where("node <> least"), bags, threshold)
    roots = components(links)
    live = members.where("node <> least and c > 2").join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("root"))
    n = None  # rows of the open buckets
    while True:
        rest = _open(live, n)
        if not (n := rest.count()):
            return _placed(signed, roots)
        bags = cut(bags.hint("merge").join(rest.select("node").distinct(), "node", "left_semi"), "bags")
        rest = _possible(rest, bags, threshold, n)
        rest = rest.withColumn("chosen", (F.col("c") <= pivots) | (F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / pivots)) == 0))
        links = cut(_verified(_pairs(rest, threshold), bags, threshold, "ra", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        live = rest.where("not chosen").select("bucket", "node", "n", "root")
        if not links.isEmpty():
            up = components(links).select(F.col("node").alias("root"), F.col("root").alias("__up"))
            alone = up.select(F.col("root").alias("node"), "root")
            roots = _raised(roots.unionByName(alone).distinct(), up)
            live = _raised(live, up, n)
        pivots *= GROWTH


def _raised(df: DataFrame, up: DataFrame, rows: int | None = None) -> DataFrame:
    return cut(df.join(up, "root", "left").withColumn("root", F.coalesce("__up", "root")).drop("__up"), "raised", rows=rows)


def _members(nodes: DataFrame) -> DataFrame:
    """(bucket, node, n, least, least_n, c): the buckets of two nodes or more, one of those with the same nodes."""
    buckets = nodes.select("node", "n", F.posexplode("bands").alias("band", "h")).select("node", "n", F.xxhash64("band", "h").alias("bucket"))
    shared = cut(buckets.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    members = cut(buckets.hint("merge").join(shared, "bucket"), "shared")
    marks = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    named = members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("at"), F.count("*").alias("c"), *marks)
    first = cut(named.groupBy("c", "x", "y").agg(F.min(F.struct("bucket", "at")).alias("f")).select("f.bucket", "f.at"), "shared")
    return cut(members.join(first, "bucket").select("bucket", "node", "n", "c", F.col("at.node").alias("least"), F.col("at.n").alias("least_n")), "members")


def _bags(docs: DataFrame, key: str, text: str, size: int, signed: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(node, bag) of the nodes of members, each from one row of docs."""
    same = [F.col("b.t") == F.col("d.t"), F.col("b.k").eqNullSafe(F.col("d.k"))]
    repeated = signed.groupBy("k", "t").agg(F.count("*").alias("c")).where("c > 1").alias("d")
    wanted = nodes.select("node", "at.k", "at.t").join(members.select("node").distinct(), "node", "left_semi").alias("b")
    wanted = cut(wanted.join(repeated, same, "left").select("node", "b.k", "b.t", F.col("c").isNotNull().alias("again")), "wanted")
    texts = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("t"), F.col(text).alias("x"))

    def found(again: str) -> DataFrame:
        met = wanted.where(again).alias("b").hint("merge").join(texts.alias("d"), same)
        return met.select("node", F.arrow_udf(_bagger(size), "array<long>")(F.col("x")).alias("bag"))

    out = cut(found("not again"), "bags")
    if wanted.where("again").isEmpty():
        return out
    return cut(out.unionByName(found("again").dropDuplicates(["node"])), "bags")


def _alike(overlap: Column, a: str, b: str, threshold: tuple[int, int]) -> Column:
    """Whether bags of a and b elements with that overlap have the similarity p/q."""
    p, q = threshold
    return (p + q) * overlap >= p * (F.col(a) + F.col(b))


def _verified(pairs: DataFrame, bags: DataFrame, threshold: tuple[int, int], *more: str) -> DataFrame:
    both = pairs.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("x")), "a").join(bags.select(F.col("node").alias("b"), F.col("bag").alias("y")), "b")
    return both.where(_alike(F.size(F.array_intersect("x", "y")), "na", "nb", threshold)).select("a", "b", *more)


def _links(members: DataFrame, bags: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Of each bucket the links of its smallest node."""
    pairs = members.where(_alike(F.least("n", "least_n"), "n", "least_n", threshold))
    pairs = pairs.select(F.col("least").alias("a"), F.col("least_n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb")).distinct()
    return cut(_verified(pairs, bags, threshold), "links")


def _open(live: DataFrame, rows: int | None) -> DataFrame:
    """The rows of buckets with nodes of several components, with the number of rows and the smallest bag."""
    many = live.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"), F.min("n").alias("least_n")).where("lo <> hi")
    return cut(live.join(cut(many.drop("lo", "hi"), "open", rows=rows), "bucket"), "rest", rows=rows)


def _possible(rest: DataFrame, bags: DataFrame, threshold: tuple[int, int], rows: int) -> DataFrame:
    """(bucket, node, n, root, most, buckets, c): rest without the rows that can't have a partner.

    ``most``: the elements a node shares with any other at most; ``buckets``: all of the node's;
    ``c``: the rows in the largest of them.
    """
    tokens = bags.select("node", F.explode("bag").alias("e"))
    own = tokens.groupBy("e").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    own = cut(own.groupBy("node").agg(F.count("*").alias("own")), "own", rows=rows)
    found = rest.join(own, "node", "left").withColumn("most", F.col("n") - F.coalesce("own", F.lit(0)))
    found = cut(found.where(_alike(F.col("most"), "n", "least_n", threshold)).select("bucket", "node", "n", "root", "c", "most"), "possible", rows=rows)
    lists = found.groupBy("node").agg(F.collect_list("bucket").alias("buckets"), F.max("c").alias("c"))  # one bucket a band at most
    return cut(found.drop("c").join(lists, "node"), "possible", rows=rows)


def _pairs(rest: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Chosen nodes with their buckets' nodes of other components, where the bounds allow a link.

    A pair comes once: from the first of its common buckets and, of two chosen nodes, from the smaller.
    """
    names = ("node", "n", "root", "most", "buckets")
    one = rest.where("chosen").select("bucket", *(F.col(x).alias(f"p_{x}") for x in names))
    other = (F.col("p_root") != F.col("root")) & (~F.col("chosen") | (F.col("p_node") < F.col("node")))
    possible = _alike(F.least("p_most", "most"), "p_n", "n", threshold)
    first = F.array_min(F.array_intersect("p_buckets", "buckets")) == F.col("bucket")
    met = one.join(rest.select("bucket", *names, "chosen"), "bucket").where(other & possible & first)
    return met.select(F.col("p_node").alias("a"), F.col("p_n").alias("na"), F.col("p_root").alias("ra"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"))


def _placed(signed: DataFrame, roots: DataFrame) -> DataFrame:
    named = signed.select("k", "t", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named, "named", keep=True)
    by = cut(named.where("root is not null").groupBy("root").agg(F.min("k").alias("class_id"), F.count("*").alias("class_size")), "sizes", keep=True)
    out = named.join(by, "root", "left")
    alone = F.col("root").isNull()
    return out.select("k", "t", "node", "root", F.when(alone, F.col("k")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of docs for each class, the one with the smallest key, columns unchanged.

    Rows that agree in key and text are one document; of repeated rows one is kept (the smallest
    hash of its columns). All rows without words are kept.
    """
    found = classes(docs, key, text, **how)
    # rows without words stay with all their copies
    wordless = found.where("root is null").select("k", "t").distinct().withColumn("__all", F.lit(True))
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("k").isNull(), "k", "t")).alias("at")).select("at.k", "at.t", F.lit(False).alias("__all"))
    on = ["__t", "__k", "__none"]  # a key that may be null, for an equality join
    keyed = lambda df, k, t: df.withColumns({"__t": F.coalesce(t, F.lit(0)), "__k": F.coalesce(k, F.lit(0)), "__none": k.isNull()})
    wanted = keyed(first.unionByName(wordless), F.col("k"), F.col("t")).select(*on, "__all")
    rows = keyed(docs, F.col(key), F.xxhash64(F.col(text)))
    told = [f.name for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    out = rows.join(wanted, on).withColumn("__copy", F.row_number().over(Window.partitionBy(*on).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in told]))))
    return out.where("__all or __copy = 1").select(*docs.columns)
