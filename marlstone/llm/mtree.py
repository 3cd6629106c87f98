"""Exact top-k inner products by best-first search of M-trees.

The top level is a set of pivots spread over a bounded sample (``SAMPLE`` rows, at most ``CELLS``
pivots); every row belongs to the cell of its nearest pivot, and a cell knows its covering radius.
Cells are cut into shards of about ``SHARD_ROWS`` rows, so that no cell, however full, is one
task's; each shard is bulk-loaded into an M-tree and written as one file of pages to the shared
folder. A page holds its entries' pivots (in a leaf: the vectors), covering radii, distances to
the page's own pivot and children. For a query q, with P a page's pivot and p an entry's,

    q.x <= q.p + |q| r            for every x within r of p (Cauchy-Schwarz), and
    q.p <= q.P + |q| d(p, P),

so cells whose bound is below the k-th best score so far aren't opened, and entries whose bound
from the stored distance alone is below it are left out without computing q.p. Cells and pages are
visited in order of their bounds until the best one left can't reach the k-th score; the result
is exact. Scores are integers: components become floor(scale x). Ties go to the smaller id, so
pages that can only tie are visited too.

Queries are the stated set against all rows, in blocks: a block (queries of near cells) reads the
shards that its bounds leave, one at a time, from the shared folder and has its answers complete;
neither queries nor candidates are shuffled to each other. On vectors without clusters the bounds
leave nothing out, and every block reads every shard.
"""

from __future__ import annotations

import heapq
import pickle
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import Sent, cut, scratch

SHARD_ROWS = 8192
PAGE = 256
SCALE = 256
SAMPLE = 4096  # rows that the top level's pivots are chosen from
CELLS = 1024  # pivots of one vector length at most
QUERY_ROWS = 2048  # queries in a block, at most


def _fs(uri: str):
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def build(ids: np.ndarray, x: np.ndarray, page: int = PAGE) -> list[dict]:
    """Pages of an M-tree, the root first. Deterministic: pivots are taken farthest first."""
    pages: list[dict] = []

    def dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((a - b) ** 2).sum(-1), 0))

    todo = [(np.arange(len(ids)), x.mean(0) if len(ids) else np.zeros(x.shape[1]), None)]
    while todo:
        rows, pivot, back = todo.pop()
        number = len(pages)
        if back is not None:
            pages[back[0]]["child"][back[1]] = number
        v = x[rows]
        if len(rows) <= page:
            pages.append({"leaf": True, "at": pivot, "pivot": v, "ids": ids[rows], "apart": dist(v, pivot)})
            continue
        count = min(page, max(2, int(np.ceil(len(rows) / (page // 2)))))
        far, near = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
        chosen, nxt = [], int(np.argmax(dist(v, v.mean(0))))
        for k in range(count):
            d = dist(v, v[nxt])
            chosen.append(nxt)
            near[d < far] = k
            far = np.minimum(far, d)
            nxt = int(np.argmax(far))
            if far[nxt] == 0:
                break
        parts = [np.flatnonzero(near == k) for k in range(len(chosen))]
        if max(map(len, parts)) > 0.9 * len(rows):  # many rows alike: cut them evenly
            order = np.argsort(far, kind="stable")
            parts = [np.sort(p) for p in np.array_split(order, count)]
            chosen = [int(p[0]) for p in parts]
        parts_, pivots, radii = [], [], []
        for c, p in zip(chosen, parts, strict=True):
            if len(p):
                parts_.append(rows[p])
                pivots.append(v[c])
                radii.append(dist(v[p], v[c]).max())
        pv = np.array(pivots)
        pages.append({"leaf": False, "at": pivot, "pivot": pv, "radius": np.array(radii), "apart": dist(pv, pivot), "child": np.zeros(len(pv), np.int64)})
        todo += [(p, pv[k], (number, k)) for k, p in enumerate(parts_)]
    return pages


def search(pages: list[dict], q: np.ndarray, own: int | None, k: int, seen: list[int] | None = None, best: list | None = None) -> list[tuple[int, int]]:
    """The k best (score, id), best first. seen: gets the number of inner products computed.

    best: a heap of (score, -id) of what other trees have given, which is added to.
    """
    norm, computed = float(np.sqrt((q * q).sum())), 1
    best = [] if best is None else best
    eps = 1e-9
    heap = [(-np.inf, 0, float(q @ pages[0]["at"]))]
    while heap:
        bound, number, at = heapq.heappop(heap)
        if len(best) == k and -bound < best[0][0]:
            break
        page = pages[number]
        reach = page["apart"] if page["leaf"] else page["apart"] + page["radius"]
        top = at + norm * reach
        top += eps * (1 + np.abs(top))
        live = np.flatnonzero(top >= best[0][0]) if len(best) == k else np.arange(len(top))
        if not len(live):
            continue
        dots = page["pivot"][live] @ q
        computed += len(live)
        if page["leaf"]:
            ids = page["ids"][live]
            if len(best) == k:
                good = dots >= best[0][0]
                dots, ids = dots[good], ids[good]
            elif len(dots) > 2 * k:  # all that tie with the (k + 1)-th, own row included, or beat it
                good = dots >= np.partition(dots, -k - 1)[-k - 1]
                dots, ids = dots[good], ids[good]
            for score, i in zip(dots.tolist(), ids.tolist(), strict=True):
                if i == own:
                    continue
                item = (int(score), -i)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        else:
            tops = dots + norm * page["radius"][live]
            tops = np.minimum(tops + eps * (1 + np.abs(tops)), top[live])
            for t, d, c in zip(tops.tolist(), dots.tolist(), page["child"][live].tolist(), strict=True):
                if len(best) < k or t >= best[0][0]:
                    heapq.heappush(heap, (-t, c, d))
    if seen is not None:
        seen.append(computed)
    return [(s, -i) for s, i in sorted(best, reverse=True)]


def pivots_of(x: np.ndarray, most: int) -> np.ndarray:
    """At most so many rows of x, each the farthest from those before it; the first is the farthest from the mean."""
    if not len(x):
        return x
    far, chosen, nxt = np.full(len(x), np.inf), [], int(np.argmax(((x - x.mean(0)) ** 2).sum(1)))
    while len(chosen) < most and far[nxt] > 0:
        chosen.append(nxt)
        far = np.minimum(far, ((x - x[nxt]) ** 2).sum(1))
        nxt = int(np.argmax(far))
    return x[chosen]


def _cell(pivots: Sent):
    def cell(v: pa.Array) -> pa.Array:
        """The nearest pivot of each vector; 0 for a length without pivots."""
        size = v.value_lengths().to_numpy(zero_copy_only=False)
        flat = v.flatten().to_numpy(zero_copy_only=False)
        first, out = np.cumsum(size) - size, np.zeros(len(size), np.int32)
        for n in np.unique(size):
            at, p = np.flatnonzero(size == n), pivots.value.get(int(n))
            if p is None or len(p) < 2:
                continue
            x = flat[first[at][:, None] + np.arange(n)]
            for lo in range(0, len(at), 1024):
                y = x[lo : lo + 1024]
                out[at[lo : lo + 1024]] = np.argmin((p * p).sum(1)[None, :] - 2 * (y @ p.T), axis=1)
        return pa.array(out)

    return cell


def _pivot(pivots: dict[int, np.ndarray], dim: int, cell: int) -> np.ndarray:
    return pivots[dim][cell] if len(pivots.get(dim, ())) else np.zeros(dim)


def _builder(folder: str, page: int, pivots: Sent):
    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1)
        fs, path = _fs(folder)
        fs.create_dir(path, recursive=True)
        name = f"{path}/{uuid.uuid4().hex}.pages"
        with fs.open_output_stream(f"{name}.part") as out:
            pickle.dump(build(pdf["id"].to_numpy(), x, page), out, protocol=5)
        fs.move(f"{name}.part", name)
        cell = int(pdf["cell"].iloc[0])
        far = x - _pivot(pivots.value, x.shape[1], cell)
        return pd.DataFrame({"dim": [x.shape[1]], "cell": [cell], "path": [name], "radius": [float(np.sqrt((far * far).sum(1).max()))]})

    return make


def answers(ids: list, x: np.ndarray, centers: np.ndarray, radii: np.ndarray, trees, k: int, seen: list[int] | None = None, opened: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """For each query (row of x, own id) the k best (score, id), best first.

    trees: the M-trees of a cell, by its number, one after the other. opened gets the cells opened.
    """
    norm = np.sqrt((x * x).sum(1))
    bound = x @ centers.T + norm[:, None] * radii[None, :]
    bound += 1e-9 * (1 + np.abs(bound))
    best: list[list] = [[] for _ in ids]
    left = np.ones(len(radii), bool)
    while left.any():
        worst = np.array([b[0][0] if len(b) == k else -np.inf for b in best])
        live = (bound >= worst[:, None]) & left
        if not live.any():
            break
        # the cell that comes first in most queries' own order
        c = int(np.bincount(np.where(live, bound, -np.inf).argmax(1)[live.any(1)], minlength=len(radii)).argmax())
        left[c] = False
        if opened is not None:
            opened.append(c)
        asking = np.flatnonzero(live[:, c])
        for pages in trees(c):
            for i in asking.tolist():
                if len(best[i]) < k or bound[i, c] >= best[i][0][0]:
                    search(pages, x[i], ids[i], k, seen, best[i])
    return [[(s, -j) for s, j in sorted(b, reverse=True)] for b in best]


def _searcher(listed: str, k: int, pivots: Sent, cells: Sent):
    def run(frames):
        for pdf in frames:
            out = []
            for dim, part in pdf.groupby("dim", sort=True):
                numbers, radii = cells.value[int(dim)]
                fs, path = _fs(listed)

                def trees(c, at=f"{path}/dim={dim}/cell=", numbers=numbers, fs=fs):
                    listed = pq.read_table(f"{at}{numbers[c]}", filesystem=fs, columns=["path"], partitioning=None)
                    for name in listed["path"].to_pylist():
                        with fs.open_input_stream(name) as f:
                            yield pickle.loads(f.read())

                centers = np.array([_pivot(pivots.value, int(dim), c) for c in numbers])
                x = np.array(part["v"].tolist(), np.float64).reshape(len(part), -1)
                for lo in range(0, len(part), QUERY_ROWS):
                    ids = part["id"].tolist()[lo : lo + QUERY_ROWS]
                    for i, found in zip(ids, answers(ids, x[lo : lo + QUERY_ROWS], centers, radii, trees, k), strict=True):
                        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(found)]
            yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"]).astype({"query_id": "int64", "rank": "int32", "vec_id": "int64", "score": "int64"})

    return run


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component."""
    return v.isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def top(vectors: DataFrame, asks: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
        shard_rows: int = SHARD_ROWS, page: int = PAGE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row for which asks holds.

    Candidates are all rows but those with the query's id; only vectors of the query's length
    compare. Rows with a null id or an unusable vector take no part; repeated candidate rows
    count each, repeated queries once. Scores are exact while they stay below 2**53.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("raw"), asks.alias("asks")).where(F.col("id").isNotNull() & usable(F.col("raw")))
    spark = vectors.sparkSession
    whole = F.transform("raw", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    rows = rows.select("id", whole.alias("v"), "asks", F.size("raw").alias("dim"))
    folder, listed = scratch(spark, "mtree"), scratch(spark, "mtree")
    n = rows.count()
    found: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").select("dim", "v").limit(SAMPLE).collect():
        found.setdefault(r.dim, []).append(r.v)
    share = max(1, -(-n // shard_rows)) / max(1, sum(map(len, found.values())))  # shards for each row of the sample
    pivots = Sent(spark, {d: pivots_of(np.array(v, np.float64).reshape(len(v), d), int(min(CELLS, max(1, np.ceil(len(v) * share))))) for d, v in found.items()})
    dealt = cut(rows.withColumn("cell", F.arrow_udf(_cell(pivots), "int")(F.col("v"))), "dealt")
    full = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"))  # as many rows as pivots, and one for each length that the sample lacks
    salted = dealt.join(F.broadcast(full), ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / shard_rows)))
    shards = salted.select("id", "v", "dim", "cell", "salt").groupBy("dim", "cell", "salt").applyInPandas(_builder(folder, page, pivots), "dim int, cell int, path string, radius double")
    shards.write.partitionBy("dim", "cell").parquet(listed)
    kind = "path string, radius double, dim int, cell int"
    radii = spark.read.schema(kind).parquet(listed).groupBy("dim", "cell").agg(F.max("radius").alias("r")).orderBy("dim", "cell").collect()
    cells: dict[int, tuple] = {}
    for r in radii:
        cells.setdefault(r.dim, ([], []))[0].append(r.cell)
        cells[r.dim][1].append(r.r)
    asked = dealt.where("asks").select("id", F.xxhash64("v").alias("h"), "v", "dim", "cell").dropDuplicates(["id", "h"])
    asked = cut(asked, "asked")
    blocks = max(1, min(-(-asked.count() // 64), max(spark.sparkContext.defaultParallelism, -(-asked.count() // QUERY_ROWS))))
    asked = asked.repartitionByRange(blocks, "dim", "cell", "id").select("id", "v", "dim")
    sent = Sent(spark, {d: (c, np.array(r)) for d, (c, r) in cells.items()})
    return asked.mapInPandas(_searcher(listed, k, pivots, sent), "query_id long, rank int, vec_id long, score long")
