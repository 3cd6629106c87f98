"""Connected components of a graph given as a table of links, by alternating star operations.

Large-star: every node links its larger neighbours to the smallest node it knows. Small-star:
every node links its smaller neighbours, and itself, to the smallest of them. Each is one
aggregation with map-side combining and one plain equality join with it. The first's aggregate is
written to the shared folder, so that adaptive execution can split the join where a node has very
many links; after it a node has one link for each of its neighbours' smallest nodes. Repeated
until nothing changes, every node is linked to the smallest node of its component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut


def _large(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", rows=2 * rows)
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b")


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y"), "b")
    return moved.select(F.inline(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("x").alias("a"), F.col("b").alias("b"))))).where("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of one orderable type. Returns (node, root), a row a node that has a link.

    The root is the smallest node of the component. Nulls, loops and repeated links are ignored.
    """
    e = links.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    seen, rows = None, e.count()
    while True:
        e = cut(_small(_large(e, rows)), "links", rows=2 * rows)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if seen == now:
            break
        seen, rows = now, now["n"]
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
