"""Operators against plain versions: strings, quantiles, graphs, task graphs, convergence, streams, scratch tables."""

import itertools
import math
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.functions import strings
from marlstone.operators import conformal, dag, dp, graph, sampling
from marlstone.operators import estimators as E
from marlstone.plans import models
from marlstone.session import cut, scope


def plain_jaro(a, b):
    if a == b:
        return 1.0 if a else 0.0
    reach, used, hits = max(0, max(len(a), len(b)) // 2 - 1), set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            hits.append(c)
    if not hits:
        return 0.0
    k = len(hits)
    t = sum(x != y for x, y in zip(hits, [b[j] for j in sorted(used)], strict=True)) // 2
    return (k / len(a) + k / len(b) + (k - t) / k) / 3


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        last = 0
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return row[-1]


def test_bit_parallel_similarities():
    rng = random.Random(3)
    texts = ["", "a", "ab", "ba"] + ["".join(rng.choice("abcdé") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    for a, b in itertools.product(texts, texts):
        assert strings._jaro(a, b) == pytest.approx(plain_jaro(a, b), abs=1e-12)
        if a or b:
            assert strings._indel_ratio(a, b) == pytest.approx(2 * plain_lcs(a, b) / (len(a) + len(b)))
    assert strings._indel_ratio("", "") == 1.0 and strings._indel_ratio(None, "a") is None


@pytest.mark.parametrize("rows", [3, 40, 1 << 18])
@pytest.mark.parametrize("alpha", [0.0, 0.1, 0.5, 0.99])
def test_order_statistic_in_ranges(spark, rows, alpha):
    rng = random.Random(5)
    data = [rng.choice([0.5, 0.5, rng.random(), rng.randint(0, 9)]) for _ in range(400)]
    got = conformal.order_statistic(spark.createDataFrame([(float(x),) for x in data] + [(None,)], "s double"), "s", alpha, rows).first()
    rank = conformal.rank_of(len(data), alpha)
    assert (got.n, got["rank"]) == (400, rank) and got.q == (sorted(data)[rank - 1] if rank <= 400 else math.inf)


def test_order_statistic_of_nothing(spark):
    got = conformal.order_statistic(spark.createDataFrame([], "s double"), "s", 0.1).first()
    assert (got.n, got["rank"], got.q) == (0, 1, math.inf)


def test_parallel_nodes_need_reducers(spark):
    rows = spark.createDataFrame([(1, 2), (2, 5)], "k int, x int")
    one, two = lambda df: df.withColumn("y", F.col("x") + 1), lambda df: df.withColumn("y", F.col("x") * 10)
    with pytest.raises(ValueError, match="no reducer"):
        graph.Graph().parallel("p", [one, two], "k", [["y"], ["y"]])
    g = graph.Graph().parallel("p", [one, two], "k", [["y"], ["y"]], {"y": lambda a, b: a + b}).edge(graph.START, "p").edge("p", graph.END).compile()
    assert sorted(map(tuple, g.invoke(rows).select("k", "x", "y").collect())) == [(1, 2, 23), (2, 5, 56)]


def test_checkpoints_and_a_random_node_agree(spark):
    """A node's rows are computed once: later steps see what the checkpoint holds."""
    g = graph.Graph().node("draw", lambda df: df.withColumn("r", F.rand())).node("copy", lambda df: df.withColumn("s", F.col("r")))
    g.edge(graph.START, "draw").edge("draw", "copy").edge("copy", graph.END).compile()
    out = g.checkpoints(spark.range(20).withColumns({"r": F.lit(None).cast("double"), "s": F.lit(None).cast("double")}))
    drawn = {r.id: r.r for r in out.where("step = 1").collect()}
    assert drawn and all(r.s == drawn[r.id] for r in out.where("step = 2").collect())


def test_task_graph(spark):
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return spark.range(4)

    g = dag.Dag().task("b", lambda a: a.where("id > 1"), ("a",)).task("a", flaky, retries=2)
    results, log = g.run(spark)
    assert log == [("a", 1, "OSError"), ("a", 2, "OSError"), ("a", 3, "ok"), ("b", 1, "ok")] and results["b"].count() == 2
    tries.clear()
    with pytest.raises(OSError):
        dag.Dag().task("a", flaky, retries=1).run(spark)
    with pytest.raises(ValueError, match="unknown"):
        dag.Dag().task("a", flaky, ("z",)).run(spark)


def test_values_that_do_not_converge_are_an_error(spark):
    walk = dp.walk_grid(spark).withColumn("prob", F.lit(0.25))
    with pytest.raises(Exception, match="still move"):
        dp.solve(walk, sweeps=20).collect()
    with pytest.raises(RecursionError, match="still move"):
        dp.sweep_values(dp.walk_grid(spark), walk.select("s", "action", "prob"), most=4)


def test_scopes_delete_their_scratch_tables(spark):
    with scope(spark):
        gone = cut(spark.range(3), "gone")
        with scope(spark):
            inner, outer = cut(spark.range(3), "inner"), cut(spark.range(3), "outer", keep=True)
        assert outer.count() == 3
    paths = [df.inputFiles()[0].removeprefix("file://") for df in (gone, inner, outer)]
    assert not any(os.path.exists(p) for p in paths)
    stays = cut(spark.range(3), "stays")
    assert os.path.exists(stays.inputFiles()[0].removeprefix("file://"))


def test_uniform_draws_and_weights(spark):
    u = [r[0] for r in spark.range(4000).select(sampling.uniform("id", seed=2)).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(sum(u) / 4000 - 0.5) < 0.02 and len(set(u)) > 3990
    pop = spark.range(100).withColumn("g", F.col("id") % 3)
    got = {r.g: r.w for r in E.design_weights(pop, pop.where("id < 30"), ["g"]).collect()}
    assert got == {0: 3.4, 1: 3.3, 2: 3.3}
    assert {r.w for r in E.design_weights(pop, pop.where("id < 25")).collect()} == {4.0}


def bits(rows):
    """Rows as sorted text, which tells -0.0 from 0.0."""
    return sorted(repr(tuple(r)) for r in rows)


@pytest.mark.parametrize("ids", [range(12), range(-7, 5), range(2**62, 2**62 + 12)])
def test_attention_equals_its_sql_bit_by_bit(spark, tmp_path, ids):
    rng = random.Random(4)
    vectors = [[rng.gauss(0, 1e-7) for _ in range(64)] for _ in range(10)] + [None, None]
    rows = [(i, v) for i, v in zip(ids, vectors, strict=True)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = con.execute(models.ORACLES["attention"]).fetchall()
    assert any(math.copysign(1, x) < 0 for r in want for x in r[2] if x == 0)  # negatives that round to nothing
    assert bits(models.QUERIES["attention"](spark, str(tmp_path)).collect()) == bits(want)


def test_rounding_as_in_sql(spark):
    x = [0.0, -0.0, 4e-8, -4e-8, 5e-8, -5e-8, 0.12345675, -0.12345675, 2.5, -1e300, 1e305, -1e305, math.inf, -math.inf, math.nan, None]
    x += [random.Random(i).gauss(0, 1e-6) for i in range(500)]
    got = spark.createDataFrame(list(enumerate(x)), "i int, x double").select("i", E.sql_round(F.col("x"), 7)).orderBy("i").collect()
    con = duckdb.connect()
    assert [repr(r[1]) for r in got] == [repr(con.execute("select round(cast(? as double), 7)", [v]).fetchone()[0]) for v in x]
