"""Finite decision processes as relations: transitions, synchronous sweeps, greedy policies.

States are rows; a sweep is one join and one aggregation. The state space is held once in a
packed row when it is small (``solve``), or swept as tables whose lineage is cut in the shared
folder every few sweeps (``sweep_values``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.session import cut

# Moves in order (row, column): up, down, left, right (fixed values).
MOVES = [(-1, 0), (1, 0), (0, -1), (0, 1)]
THETA = 1e-4
TOLERANCE = 1e-8


def grid_transitions(spark: SparkSession, rows: int, cols: int, stop: list[tuple[int, int]], reward: Column) -> DataFrame:
    """(s, action, t, reward) of a walled grid: s and t number cells by row; stop cells keep to themselves at reward 0.

    reward: a Column over t_stop (whether the target is a stop cell) and t.
    """
    stops = [r * cols + c for r, c in stop]
    moves = F.array(*[F.struct(F.lit(i).alias("action"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for i, (a, b) in enumerate(MOVES)])
    cells = spark.range(rows * cols).select(F.col("id").cast("int").alias("s"), F.inline(moves))
    r, c = F.floor(F.col("s") / cols) + F.col("dr"), F.col("s") % cols + F.col("dc")
    inside = r.between(0, rows - 1) & c.between(0, cols - 1)
    at_stop = F.col("s").isin(stops) if stops else F.lit(False)
    t = F.when(at_stop | ~inside, F.col("s")).otherwise(r * cols + c).cast("int")
    out = cells.withColumn("t", t).withColumn("t_stop", F.col("t").isin(stops))
    return out.select("s", "action", "t", F.when(at_stop, F.lit(0)).otherwise(reward).cast("double").alias("reward"))


def walk_grid(spark: SparkSession) -> DataFrame:
    """4 x 4, stops in two corners; entering one costs nothing, any other move 1."""
    return grid_transitions(spark, 4, 4, [(0, 0), (3, 3)], F.when(F.col("t_stop"), 0).otherwise(-1))


def cliff_grid(spark: SparkSession) -> DataFrame:
    """3 x 4, goal at (0, 3) for +10, a cliff at (1, 2) for -10, any other move -1."""
    return grid_transitions(spark, 3, 4, [(0, 3)], F.when(F.col("t") == 1 * 4 + 2, -10).when(F.col("t_stop"), 10).otherwise(-1))


def q_values(transitions: DataFrame, values: DataFrame, gamma: float) -> DataFrame:
    """(s, action, q): reward plus the discounted value of the target, 0 where it has none."""
    v = values.select(F.col("s").alias("t"), F.col("v").alias("__v"))
    return transitions.join(v, "t", "left").select("s", "action", (F.col("reward") + gamma * F.coalesce("__v", F.lit(0.0))).alias("q"))


def greedy(q: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(s, action): the first action within tolerance of the best."""
    best = F.max("q").over(Window.partitionBy("s"))
    return q.withColumn("__b", best).where(F.abs(F.col("q") - F.col("__b")) < tolerance).groupBy("s").agg(F.min("action").alias("action"))


def sweep_values(transitions: DataFrame, policy: DataFrame | None = None, gamma: float = 1.0, theta: float = THETA, most: int = 1000, block: int = 4) -> DataFrame:
    """(s, v) by synchronous sweeps until no value moves by theta: of a policy (s, action, prob), or the best.

    Several sweeps run as one plan; then values are written to the shared folder and compared.
    Fails if they still move after most sweeps.
    """
    values = transitions.select("s").distinct().withColumn("v", F.lit(0.0))
    moves = cut(transitions if policy is None else transitions.join(policy, ["s", "action"]), "moves")
    for _ in range(-(-most // block)):
        last = values
        for _ in range(block):
            last, values = values, _sweep(moves, values, policy is not None, gamma)
        both = cut(values.join(last.withColumnRenamed("v", "w"), "s"), "values")
        values = both.select("s", "v")
        if (both.agg(F.max(F.abs(F.col("v") - F.col("w")))).first()[0] or 0.0) < theta:
            return values
    raise RecursionError(f"values still move by {theta} or more after {most} sweeps")


def _sweep(moves: DataFrame, values: DataFrame, averaged: bool, gamma: float) -> DataFrame:
    v = values.select(F.col("s").alias("t"), F.col("v").alias("__v"))
    q = F.col("reward") + gamma * F.coalesce("__v", F.lit(0.0))
    joined = moves.join(v, "t", "left")
    return joined.groupBy("s").agg((F.sum(F.col("prob") * q) if averaged else F.max(q)).alias("v"))


def solve(transitions: DataFrame, gamma: float = 1.0, sweeps: int = 200, theta: float = THETA) -> DataFrame:
    """(s, v) by value iteration in one plan, for a state space that fits in one row (a stated, checked 4096 states).

    With a column prob the values are those of that policy instead of the best. The transitions
    are packed by state and swept in the JVM; no job, shuffle or Python a sweep. A query of it
    fails if one more sweep would move a value by theta or more.
    """
    n = transitions.agg(F.max("s")).first()[0]
    if n is None or n > 4095:
        raise ValueError("solve() is for at most 4096 states; sweep_values() has no limit")
    averaged = "prob" in transitions.columns
    move = F.struct("t", "reward", *(["prob"] if averaged else []))
    packed = transitions.groupBy("s").agg(F.collect_list(move).alias("m")).agg(F.array_sort(F.collect_list(F.struct("s", "m"))).alias("rows"))

    def swept(v):
        q = lambda x: x["reward"] + gamma * F.coalesce(F.get(v, x["t"]), F.lit(0.0))
        if averaged:
            return F.transform("rows", lambda row: F.aggregate(row["m"], F.lit(0.0), lambda acc, x: acc + x["prob"] * q(x)))
        return F.transform("rows", lambda row: F.array_max(F.transform(row["m"], q)))

    out = packed.withColumn("v", F.aggregate(F.sequence(F.lit(1), F.lit(sweeps)), F.transform("rows", lambda r: F.lit(0.0)), lambda acc, _: swept(acc)))
    moved = F.array_max(F.zip_with("v", swept(F.col("v")), lambda a, b: F.abs(a - b)))
    out = out.withColumn("v", F.when(moved < theta, F.col("v")).otherwise(F.raise_error(F.lit(f"values still move by {theta} or more after {sweeps} sweeps")).cast("array<double>")))
    return out.select(F.inline(F.arrays_zip(F.transform("rows", lambda r: r["s"]).alias("s"), "v")))


def policy_iteration(transitions: DataFrame, gamma: float = 1.0, most: int = 50, evaluate=None) -> tuple[DataFrame, DataFrame]:
    """(values, policy): evaluate, improve, until the policy stays.

    evaluate: transitions with prob -> values; packed sweeps by default, for more states than
    those hold lambda t: sweep_values(t, t.select("s", "action", "prob")).
    """
    evaluate = evaluate or (lambda t: solve(t, gamma))
    n = transitions.select("action").distinct().count()
    policy = transitions.select("s", "action").distinct().withColumn("prob", F.lit(1.0 / n))
    held = None
    for _ in range(most):
        values = cut(evaluate(transitions.join(policy, ["s", "action"])), "values")
        better = cut(greedy(q_values(transitions, values, gamma)), "policy")
        now = better.agg(F.sum(F.xxhash64("s", "action").cast("decimal(20,0)"))).first()[0]
        if now == held:
            return values, better
        held, policy = now, better.withColumn("prob", F.lit(1.0))
    raise RecursionError(f"the policy still changes after {most} rounds")


def rendered(policy: DataFrame, cols: int, stop: list[int], symbols: str = "^v<>") -> DataFrame:
    """(row, line): a policy as lines of arrows, * where it stops."""
    sym = F.when(F.col("s").isin(stop), "*").otherwise(F.element_at(F.array(*[F.lit(x) for x in symbols]), F.col("action") + 1))
    cells = policy.select(F.floor(F.col("s") / cols).alias("row"), F.struct(F.col("s").alias("s"), sym.alias("x")).alias("c"))
    return cells.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["x"]), " ").alias("line"))
