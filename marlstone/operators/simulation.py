"""Seeded simulations. Steps of one run depend on each other; runs don't, and are what is spread."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARMS = (0.3, 0.5, 0.7)


def coins(spark: SparkSession, trials: int, flips: int, p: float = 0.5, seed: int = 0) -> DataFrame:
    """(trial, flip, head)"""
    return spark.range(trials * flips).select(F.floor(F.col("id") / flips).alias("trial"), (F.col("id") % flips).alias("flip"), (F.rand(seed) < p).cast("int").alias("head"))


def dice(spark: SparkSession, n: int, sides: int = 6, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", (F.floor(F.rand(seed) * sides) + 1).cast("int").alias("roll"))


def gaussians(spark: SparkSession, n: int, mean: float, sd: float, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", (F.randn(seed) * sd + mean).alias("x"))


def _rng(seed: int, *key: int) -> np.random.Generator:
    return np.random.default_rng([seed, *[int(k) for k in key]])


def _bet(policy: str, capital: int, goal: int) -> int:
    return min(capital, goal - capital) if policy == "all" else min(int(policy), capital, goal - capital)


def gamblers(starts: DataFrame, goal: int, p: float, policy: str = "1", seed: int = 0, steps: int = 100_000) -> DataFrame:
    """starts: (episode, start). One row for each step: (episode, t, state, action, reward).

    The last row's action is null, its reward 1 at the goal, 0 at nothing. policy: the bet, or
    ``all``. An episode still open after steps bets has a null reward there, so its returns are
    null and means leave it out.
    """

    def run(frames):
        for pdf in frames:
            out = []
            for episode, start in zip(pdf["episode"], pdf["start"], strict=True):
                rng, capital, t = _rng(seed, episode, start), int(start), 0
                while 0 < capital < goal and t < steps:
                    bet = _bet(policy, capital, goal)
                    out.append((episode, t, capital, bet, 0))
                    capital += bet if rng.random() < p else -bet
                    t += 1
                out.append((episode, t, capital, None, None if 0 < capital < goal else int(capital == goal)))
            frame = pd.DataFrame(out, columns=["episode", "t", "state", "action", "reward"])
            yield frame.astype({"action": "Int64", "reward": "Int64"})

    return starts.select(F.col("episode").cast("long"), F.col("start").cast("long")).mapInPandas(run, "episode long, t long, state long, action long, reward long")


def win_rates(spark: SparkSession, goal: int, p: float, trials: int, policy: str = "1", seed: int = 0) -> DataFrame:
    """(state, rate) for every start: a state by trial grid of episodes, then their mean."""
    grid = spark.range((goal - 1) * trials).select(F.col("id").alias("episode"), (F.col("id") % (goal - 1) + 1).alias("start"))
    ends = gamblers(grid, goal, p, policy, seed).where("action is null")
    return ends.join(grid, "episode").groupBy(F.col("start").alias("state")).agg(F.avg("reward").alias("rate"))


def returns(episodes: DataFrame) -> DataFrame:
    """episodes with g, the rewards from each step on; null if one of them is."""
    w = Window.partitionBy("episode").orderBy("t").rowsBetween(0, Window.unboundedFollowing)
    return episodes.withColumn("g", F.when(F.bool_and(F.col("reward").isNotNull()).over(w), F.sum("reward").over(w)))


def last_visits(episodes: DataFrame) -> DataFrame:
    """Of each state of an episode the visit that a scan from the end meets first, that is the last."""
    r = F.row_number().over(Window.partitionBy("episode", "state").orderBy(F.col("t").desc()))
    return episodes.withColumn("__r", r).where("__r = 1").drop("__r")


def first_visits(episodes: DataFrame) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("episode", "state").orderBy("t"))
    return episodes.withColumn("__r", r).where("__r = 1").drop("__r")


def mc_values(episodes: DataFrame) -> DataFrame:
    """(state, v, n): mean return after the last visit, over episodes; terminal rows are left out."""
    return last_visits(returns(episodes).where("action is not null")).groupBy("state").agg(F.avg("g").alias("v"), F.count("*").alias("n"))


def transitions(episodes: DataFrame) -> DataFrame:
    """episodes with the next state and action."""
    w = Window.partitionBy("episode").orderBy("t")
    return episodes.withColumn("next_state", F.lead("state").over(w)).withColumn("next_action", F.lead("action").over(w))


def bandits(spark: SparkSession, runs: int, pulls: int, kind: str, arms=ARMS, epsilon: float = 0.1, seed: int = 0) -> DataFrame:
    """(run, t, arm, reward) of runs independent bandits: kind is epsilon, ucb or thompson."""

    def play(frames):
        k = len(arms)
        for pdf in frames:
            for run in pdf["id"]:
                rng = _rng(seed, run)
                n, mean = np.zeros(k), np.zeros(k)
                chosen, paid = np.zeros(pulls, np.int64), np.zeros(pulls, np.int64)
                for t in range(pulls):
                    if kind == "epsilon":
                        best = np.flatnonzero(mean == mean.max())
                        arm = int(rng.integers(k)) if rng.random() < epsilon else int(rng.choice(best))
                    elif kind == "ucb":
                        arm = t if t < k else int(np.argmax(mean + np.sqrt(2 * np.log(t + 1) / n)))
                    elif kind == "thompson":
                        arm = int(np.argmax(rng.beta(1 + mean * n, 1 + n - mean * n)))
                    else:
                        raise ValueError(f"unknown kind {kind}")
                    reward = int(rng.random() < arms[arm])
                    n[arm] += 1
                    mean[arm] += (reward - mean[arm]) / n[arm]
                    chosen[t], paid[t] = arm, reward
                yield pd.DataFrame({"run": run, "t": np.arange(pulls), "arm": chosen, "reward": paid})

    return spark.range(runs).mapInPandas(play, "run long, t long, arm long, reward long")


def arm_summary(history: DataFrame) -> DataFrame:
    """(arm, pulls, mean): counts and mean reward of each arm."""
    return history.groupBy("arm").agg(F.count("*").alias("pulls"), F.avg("reward").alias("mean"))


def running(history: DataFrame, run: str, t: str, reward: str) -> DataFrame:
    """history with the running total and the running (incremental) mean."""
    w = Window.partitionBy(run).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumns({"total": F.sum(reward).over(w), "running_mean": F.avg(reward).over(w)})


def td0(spark: SparkSession, runs: int, goal: int, p: float, episodes: int, rate: float = 0.05, seed: int = 0) -> DataFrame:
    """(run, state, v): one-step temporal differences on the bet-one gambler, a learner a run."""

    def learn(frames):
        for pdf in frames:
            for run in pdf["id"]:
                rng, v = _rng(seed, run), np.zeros(goal + 1)
                for _ in range(episodes):
                    s = int(rng.integers(1, goal))
                    while 0 < s < goal:
                        t = s + (1 if rng.random() < p else -1)
                        v[s] += rate * ((1.0 if t == goal else 0.0) + (v[t] if 0 < t < goal else 0.0) - v[s])
                        s = t
                yield pd.DataFrame({"run": run, "state": np.arange(1, goal), "v": v[1:goal]})

    return spark.range(runs).mapInPandas(learn, "run long, state long, v double")


def control(spark: SparkSession, runs: int, grid: list[tuple[int, int, int, float]], start: int, goal: int, kind: str, episodes: int = 1000, rate: float = 0.1, gamma: float = 0.9, epsilon: float = 0.1, seed: int = 0, steps: int = 1000) -> DataFrame:
    """(run, s, action, q) by sarsa or q_learning on grid rows (s, action, t, reward), a learner a run."""

    def learn(frames):
        table = {(s, a): (t, r) for s, a, t, r in grid}
        states, k = max(s for s, _ in table) + 1, max(a for _, a in table) + 1
        for pdf in frames:
            for run in pdf["id"]:
                rng, q = _rng(seed, run), np.zeros((states, k))

                def choose(s, rng=rng, q=q):
                    if rng.random() < epsilon:
                        return int(rng.integers(k))
                    return int(rng.choice(np.flatnonzero(q[s] == q[s].max())))

                for _ in range(episodes):
                    s = start
                    a = choose(s)
                    for _ in range(steps):
                        if s == goal:
                            break
                        t, r = table[s, a]
                        b = choose(t)
                        ahead = 0.0 if t == goal else (q[t, b] if kind == "sarsa" else q[t].max())
                        q[s, a] += rate * (r + gamma * ahead - q[s, a])
                        s, a = t, b
                yield pd.DataFrame({"run": run, "s": np.repeat(np.arange(states), k), "action": np.tile(np.arange(k), states), "q": q.ravel()})

    return spark.range(runs).mapInPandas(learn, "run long, s long, action long, q double")


def mc_control(spark: SparkSession, runs: int, goal: int, p: float, episodes: int, seed: int = 0) -> DataFrame:
    """(run, state, action, q, n): Monte Carlo control with exploring starts on the gambler, a learner a run."""

    def learn(frames):
        for pdf in frames:
            for run in pdf["id"]:
                rng = _rng(seed, run)
                q, n = np.zeros((goal + 1, goal + 1)), np.zeros((goal + 1, goal + 1))
                for _ in range(episodes):
                    s = int(rng.integers(1, goal))
                    a = int(rng.integers(1, min(s, goal - s) + 1))
                    seen = []
                    while 0 < s < goal:
                        seen.append((s, a))
                        s += a if rng.random() < p else -a
                        if 0 < s < goal:
                            a = 1 + int(np.argmax(q[s, 1 : min(s, goal - s) + 1]))
                    for x in dict.fromkeys(seen):
                        n[x] += 1
                        q[x] += ((s == goal) - q[x]) / n[x]
                at = [(s, a) for s in range(1, goal) for a in range(1, min(s, goal - s) + 1)]
                yield pd.DataFrame({"run": run, "state": [s for s, _ in at], "action": [a for _, a in at], "q": [q[x] for x in at], "n": [int(n[x]) for x in at]})

    return spark.range(runs).mapInPandas(learn, "run long, state long, action long, q double, n long")
