"""Queries on decision processes, simulations, keyed state, workflows and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import dp, graph, sampling, state
from marlstone.operators import simulation as S
from marlstone.operators.estimators import rounded
from marlstone.session import table
from marlstone.sources import search
from marlstone.streaming import state as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_GRID = """
with recursive a(action, dr, dc) as (values (0, -1, 0), (1, 1, 0), (2, 0, -1), (3, 0, 1)),
t as (select s, action, case when s in ({stop}) or s // {c} + dr not between 0 and {r} - 1 or s % {c} + dc not between 0 and {c} - 1 then s else (s // {c} + dr) * {c} + s % {c} + dc end t from range({n}) g(s), a),
m as (select cast(s as integer) s, action, cast(t as integer) t, cast(case when s in ({stop}) then 0 else {reward} end as double) reward from t)
"""
_WALK = _GRID.format(stop="0, 15", r=4, c=4, n=16, reward="case when t in (0, 15) then 0 else -1 end")
_CLIFF = _GRID.format(stop="3", r=3, c=4, n=12, reward="case when t = 6 then -10 when t = 3 then 10 else -1 end")


@_query("grid_transitions", _WALK + "select * from m")
def grid_transitions(spark, d):
    return dp.walk_grid(spark)


@_query("cliff_transitions", _CLIFF + "select * from m")
def cliff_transitions(spark, d):
    return dp.cliff_grid(spark)


@_query("value_iteration", "select cast(i as integer) s, cast(case when i in (0, 15) then 0 else 1 - least(i // 4 + i % 4, 6 - i // 4 - i % 4) end as double) v from range(16) r(i)")
def value_iteration(spark, d):
    return rounded(dp.sweep_values(dp.walk_grid(spark)), 6)


@_query("value_iteration_packed", "select cast(i as integer) s, cast(case when i in (0, 15) then 0 else 1 - least(i // 4 + i % 4, 6 - i // 4 - i % 4) end as double) v from range(16) r(i)")
def value_iteration_packed(spark, d):
    return rounded(dp.solve(dp.walk_grid(spark)), 6)


def _sweeps(sql: str, update: str, sweeps: int) -> str:
    """SQL for the values after a number of synchronous sweeps, as v(s, v)."""
    return sql + f""", w(k, s, v) as (select 0, s, 0.0::double from (select distinct s from m) union all
  select k + 1, m.s, {update} from m join w on w.s = m.t where k < {sweeps} group by k + 1, m.s),
v as (select s, v from w where k = {sweeps})
"""


_BEST = ", q as (select m.s, action, reward + 0.9 * v q from m join v on v.s = m.t), b as (select *, max(q) over (partition by s) b from q), p as (select s, min(action) action from b where abs(q - b) < 1e-8 group by s)"


@_query("cliff_values", _sweeps(_CLIFF, "max(reward + 0.9 * w.v)", 200) + "select s, round(v, 6) v from v")
def cliff_values(spark, d):
    return rounded(dp.solve(dp.cliff_grid(spark), gamma=0.9), 6)


@_query("policy_evaluation", _sweeps(_WALK, "sum(0.25 * (reward + w.v))", 400) + "select s, round(v, 4) v from v")
def policy_evaluation(spark, d):
    return rounded(dp.solve(dp.walk_grid(spark).withColumn("prob", F.lit(0.25)), sweeps=400), 4)


@_query("policy_iteration", _sweeps(_WALK, "max(reward + 0.9 * w.v)", 200) + _BEST + "select s, round(v, 6) v, action from v join p using (s)")
def policy_iteration(spark, d):
    values, policy = dp.policy_iteration(dp.walk_grid(spark), gamma=0.9)
    return rounded(values.join(policy, "s"), 6)


@_query("greedy_policy", _WALK + """, v as (select i s, case when i in (0, 15) then 0 else 1 - least(i // 4 + i % 4, 6 - i // 4 - i % 4) end v from range(16) r(i)),
q as (select m.s, action, reward + v q from m join v on v.s = m.t), b as (select *, max(q) over (partition by s) b from q)
select s, min(action) action from b where abs(q - b) < 1e-8 group by s""")
def greedy_policy(spark, d):
    t = dp.walk_grid(spark)
    return dp.greedy(dp.q_values(t, dp.solve(t), 1.0))


@_query("policy_grid", _WALK + """, v as (select i s, case when i in (0, 15) then 0 else 1 - least(i // 4 + i % 4, 6 - i // 4 - i % 4) end v from range(16) r(i)),
q as (select m.s, action, reward + v q from m join v on v.s = m.t), b as (select *, max(q) over (partition by s) b from q),
g as (select s, min(action) action from b where abs(q - b) < 1e-8 group by s)
select cast(s // 4 as bigint) "row", string_agg(case when s in (0, 15) then '*' else (['^','v','<','>'])[action + 1] end, ' ' order by s) line from g group by s // 4""")
def policy_grid(spark, d):
    return dp.rendered(greedy_policy(spark, d), 4, [0, 15])


@_query("running_rewards", """select user_id, event_id, round(sum(value) over w, 4) total, round(avg(value) over w + 1e-9, 4) running_mean from events window w as (partition by user_id order by event_id rows unbounded preceding)""")
def running_rewards(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    out = S.running(e, "user_id", "event_id", "value").drop("value")
    return rounded(out.withColumn("running_mean", F.col("running_mean") + 1e-9), 4)


@_query("arm_summary", "select cast(user_id % 3 as integer) arm, count(*) pulls, round(avg(case when value > 50 then 1.0 else 0.0 end), 9) mean from events group by 1")
def arm_summary(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 3).cast("int").alias("arm"), (F.col("value") > 50).cast("int").alias("reward"))
    return rounded(S.arm_summary(e), 9)


def _episodes(spark, d):
    """Each user's events as an episode: states by type, reward where the value is high, the last without action."""
    e = table(spark, d, "events").select(F.col("user_id").alias("episode"), F.col("event_id").alias("t"), F.ascii("event_type").alias("state"), F.lit(1).alias("action"), (F.col("value") > 90).cast("int").alias("reward"))
    last = F.max("t").over(Window.partitionBy("episode"))
    return e.withColumn("action", F.when(F.col("t") != last, 1))


_EPISODES = """
with e as (select user_id episode, event_id t, ascii(event_type) state, case when event_id <> max(event_id) over (partition by user_id) then 1 end action, (value > 90)::int reward from events),
g as (select *, sum(reward) over (partition by episode order by t rows between current row and unbounded following) g from e)
"""


@_query("episode_returns", _EPISODES + "select episode, t, cast(g as bigint) g from g")
def episode_returns(spark, d):
    return S.returns(_episodes(spark, d)).select("episode", "t", "g")


@_query("mc_values", _EPISODES + """select state, round(avg(g), 8) v, count(*) n from (select *, row_number() over (partition by episode, state order by t desc) r from g where action is not null) where r = 1 group by state""")
def mc_values(spark, d):
    return rounded(S.mc_values(_episodes(spark, d)), 8)


@_query("next_steps", _EPISODES + "select episode, t, lead(state) over (partition by episode order by t) next_state, lead(action) over (partition by episode order by t) next_action from e")
def next_steps(spark, d):
    return S.transitions(_episodes(spark, d)).select("episode", "t", "next_state", "next_action")


@_query("gambler_win_rates")
def gambler_win_rates(spark, d):
    return S.win_rates(spark, 10, 0.5, 400, seed=1)


@_query("gambler_policies")
def gambler_policies(spark, d):
    one, all_ = (S.win_rates(spark, 10, 0.4, 200, p, seed=2).withColumn("policy", F.lit(p)) for p in ("1", "all"))
    return one.unionByName(all_)


@_query("mc_prediction")
def mc_prediction(spark, d):
    starts = spark.range(2000).select(F.col("id").alias("episode"), (F.col("id") % 9 + 1).alias("start"))
    return S.mc_values(S.gamblers(starts, 10, 0.5, seed=3))


def _bandit(kind):
    def run(spark, d):
        return S.arm_summary(S.bandits(spark, 20, 500, kind, seed=4))

    return run


for _k in ("epsilon", "ucb", "thompson"):
    QUERIES[f"bandit_{_k}"] = _bandit(_k)


@_query("td0_values")
def td0_values(spark, d):
    return S.td0(spark, 8, 10, 0.5, 500, seed=5).groupBy("state").agg(F.avg("v").alias("v"))


def _learner(kind):
    def run(spark, d):
        grid = [tuple(r) for r in dp.cliff_grid(spark).collect()]  # 48 rows
        q = S.control(spark, 4, grid, 0, 3, kind, episodes=300, seed=6)
        return dp.greedy(q.groupBy("s", "action").agg(F.avg("q").alias("q")))

    return run


QUERIES["sarsa_policy"], QUERIES["q_learning_policy"] = _learner("sarsa"), _learner("q_learning")


@_query("simulation_checks", """select * from (values ('bandit epsilon finds the best arm'), ('bandit thompson finds the best arm'), ('bandit ucb finds the best arm'), ('coins are fair'), ('gambler wins as often as start / goal'), ('monte carlo values are start / goal'), ('normal mean and deviation'), ('q learning goes the shortest safe way')) t("check") cross join (select true holds)""")
def simulation_checks(spark, d):
    """Seeded simulations against what theory says of them, within four standard errors."""
    rates = S.win_rates(spark, 10, 0.5, 400, seed=1).agg(F.bool_and(F.abs(F.col("rate") - F.col("state") / 10) < 4 * F.sqrt(F.lit(0.25 / 400))))
    values = mc_prediction(spark, d).agg(F.bool_and(F.abs(F.col("v") - F.col("state") / 10) < 4 * F.sqrt(F.lit(0.25) / 200)))
    coins = S.coins(spark, 100, 50, seed=8).agg(F.abs(F.avg("head") - 0.5) < 4 * 0.5 / 5000**0.5)
    normal = S.gaussians(spark, 20000, 5.0, 2.0, seed=9).agg((F.abs(F.avg("x") - 5) < 8 / 20000**0.5) & (F.abs(F.stddev("x") - 2) < 8 / 40000**0.5))
    checks = {"gambler wins as often as start / goal": rates, "monte carlo values are start / goal": values, "coins are fair": coins, "normal mean and deviation": normal}
    for kind in ("epsilon", "thompson", "ucb"):
        checks[f"bandit {kind} finds the best arm"] = QUERIES[f"bandit_{kind}"](spark, d).agg(F.max_by("arm", "pulls") == F.max_by("arm", "mean"))
    # the goal is 3 right of the start on the top row; the cliff lies below
    way = QUERIES["q_learning_policy"](spark, d).where("s in (0, 1, 2)").agg(F.bool_and(F.col("action") == 3))
    checks["q learning goes the shortest safe way"] = way
    out = None
    for name, df in checks.items():
        row = df.toDF("holds").select(F.lit(name).alias("check"), "holds")
        out = row if out is None else out.unionByName(row)
    return out


@_query("mc_control")
def mc_control(spark, d):
    return S.mc_control(spark, 4, 10, 0.4, 500, seed=7).groupBy("state", "action").agg(F.avg("q").alias("q"))


@_query("coin_trials")
def coin_trials(spark, d):
    return S.coins(spark, 100, 50, seed=8).groupBy("trial").agg(F.sum("head").alias("heads"))


@_query("dice_mean")
def dice_mean(spark, d):
    g = S.gaussians(spark, 2000, 5.0, 2.0, seed=9).agg(F.avg("x").alias("gauss_mean"), F.stddev_pop("x").alias("gauss_sd"))
    return S.dice(spark, 2000, seed=10).agg(F.avg("roll").alias("roll_mean")).crossJoin(g)


@_query("synthetic_population")
def synthetic_population(spark, d):
    return search.population(spark)


@_query("simple_sample")
def simple_sample(spark, d):
    return sampling.exactly(table(spark, d, "customer").select("c_custkey"), "c_custkey", 50, seed=1)


@_query("first_rows", "select c_custkey from customer order by c_custkey limit 20")
def first_rows(spark, d):
    return table(spark, d, "customer").select("c_custkey").orderBy("c_custkey").limit(20)


@_query("fold_sizes")
def fold_sizes(spark, d):
    return table(spark, d, "labels").groupBy(sampling.fold("doc_id", 5).alias("fold")).agg(F.count("*").alias("n"))


@_query("weighted_choice", "select case when (event_id % 1000) / 1000.0 < 0.2 then 'a' when (event_id % 1000) / 1000.0 < 0.5 then 'b' else 'c' end choice, count(*) n from events group by 1")
def weighted_choice(spark, d):
    u = (F.col("event_id") % 1000) / F.lit(1000.0)
    return table(spark, d, "events").groupBy(sampling.weighted_choice(u, ["a", "b", "c"], [2, 3, 5]).alias("choice")).agg(F.count("*").alias("n"))


# --- Keyed state


def _log(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", F.col("turn").alias("step"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("speaker"), F.array(F.length("text").cast("long")).alias("sizes"))


@_query("thread_state", """select conv_id, max(turn) step, arg_max(role, turn) filter (where turn % 2 = 0) speaker, list(length(text) order by turn) sizes from conversations group by conv_id""")
def thread_state(spark, d):
    return state.current(_log(spark, d), "conv_id", "step", ["speaker"], ["sizes"])


@_query("thread_history", """select conv_id, turn step, last_value(case when turn % 2 = 0 then role end ignore nulls) over w speaker, list(length(text)) over w sizes from conversations window w as (partition by conv_id order by turn rows unbounded preceding)""")
def thread_history(spark, d):
    return state.history(_log(spark, d), "conv_id", "step", ["speaker"], ["sizes"])


@_query("time_travel", """select conv_id, max(turn) step, arg_max(role, turn) filter (where turn % 2 = 0) speaker, list(length(text) order by turn) sizes from conversations where turn <= 1 group by conv_id""")
def time_travel(spark, d):
    return state.at(_log(spark, d), "step", 1, thread="conv_id", overwrite=["speaker"], append=["sizes"])


@_query("state_edit", """select conv_id, max(turn) + 1 step, 'reviewer' speaker, list(length(text) order by turn) sizes from conversations group by conv_id""")
def state_edit(spark, d):
    log = _log(spark, d)
    edits = log.select("conv_id").distinct().withColumn("speaker", F.lit("reviewer"))
    return state.current(state.edited(log, edits, "conv_id", "step"), "conv_id", "step", ["speaker"], ["sizes"])


@_query("message_upsert", """select conv_id, turn % 3 ident, min(turn) "position", arg_max(text, turn) text from conversations group by conv_id, turn % 3""")
def message_upsert(spark, d):
    c = table(spark, d, "conversations").withColumn("ident", F.col("turn") % 3)
    return state.upserted(c, "conv_id", "ident", "turn").select("conv_id", "ident", "position", "text")


@_query("transcripts", "select conv_id, list(role order by turn) roles, count(*) n from conversations group by conv_id")
def transcripts(spark, d):
    t = state.transcript(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return t.select("conv_id", F.transform("messages", lambda m: m["role"]).alias("roles"), F.size("messages").cast("long").alias("n"))


@_query("last_messages", "select conv_id, max(turn) turn, arg_max(text, turn) text from conversations group by conv_id")
def last_messages(spark, d):
    return state.last_message(table(spark, d, "conversations"), "conv_id", "turn", "text")


@_query("token_budget", """select conv_id, turn, used from (select conv_id, turn, cast(sum(length(text) // 4) over (partition by conv_id order by turn desc rows unbounded preceding) as bigint) used from conversations) where used <= 300""")
def token_budget(spark, d):
    c = table(spark, d, "conversations")
    return state.within_budget(c, "conv_id", "turn", F.floor(F.length("text") / 4), 300).select("conv_id", "turn", "used")


@_query("feedback", "select event_id, case event_type when 'click' then true when 'view' then false when 'purchase' then true when 'error' then true else false end positive from events")
def feedback(spark, d):
    t = F.col("event_type")
    said = F.when(t == "click", " Ok\n").when(t == "view", "not yet").when(t == "purchase", "Looks good").when(t == "error", " ")
    return table(spark, d, "events").select("event_id", state.positive_feedback(said).alias("positive"))


@_query("workflow", """select o_orderkey, case when o_totalprice > 100000 then 'high, reviewed' else 'low' end note, cast(case when o_totalprice > 100000 then 3 else 2 end as integer) steps from orders""")
def workflow(spark, d):
    """A graph with a branch by row: high orders pass a review, others don't; a private column stays inside."""
    step = F.coalesce(F.col("steps"), F.lit(0)) + 1
    g = (
        graph.Graph(output=["o_orderkey", "note", "steps"])
        .node("rate", lambda df: df.withColumns({"note": F.when(F.col("o_totalprice") > 100000, "high").otherwise("low"), "steps": step, "secret": F.lit(1)}))
        .node("review", lambda df: df.withColumns({"note": F.concat("note", F.lit(", reviewed")), "steps": step}))
        .node("close", lambda df: df.withColumn("steps", step))
        .edge(graph.START, "rate")
        .branch("rate", F.when(F.col("note") == "high", "review").otherwise("close"), ["review", "close"])
        .edge("review", "close")
        .edge("close", graph.END)
        .compile()
    )
    return g.invoke(table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(None).cast("int").alias("steps"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("int").alias("secret")))


def _source(spark, d, name: str):
    """A table as a stream of its files: a folder of them, or one file picked out of its folder."""
    t = table(spark, d, name)
    folder = f"{d}/{name}.parquet"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    reader = spark.readStream.schema(t.schema)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(folder)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


@_query("stream_messages", """select conv_id, turn % 3 ident, min(turn) "position", arg_max(text, turn) text from conversations group by conv_id, turn % 3""")
def stream_messages(spark, d):
    make = lambda: streams.latest_messages(_source(spark, d, "conversations").withColumn("ident", F.col("turn") % 3), "conv_id", "ident", "turn", "text")
    return streams.finished(make(), "complete").drop("batch")


@_query("stream_windows", """select date_trunc('hour', ts) "start", date_trunc('hour', ts) + interval 1 hour "end", event_type, count(*) n, round(sum(value), 4) total from events group by all""")
def stream_windows(spark, d):
    """An extension: hourly windows by event time (all rows of a complete run)."""
    make = lambda: streams.windowed(_source(spark, d, "events"), "ts", "event_type", "value")
    out = streams.finished(make(), "complete")
    return out.select(F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"), "event_type", "n", F.round("total", 4).alias("total"))


@_query("incremental_means", "select user_id, count(value) n, round(avg(value) + 1e-9, 5) mean from events group by user_id")
def incremental_means(spark, d):
    make = lambda: streams.incremental_means(_source(spark, d, "events").select("user_id", "value"), "user_id", "value")
    out = streams.finished(make(), "update")
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("n").desc()))
    return out.withColumn("r", last).where("r = 1").select("user_id", "n", F.round(F.col("mean") + 1e-9, 5).alias("mean"))
