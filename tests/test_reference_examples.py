"""Expectations stated by, or derivable from, the reference's inline examples, with neutral data."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions import jsons, registry, strings
from marlstone.operators import conformal, distributions, dp, estimators, extraction, graph, linkage, sampling, simulation, state
from marlstone.operators import validation as V
from marlstone.sources import html_table, keyed_json, search


def one(df):
    return df.collect()[0]


def test_address_batch(spark):
    rows = [("123", "K1A 1A1"), (None, "K1A 1A1"), ("ABC", "K1A 1A1"), ("12 3", "ABC 123"), ("1", None), ("1", "D1A 1A1"), ("1", "k1d1a1"), ("1", "K1A1O1"), ("1", "K1A 1O1")]
    df = spark.createDataFrame(rows, "street_number string, postal_code string")
    got = [[e.message for e in r.errors] for r in V.validated(df, [V.street_number(), V.postal_code()]).collect()]
    assert got == [[], ["Field required"], ["Street number must be numeric"], ["Invalid postal code format"], [], ["Invalid first letter in postal code"],
                   ["Invalid third letter in postal code"], ["Invalid fifth letter in postal code"], []]
    strict = V.validated(df, [V.postal_code(strict=True)]).collect()
    assert [e.message for e in strict[8].errors] == ["Invalid fifth letter in postal code"]
    good, bad = V.split(df, [V.street_number(), V.postal_code()])
    assert good.count() == 3 and bad.count() == 6


def test_business_records(spark):
    rows = [("1", "123456789", "484110"), ("2", "123456789", "4841"), (None, "123456789", "484110"), ("4", "12345678901", "484110"), ("5", "123abc456", "484110"), ("6", "123456789", "991234"), ("3.1415", "123456789", "484110")]
    df = spark.createDataFrame(rows, "id string, business_number string, naics_code string")
    got = [[(e.field, e.message) for e in r.errors] for r in V.validated(df, [V.coerced("id", "int"), V.business_number(), V.industry_code()]).collect()]
    assert got == [
        [], [("naics_code", "NAICS code must be exactly 6 digits")], [("id", "Field required")], [("business_number", "Business number must be exactly 9 digits")],
        [("business_number", "Business number must contain only digits")], [("naics_code", "Invalid NAICS sector code")], [("id", "Input should be a valid int")],
    ]


def test_more_rules(spark):
    df = spark.createDataFrame([("a", ["x"], "a@b.co", "https://b.co/x"), ("", ["x"] * 4, "a@b", "ftp://b.co"), ("a" * 101, None, None, None)], "s string, l array<string>, e string, u string")
    got = [r.valid for r in V.validated(df, [V.length("s", 1, 100), V.email("e"), V.http_url("u")]).collect()]
    assert got == [True, False, False]
    assert [r.valid for r in V.validated(df, [V.at_most("l", 3)]).collect()] == [True, False, False]
    assert [r.valid for r in V.validated(df, [V.one_of("s", ["a"])]).collect()] == [True, False, False]


def test_string_similarity(spark):
    pairs = [("GC", "Government of Canada"), ("MARTHA", "MARHTA"), ("DIXON", "DICKSONX"), ("", ""), ("a", None), ("same", "same"), ("cold anvil", "standard")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(strings.jaro_winkler(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(x, abs=1e-4) if x is not None else None for x in (0.5167, 0.9611, 0.8133, 0.0, None, 1.0, 0.4472)]
    ratio = [r[0] for r in df.select(strings.indel_ratio(F.col("a"), F.col("b"))).collect()]
    assert ratio[1] == pytest.approx(2 * 5 / 12) and ratio[3] == 1.0 and ratio[4] is None and ratio[5] == 1.0


def test_linkage(spark):
    df = spark.createDataFrame([(1, "acme", ["acme inc", "ACME", " No additional verified variant found "], ["apex", "acne"]), (2, "x", [], ["y"])], "id int, name string, p array<string>, n array<string>")
    got = {(r.id, r.label): r.name_two for r in linkage.matched_pairs(df, "id", "name", "p", "n").collect()}
    assert got == {(1, 1): "acme inc", (1, 0): "acne"}


def test_token_scenarios(spark):
    rows = [("r1", "a", 0.9), ("r1", "b", 0.1), ("r2", "a", 0.5), ("r2", "b", 0.3), ("r2", "c", 0.2), ("r3", "0", 0.4), ("r3", "1", 0.35), ("r3", "maybe", 0.25)]
    df = spark.createDataFrame(rows, "ctx string, token string, p double")
    kept = {(r.ctx, r.token) for r in distributions.nucleus(df, "ctx", "token", "p", 0.9).collect()}
    assert kept == {("r1", "a"), ("r2", "a"), ("r2", "b"), ("r2", "c"), ("r3", "0"), ("r3", "1"), ("r3", "maybe")}
    top = {(r.ctx, r.token) for r in distributions.top_k(df, "ctx", "token", "p", 2).collect()}
    assert len(top) == 6
    total = distributions.softmax(df, "ctx", "p").groupBy("ctx").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in total)
    with pytest.raises(ValueError):
        distributions.softmax(df, "ctx", "p", 0.0)


def test_conformal(spark):
    s = spark.createDataFrame([(i / 10,) for i in range(1, 10)], "s double")
    assert one(conformal.order_statistic(s, "s", 0.1)).q == pytest.approx(0.9)
    assert one(conformal.order_statistic(s, "s", 0.05)).q == float("inf")
    assert one(conformal.order_statistic(s.limit(0), "s", 0.1)).q == float("inf")
    ties = spark.createDataFrame([(0.5,)] * 9, "s double")
    assert one(conformal.order_statistic(ties, "s", 0.5)).q == 0.5


def test_calibration_identity_and_greg(spark):
    u = spark.range(1000).select("id", (F.col("id") % 37 + 1.0).alias("z"))
    s = u.where("id % 20 = 3").withColumns({"w": F.lit(20.0) + F.col("id") % 3, "y": 3 * F.col("z") + F.col("id") % 5})
    c = one(estimators.calibrated(u, s, "z", "w").agg(F.sum("calibrated_w"), F.sum(F.col("calibrated_w") * F.col("z")), F.sum(F.col("calibrated_w") * F.col("y"))))
    assert c[0] == pytest.approx(1000) and c[1] == pytest.approx(one(u.agg(F.sum("z")))[0])
    g = one(estimators.greg_total(u, s, "y", "z", "w"))
    assert g.total == pytest.approx(c[2]) and abs(g.correction) < 1e-6
    d = one(estimators.difference_total(u, s, "y", "z", "w", 3.0))
    assert d.total == pytest.approx(d.predicted + d.correction)


def test_graph_examples(spark):
    g = graph.Graph(output=["foo"]).node("a", lambda d: d.withColumn("bar", F.col("foo") + 1)).node("b", lambda d: d.withColumn("foo", F.col("bar") + 1))
    g.edge(graph.START, "a").edge("a", "b").edge("b", graph.END).compile()
    out = g.invoke(spark.createDataFrame([(1, None)], "foo int, bar int"))
    assert out.columns == ["foo"] and one(out).foo == 3
    for wrong in (graph.Graph(), graph.Graph().edge(graph.START, "x"), graph.Graph().node("a", lambda d: d).node("b", lambda d: d).edge(graph.START, "a").edge("a", graph.END)):
        with pytest.raises(ValueError):
            wrong.compile()
    loop = graph.Graph().node("a", lambda d: d.withColumn("foo", F.col("foo") + 1)).edge(graph.START, "a").branch("a", F.when(F.col("foo") < 4, "a").otherwise(graph.END), ["a", graph.END]).compile()
    assert [r.foo for r in loop.invoke(spark.createDataFrame([(1,), (9,)], "foo int")).orderBy("foo").collect()] == [4, 10]
    stopped = list(loop.steps(spark.createDataFrame([(1,)], "foo int"), before={"a"}))
    assert one(loop.resume(stopped[-1][1])).foo == 4


def test_reducers(spark):
    log = spark.createDataFrame([("t", 1, "a", ["a"]), ("t", 2, "b", ["b"]), ("t", 3, None, None)], "thread string, step int, foo string, bar array<string>")
    how = {"overwrite": ["foo"], "append": ["bar"]}
    now = one(state.current(log, "thread", "step", **how))
    assert (now.foo, now.bar) == ("b", ["a", "b"])
    assert one(state.at(log, "step", 1, thread="thread", **how)).bar == ["a"]
    assert [r.foo for r in state.history(log, "thread", "step", **how).orderBy("step").collect()] == ["a", "b", "b"]


def test_gamblers(spark):
    fair = {r.state: r.rate for r in simulation.win_rates(spark, 10, 0.5, 2000, seed=1).collect()}
    assert all(abs(fair[s] - s / 10) < 0.05 for s in range(1, 10))
    all_in = {r.state: r.rate for r in simulation.win_rates(spark, 10, 0.4, 2000, "all", seed=1).collect()}
    assert abs(all_in[5] - 0.4) < 0.05
    e = simulation.gamblers(spark.createDataFrame([(1, 2)], "episode long, start long"), 4, 0.5, seed=0).orderBy("t").collect()
    assert e[0].state == 2 and e[-1].action is None and all(r.action == 1 for r in e[:-1])


def test_grids(spark):
    v = {r.s: r.v for r in dp.solve(dp.walk_grid(spark)).collect()}
    assert v == {s: 0.0 if s in (0, 15) else 1.0 - min(s // 4 + s % 4, 6 - s // 4 - s % 4) for s in range(16)}
    swept = {r.s: r.v for r in dp.sweep_values(dp.walk_grid(spark)).collect()}
    assert swept == v
    values, policy = dp.policy_iteration(dp.walk_grid(spark), gamma=0.9)
    best = {r.s: r.v for r in dp.solve(dp.walk_grid(spark), gamma=0.9).collect()}
    assert all(r.v == pytest.approx(best[r.s], abs=1e-6) for r in values.collect())


def test_learners_find_the_goal(spark):
    grid = [tuple(r) for r in dp.cliff_grid(spark).collect()]
    q = simulation.control(spark, 2, grid, 0, 3, "q_learning", episodes=300, seed=1)
    path = {r.s: r.action for r in dp.greedy(q.groupBy("s", "action").agg(F.avg("q").alias("q"))).collect()}
    assert [path[s] for s in (0, 1, 2)] == [3, 3, 3]


def test_bandits_find_the_best_arm(spark):
    for kind in ("epsilon", "ucb", "thompson"):
        rows = {r.arm: r.pulls for r in simulation.arm_summary(simulation.bandits(spark, 10, 400, kind, seed=2)).collect()}
        assert max(rows, key=rows.get) == 2, kind


def test_samples(spark):
    df = spark.range(1000)
    a = {r.id for r in sampling.exactly(df, "id", 50, 1).collect()}
    assert len(a) == 50 and a == {r.id for r in sampling.exactly(df.repartition(7), "id", 50, 1).collect()}
    p = search.population(spark)
    assert p.count() == 1000 and p.where("employees between 1 and 5").count() == 600 and p.where("employees > 20").count() == 100


def test_keyed_json(spark, tmp_path):
    rows = spark.createDataFrame([("1", "A", ["x"], "s", "u", "2020-01-01"), ("2", "B", None, "s", "u", None)], "id string, " + keyed_json.RECORD)
    keyed_json.write(rows.coalesce(1), f"{tmp_path}/t1")
    back = keyed_json.read(spark, f"{tmp_path}/t1")
    assert {(r.id, r.title) for r in back.collect()} == {("1", "A"), ("2", "B")}
    assert keyed_json.read(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("{broken")
    assert keyed_json.read(spark, f"{tmp_path}/bad").count() == 0
    new = spark.createDataFrame([("2", "C"), ("3", "D")], "id string, title string")
    assert {(r.id, r.title) for r in keyed_json.upserted(back.drop("path"), new).collect()} == {("1", "A"), ("2", "C"), ("3", "D")}
    wanted = spark.createDataFrame([("1",), ("9",)], "id string")
    found = {r.id: r.found for r in keyed_json.lookup(back, wanted).collect()}
    assert '"title":"A"' in found["1"] and found["9"] == "There's no saved information related to paper 9."


def test_html_table(spark):
    page = "<table><tr><td>no</td></tr></table><table><tr><th>Name</th><th>Notes &amp; more</th></tr><tr><td>A <b>b</b></td><td>n</td></tr><tr><td>C</td><td></td></tr></table>"
    out = html_table.table(spark.createDataFrame([(page,)], "page string"), "page", ["Notes & more", "Name"]).collect()
    assert [tuple(r) for r in out] == [("n", "A b"), ("", "C")]


def test_json(spark):
    df = spark.createDataFrame([('{"addresses": [{"name": "a", "n": 1}, {"name": "b"}]}',), ("broken",)], "j string")
    assert [tuple(r) for r in jsons.records(df, "j", "addresses", "name string, n int").collect()] == [("a", 1), ("b", None)]
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("kind", T.StringType(), True, {"comment": "what"}), T.StructField("l", T.ArrayType(T.DoubleType()), False)])
    d = jsons.json_schema(schema, {"kind": ["a", "b"]})
    assert d["required"] == ["id", "l"] and d["properties"]["kind"]["anyOf"][0] == {"type": "string", "enum": ["a", "b"], "description": "what"}
    t = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("{}",)], "t string")
    assert [r[0] for r in t.select(strings.fenced_json(F.col("t"))).collect()] == ['{"a": 1}', "{}"]


def test_registry(spark):
    r = registry.Registry()

    @r.tool
    def add(a: int, b: int) -> int:
        """Sum."""
        return a + b

    assert r.call("add", {"a": 1, "b": 2}) == "3" and r.schema("add")["parameters"]["required"] == ["a", "b"]
    r.register(spark)
    assert one(spark.sql("select add(1, 2) x")).x == 3
    with pytest.raises(KeyError):
        r.call("none", {})
    with pytest.raises(TypeError):
        r.tool(lambda a: a)
    assert [registry.normalised(x) for x in (None, [1, 2], {"a": 1}, 5)] == ["Operation completed without results", "1, 2", '{\n  "a": 1\n}', "5"]


def test_extraction_errors(spark):
    df = spark.createDataFrame([(1, '{"name": "a", "email": "a@b.co"}'), (2, '[{"name": "b", "email": "bad"}]'), (3, "no json")], "id int, t string")
    out = extraction.extracted(df, "t", lambda c: c, "name string, email string", [V.email("email")], "id").orderBy("id").collect()
    assert [(r.id, r["name"], r.error_class) for r in out] == [(1, "a", None), (2, "b", "validation"), (3, None, "json")]
