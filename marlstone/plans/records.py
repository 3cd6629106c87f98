"""Queries on sources and sinks, record rules, tools, extraction, workflows and task graphs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from marlstone.functions import jsons, strings
from marlstone.functions.registry import Context, Hooks, Registry
from marlstone.operators import conformal, dag, graph, sampling
from marlstone.operators import distributions as D
from marlstone.operators import estimators as E
from marlstone.operators import extraction as X
from marlstone.operators import validation as V
from marlstone.plans.ppi import _labelled, _PPI_SQL, _survey, _SURVEY
from marlstone.session import scratch, table
from marlstone.sources import html_table, keyed_json

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- Sources and sinks


@_query("html_tables", """select n_name as "Name", cast(n_nationkey as varchar) as "Key", n_regionkey || ' & more' as "Region" from nation""")
def html_tables(spark, d):
    """The second table of a page, its second header row as names, back to rows; the first table is navigation."""
    n = table(spark, d, "nation").orderBy("n_nationkey")
    row = F.format_string("<tr><td>%s</td><td> %d</td><td>%d &amp; more</td><td>x</td></tr>", "n_name", "n_nationkey", "n_regionkey")
    head = "<table><tr><td>home</td></tr></table><table><tr><th>a</th><th>b</th><th>c</th><th>d</th></tr><tr><th>Name</th><th>Key</th><th>Region</th><th>Rest</th></tr>"
    page = n.agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(row)), ""), F.lit("</table>")).alias("page"))
    return html_table.table(page, "page", ["Name", "Key", "Region"], number=1, header_rows=2)


def _papers(spark, d, where, note):
    s = table(spark, d, "supplier").where(where)
    fields = [F.col("s_name").alias("title"), F.array("s_phone").alias("authors") if "s_phone" in s.columns else F.array("s_name").alias("authors"), F.concat(F.lit(note), F.round("s_acctbal", 2)).alias("summary")]
    return s.select(F.col("s_suppkey").cast("string").alias("id"), *fields, F.concat(F.lit("http://example.com/"), "s_suppkey").alias("pdf_url"), F.lit("2024-01-01").alias("published"))


def _stored(spark, d):
    """Suppliers as keyed JSON documents in two folders, one of them with a broken file; and every third record written anew."""
    base = scratch(spark, "papers")
    keyed_json.write(_papers(spark, d, "s_nationkey % 2 = 0", "old "), f"{base}/a_topic")
    keyed_json.write(_papers(spark, d, "s_nationkey % 2 = 1", "old "), f"{base}/b_topic")
    spark.range(1).select(F.lit("{broken").alias("value")).write.text(f"{base}/c_broken")
    old = keyed_json.read(spark, f"{base}/*/*")
    new = _papers(spark, d, "s_suppkey % 3 = 0", "new ").withColumn("priority", F.lit(1))
    again = new.withColumns({"priority": F.lit(2), "summary": F.concat(F.lit("newest"), F.substring("summary", 4, 100))}).where("id % 2 = 0")
    keyed_json.write(keyed_json.upserted(old.drop("path"), new.unionByName(again)), f"{base}/d_merged")
    return base


@_query("keyed_json_upsert", """select s_suppkey::varchar id, s_name title, case when s_suppkey % 6 = 0 then 'newest' when s_suppkey % 3 = 0 then 'new' else 'old' end state from supplier""")
def keyed_json_upsert(spark, d):
    """Read, upsert (the last write wins) and full rewrite of {id: record} documents, read back."""
    out = keyed_json.read(spark, f"{_stored(spark, d)}/d_merged/*")
    return out.select("id", "title", F.split("summary", " ")[0].alias("state"))


@_query("keyed_json_lookup", """select k::varchar id, case when s_suppkey is null then 'There''s no saved information related to paper ' || k || '.' else s_name end found
from (select s_suppkey k from supplier union all select s_suppkey + 1000000 from supplier where s_suppkey % 5 = 0) w left join supplier on s_suppkey = k""")
def keyed_json_lookup(spark, d):
    """Lookup over several folders: the first that has the key answers, else a message; a missing folder has no rows."""
    base = _stored(spark, d)
    rows = keyed_json.read(spark, f"{base}/[ab]_topic/*").unionByName(keyed_json.read(spark, f"{base}/none/*"))
    s = table(spark, d, "supplier")
    wanted = s.select("s_suppkey").unionByName(s.where("s_suppkey % 5 = 0").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"))).select(F.col("s_suppkey").cast("string").alias("id"))
    found = keyed_json.lookup(rows, wanted)
    return found.select("id", F.coalesce(F.get_json_object("found", "$.title"), "found").alias("found"))


@_query("csv_round_trip", "select p_partkey, p_name, p_size, p_retailprice from part")
def csv_round_trip(spark, d):
    """A table written as CSV without an index, read back by its schema."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    path = scratch(spark, "csv")
    p.write.option("header", True).csv(path)
    return spark.read.schema(p.schema).option("header", True).csv(path)


@_query("memory_rows", "select * from (values ('bank a', 1, 'x'), ('bank b', null, 'y')) t(name, code, note)")
def memory_rows(spark, d):
    """Rows from a list of records, a missing field null."""
    return spark.createDataFrame([{"name": "bank a", "code": 1, "note": "x"}, {"name": "bank b", "note": "y"}], "name string, code int, note string")


@_query("shuffled_slice", "select count(*) n, sum(c_custkey)::bigint total, true reordered from (select c_custkey from customer order by c_custkey limit 500)")
def shuffled_slice(spark, d):
    """The first rows in a seeded random order: the same rows, elsewhere."""
    first = table(spark, d, "customer").select("c_custkey").orderBy("c_custkey").limit(500)
    order = sampling.shuffled(first, "c_custkey", seed=42).agg(F.collect_list("c_custkey").alias("l"))  # 500 rows
    return order.select(F.size("l").cast("long").alias("n"), F.aggregate("l", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), (F.col("l") != F.array_sort("l")).alias("reordered"))


@_query("rows_by_position", "select c_custkey, c_name from (select *, row_number() over (order by c_custkey) r from customer) where r in (1, 7)")
def rows_by_position(spark, d):
    """The first and the seventh row in key order."""
    first = table(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey").limit(7)
    return first.where("c_custkey is not null").unionByName(first.limit(0)).orderBy("c_custkey").limit(1).unionByName(first.orderBy(F.col("c_custkey").desc()).limit(1))


# --- JSON and records


@_query("fenced_json", """select event_id, cast(json_extract_string(props, '$.k') as integer) k from events""")
def fenced_json(spark, d):
    """JSON answers in fenced Markdown blocks, with and without a language, and bare."""
    j, k = F.col("props"), F.col("event_id") % 3
    said = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), j, F.lit("\n```\nDone."))).when(k == 1, F.concat(F.lit("```\n"), j, F.lit("```"))).otherwise(j)
    return table(spark, d, "events").select("event_id", jsons.parsed(strings.fenced_json(said), "k int")["k"].alias("k"))


@_query("first_record_list", "select o_custkey, o_orderkey from orders")
def first_record_list(spark, d):
    """The first column that is a list of records, as rows."""
    lists = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_list(F.struct("o_custkey", "o_orderkey")).alias("r")).drop("o_custkey")
    return jsons.first_list(lists)


@_query("table_schemas", """select * from (values ('region', 'r_name', 'string', false), ('region', 'r_regionkey', 'integer', false), ('reviews', 'rating', 'integer', true), ('reviews', 'tags', 'array', false), ('reviews', 'verdict', 'string', true)) t("table", field, kind, required)""")
def table_schemas(spark, d):
    """JSON schemas of a table and of a record type with required fields, a list and an enumeration."""
    from pyspark.sql import types as T

    review = T.StructType([T.StructField("verdict", T.StringType(), False), T.StructField("rating", T.LongType(), False), T.StructField("tags", T.ArrayType(T.StringType()), True)])
    region = T.StructType([f for f in table(spark, d, "region").schema if f.name in ("r_regionkey", "r_name")])
    rows = []
    for name, kind in (("region", region), ("reviews", review)):
        doc = json.loads(json.dumps(jsons.json_schema(kind, {"verdict": ["success", "failure"]})))
        for field, t in doc["properties"].items():
            rows.append((name, field, (t["anyOf"][0] if "anyOf" in t else t)["type"], field in doc["required"]))
    return spark.createDataFrame(rows, "table string, field string, kind string, required boolean")


@_query("field_rules", """
select p_partkey, case when length(p_name) < 1 then 'At least 1 characters' when length(p_name) > 20 then 'At most 20 characters' end name_error,
  case when p_size % 3 + 1 + (p_size > 25)::int > 3 then 'At most 3 items' end tags_error, case when p_partkey % 4 = 3 then 'Must be one of: success, failure' end result_error,
  case when p_partkey % 4 = 2 then 'Field required' when p_partkey % 4 = 1 then 'Input should be a valid double' end number_error from part""")
def field_rules(spark, d):
    """Length, list size, enumeration and number rules on parts."""
    k = F.col("p_partkey") % 4
    tags = F.array_repeat(F.lit("t"), F.col("p_size").cast("int") % 3 + 1 + (F.col("p_size") > 25).cast("int"))
    result = F.when(k == 3, "maybe").when(k == 2, "failure").otherwise("success")
    number = F.when(k == 2, None).when(k == 1, "3,14").otherwise("3.1415")
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), tags.alias("tags"), result.alias("result"), number.alias("number"))
    rules = {"name_error": V.length("name", 1, 20), "tags_error": V.at_most("tags", 3), "result_error": V.one_of("result", ["success", "failure"]), "number_error": V.coerced("number", "double")}
    return rows.select("p_partkey", *[r.message().alias(n) for n, r in rules.items()])


@_query("rule_levels", """
with p as (select *, length(p_name) <= 20 field_ok, p_retailprice > p_size * 10 record_ok, count(*) over (partition by p_name) = 1 collection_ok from part)
select 'collection' as "level", count(*) filter (where collection_ok) good, count(*) n from p union all select 'field', count(*) filter (where field_ok), count(*) from p union all select 'record', count(*) filter (where record_ok), count(*) from p""")
def rule_levels(spark, d):
    """The same records judged by field, by record and as a collection."""
    p = table(spark, d, "part")
    field = V.validated(p, [V.length("p_name", 1, 20)]).agg(F.count_if("valid").alias("good"), F.count("*").alias("n"))
    across = V.Rule("p_retailprice", ((F.col("p_retailprice") > F.col("p_size") * 10, "Too cheap for its size"),))
    record = V.validated(p, [across]).agg(F.count_if("valid").alias("good"), F.count("*").alias("n"))
    twice = V.duplicates(p, ["p_name"]).select("p_name")
    whole = p.join(twice, "p_name", "left_anti").agg(F.count("*").alias("good")).crossJoin(p.agg(F.count("*").alias("n")))  # one row each
    return field.withColumn("level", F.lit("field")).unionByName(record.withColumn("level", F.lit("record"))).unionByName(whole.withColumn("level", F.lit("collection")))


@_query("rejected_records", """select count(*) filter (where ok) accepted, count(*) filter (where not ok) rejected, min(k) filter (where not ok) first_rejected
from (select s_suppkey k, s_suppkey % 11 <> 5 and s_suppkey % 7 not in (1, 2) ok from supplier)""")
def rejected_records(spark, d):
    """Good rows and rejected rows with their errors, apart."""
    from marlstone.plans.text import _businesses

    good, bad = V.split(_businesses(spark, d), [V.coerced("id", "bigint"), V.business_number()])
    return good.agg(F.count("*").alias("accepted")).crossJoin(bad.agg(F.count("*").alias("rejected"), F.min("s_suppkey").alias("first_rejected")))  # one row each


# --- Extraction


@_query("country_extraction", """select c_custkey, n_name country from customer join nation on n_nationkey = c_nationkey where c_custkey % 7 <> 0 union all select c_custkey, null from customer where c_custkey % 7 = 0""")
def country_extraction(spark, d):
    """The country that a sentence names, as a schema-constrained record; null where none is known."""
    names = [r[0] for r in table(spark, d, "nation").select("n_name").orderBy(F.length("n_name").desc(), "n_name").collect()]  # the list of countries
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    said = F.concat(F.lit("Our client "), "c_name", F.lit(" moved to "), F.when(F.col("c_custkey") % 7 != 0, F.col("n_name")).otherwise("Atlantis"), F.lit(" last year."))
    provider = X.pattern_provider(r"\b(" + "|".join(names) + r")\b", ["country"])
    out = X.extracted(c.select("c_custkey", said.alias("t")), "t", provider, "country string", [V.one_of("country", names)], "c_custkey")
    return c.select("c_custkey").join(out.where("valid").select("c_custkey", "country"), "c_custkey", "left")


@_query("address_extraction", """select c_custkey, c_custkey % 500 || case when c_custkey % 3 = 0 then ' ' else '' end street_number, 'Elm Street' street_name, 'Ottawa' city, case when c_custkey % 5 = 0 then 'D1A 1A1' else 'K1A 0B1' end postal_code,
  case when c_custkey % 5 = 0 then 'postal_code: Invalid first letter in postal code' else '' end errors from customer""")
def address_extraction(spark, d):
    """Addresses read off sentences, validated by field."""
    k = F.col("c_custkey")
    said = F.concat(F.lit("Send it to ["), k % 500, F.when(k % 3 == 0, " ").otherwise(""), F.lit("] Elm Street, Ottawa "), F.when(k % 5 == 0, "D1A 1A1").otherwise("K1A 0B1"), F.lit(", please."))
    provider = X.pattern_provider(r"\[([^\]]*)\] ([^,]+), (\w+) ([A-Z][0-9][A-Z] [0-9][A-Z][0-9])", ["street_number", "street_name", "city", "postal_code"])
    fields = "street_number string, street_name string, city string, postal_code string"
    out = X.extracted(table(spark, d, "customer").select(k, said.alias("t")), "t", provider, fields, [V.street_number(), V.postal_code()], "c_custkey")
    errors = F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "; ")
    return out.select("c_custkey", "street_number", "street_name", "city", "postal_code", errors.alias("errors"))


@_query("extraction_errors", """select case event_id % 4 when 0 then 'json' when 1 then 'validation' end error_class, count(*) n from events where event_id % 4 <> 3 group by 1""")
def extraction_errors(spark, d):
    """Answers that aren't JSON, records that break a rule, good records, and answers without records."""
    k = F.col("event_id") % 4
    said = F.when(k == 0, '{"email": ').when(k == 1, '[{"email": "nobody"}]').when(k == 2, '{"email": "a@example.com"}').otherwise("[]")
    out = X.extracted(table(spark, d, "events").select("event_id", said.alias("t")), "t", lambda c: c, "email string", [V.email("email")], "event_id")
    return out.groupBy("error_class").agg(F.count("*").alias("n"))


# --- Tools


def _tools() -> Registry:
    r = Registry()

    @r.tool
    def plus(a: int, b: int) -> int:
        """The sum of two whole numbers."""
        return a + b

    @r.tool
    def times(a: int, b: int) -> int:
        """The product of two whole numbers."""
        return a * b

    @r.tool
    def shout(text: str) -> str:
        """The text in capitals."""
        return text.upper()

    return r


@_query("tool_dispatch", """select o_orderkey, case o_orderkey % 5 when 0 then (o_orderkey + o_custkey)::varchar when 1 then (o_orderkey * o_custkey)::varchar when 2 then upper(o_orderpriority) when 3 then 'unknown tool minus' else 'arguments don''t fit plus' end answer from orders""")
def tool_dispatch(spark, d):
    """Calls as rows, a tool's name and JSON arguments, dispatched by the registry."""
    k, a, b = F.col("o_orderkey") % 5, F.col("o_orderkey"), F.col("o_custkey")
    name = F.when(k == 0, "plus").when(k == 1, "times").when(k == 2, "shout").when(k == 3, "minus").otherwise("plus")
    numbers = F.to_json(F.struct(a.alias("a"), b.alias("b")))
    arguments = F.when(k == 2, F.to_json(F.struct(F.col("o_orderpriority").alias("text")))).when(k == 4, '{"a": 1}').otherwise(numbers)
    calls = table(spark, d, "orders").select("o_orderkey", name.alias("name"), arguments.alias("arguments"))
    return calls.select("o_orderkey", _tools().dispatched(spark, F.col("name"), F.col("arguments")).alias("answer"))


@_query("tool_schemas", """select * from (values ('plus', 'The sum of two whole numbers.', 'a integer, b integer'), ('times', 'The product of two whole numbers.', 'a integer, b integer'), ('shout', 'The text in capitals.', 'text string')) t(name, description, parameters)""")
def tool_schemas(spark, d):
    """What a model would be told of the tools."""
    r = _tools()
    docs = [r.schema(n) for n in r.tools]
    return spark.createDataFrame([(x["name"], x["description"], ", ".join(f"{k} {v['type']}" for k, v in x["parameters"]["properties"].items())) for x in docs], "name string, description string, parameters string")


@_query("hook_events", """select * from (values (1, 'load', 'start'), (2, 'load', 'end'), (3, 'count', 'start'), (4, 'count', 'end')) t(i, name, event) cross join (select count(*) n from nation)""")
def hook_events(spark, d):
    """Events counted by hooks around two operators, with the second's result."""
    h = Hooks()
    load = h.around("load", lambda: table(spark, d, "nation"))
    n = h.around("count", lambda df: df.agg(F.count("*").alias("n")))(load())
    return spark.createDataFrame([(i + 1, e[0], e[1]) for i, e in enumerate(h.events)], "i int, name string, event string").crossJoin(n)  # n is one row


@_query("year_rates", """select o_orderkey, round(o_totalprice * case when year(o_orderdate) < 1995 then 1.05 when year(o_orderdate) = 1995 then 1.0 else 0.95 end, 4) adjusted, 1995 - year(o_orderdate) age from orders""")
def year_rates(spark, d):
    """A lookup that depends on the context's year: factors for years before, at and after it."""
    context = Context(year=1995, values={-1: 1.05, 0: 1.0, 1: 0.95})
    factors = spark.createDataFrame(list(context.values.items()), "side int, factor double")  # three rows
    y = F.year("o_orderdate")
    rows = table(spark, d, "orders").withColumn("side", F.signum(y - F.lit(context.year)).cast("int")).join(F.broadcast(factors), "side")
    return rows.select("o_orderkey", F.round(F.col("o_totalprice") * F.col("factor"), 4).alias("adjusted"), (F.lit(context.year) - y).cast("long").alias("age"))


@_query("class_names", """select s_suppkey, (['AFRICA?','low','middle','high'])[case when s_suppkey % 4 = 0 then 1 else s_suppkey % 4 + 1 end] class_name from supplier""")
def class_names(spark, d):
    """The name of a class by its index."""
    names = F.array(*[F.lit(x) for x in ("AFRICA?", "low", "middle", "high")])
    return table(spark, d, "supplier").select("s_suppkey", F.get(names, (F.col("s_suppkey") % 4).cast("int")).alias("class_name"))


@_query("guardrail", """select conv_id, turn, not regexp_matches(lower(text), '\\b(the|of)\\b') tripped from conversations where role = 'user'""".replace("\\\\", "\\"))
def guardrail(spark, d):
    """Questions that trip the guard because they aren't on its subject."""
    c = table(spark, d, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", (D.label_of(F.col("text"), {"the": "subject", "of": "subject"}, "other") != "subject").alias("tripped"))


# --- Workflows


def _review():
    step = lambda df: df.withColumn("steps", F.col("steps") + 1)
    return (
        graph.Graph(output=["o_orderkey", "note", "steps"])
        .node("rate", lambda df: step(df).withColumn("note", F.when(F.col("o_totalprice") > 150000, "high").otherwise("low")))
        .node("review", lambda df: step(df).withColumn("note", F.concat(F.coalesce("edit", F.lit("unseen")), F.lit(" "), "note")))
        .edge(graph.START, "rate")
        .branch("rate", F.when(F.col("note") == "high", "review").otherwise(graph.END), ["review", graph.END])
        .branch("review", F.when((F.col("steps") < 3) & (F.col("o_orderkey") % 2 == 0), "review").otherwise(graph.END), ["review", graph.END])
        .compile()
    )


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(0).alias("steps"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("edit"))


@_query("workflow_checkpoints", """
with o as (select o_orderkey k, o_totalprice > 150000 hi, o_orderkey % 2 = 0 even from orders),
s as (select 0 step, 'rate' node from o union all select 1, case when hi then 'review' else '__end__' end from o
      union all select 2, case when hi and even then 'review' else '__end__' end from o union all select 3, '__end__' from o)
select step, node, count(*) n from s group by all""")
def workflow_checkpoints(spark, d):
    """The state after every super-step of a graph with a loop: how many rows wait for which node."""
    out = _review().checkpoints(_orders(spark, d))
    return out.groupBy("step", F.col("__at").alias("node")).agg(F.count("*").alias("n"))


@_query("workflow_resume", """select o_orderkey, case when o_totalprice <= 150000 then 'low' when o_orderkey % 2 = 0 then 'seen seen high' else 'seen high' end note, case when o_totalprice <= 150000 then 1 when o_orderkey % 2 = 0 then 3 else 2 end steps from orders""")
def workflow_resume(spark, d):
    """A breakpoint before the review by a condition on the rows, the state edited from outside, then on to the end."""
    g, stopped = _review(), None
    for _, stopped in g.steps(_orders(spark, d), before={"review"}):
        pass
    return g.resume(stopped.withColumn("edit", F.when(F.col("__at") == "review", "seen")))


@_query("workflow_parallel", """select c_custkey, c_acctbal >= 0 solvent, upper(c_mktsegment) segment, length(c_mktsegment) + (c_acctbal >= 0)::int score from customer""")
def workflow_parallel(spark, d):
    """Two functions on the same rows in one super-step; a column that both set is added up by its reducer."""
    money = lambda df: df.withColumns({"solvent": F.col("c_acctbal") >= 0, "score": (F.col("c_acctbal") >= 0).cast("int")})
    market = lambda df: df.withColumns({"segment": F.upper("c_mktsegment"), "score": F.length("c_mktsegment")})
    g = graph.Graph(output=["c_custkey", "solvent", "segment", "score"])
    g.parallel("both", [money, market], "c_custkey", [["solvent", "score"], ["segment", "score"]], {"score": lambda a, b: (a + b).cast("long")})
    return g.edge(graph.START, "both").edge("both", graph.END).compile().invoke(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"))


@_query("task_graph", """select * from (values (1, 'orders', 1, 'OSError'), (2, 'orders', 2, 'ok'), (3, 'totals', 1, 'ok')) t(i, task, attempt, outcome) cross join (select count(distinct o_custkey) n from orders)""")
def task_graph(spark, d):
    """A task that fails once and is repeated, and a task on its result."""
    tries = []

    def orders():
        tries.append(1)
        if len(tries) == 1:
            raise OSError("not there yet")
        return table(spark, d, "orders").select("o_custkey")

    g = dag.Dag().task("orders", orders, retries=2).task("totals", lambda o: o.agg(F.countDistinct("o_custkey").alias("n")), ("orders",))
    results, log = g.run(spark)
    return spark.createDataFrame([(i + 1, *x) for i, x in enumerate(log)], "i int, task string, attempt int, outcome string").crossJoin(results["totals"])  # one row


# --- Estimators, intervals, models


@_query("design_weights", _SURVEY + """, p as (select c_mktsegment, count(*) n from u group by 1), q as (select c_mktsegment, count(*) k from u where c_custkey % 20 = 0 group by 1)
select c_mktsegment, round(n / k, 9) weight, round(sum(n / k * y), 4) total from p join q using (c_mktsegment) join u using (c_mktsegment) where c_custkey % 20 = 0 group by c_mktsegment, n, k""")
def design_weights(spark, d):
    """Stratified expansion totals with the weight N / n of each stratum, from the counts."""
    u, _ = _survey(spark, d)
    s = E.design_weights(u, u.where("c_custkey % 20 = 0"), ["c_mktsegment"])
    return E.rounded(s.groupBy("c_mktsegment").agg(F.max("w").alias("weight")), 9).join(E.rounded(s.groupBy("c_mktsegment").agg(F.sum(F.col("w") * F.col("y")).alias("total")), 4), "c_mktsegment")


@_query("ppi_tuned", _PPI_SQL + """, c as (select covar_samp(y, f) c, var_samp(f) vl, avg(f) ml from l), v as (select var_samp(f) vf from (select f from l union all select f from u)),
t as (select *, c / ((1 + n / nn) * vf) lam from a, b, c, v)
select n, nn n_unlabelled, round(lam, 8) lam, round(my + lam * (mf - ml), 8) theta, round(sqrt((vy - 2 * lam * c + lam * lam * vl) / n + lam * lam * vf_1 / nn), 8) se,
  round(my + lam * (mf - ml) - 1.96 * sqrt((vy - 2 * lam * c + lam * lam * vl) / n + lam * lam * vf_1 / nn), 8) ci_lo, round(my + lam * (mf - ml) + 1.96 * sqrt((vy - 2 * lam * c + lam * lam * vl) / n + lam * lam * vf_1 / nn), 8) ci_hi from t""".replace("vf_1", "vp").replace("select var_samp(f) vf from (select f from l", "select var_samp(f) vp from (select f from l").replace("nn) * vf)", "nn) * vp)"))
def ppi_tuned(spark, d):
    both, rest = _labelled(spark, d)
    return E.rounded(E.ppi_tuned_mean(both, rest, "y", "f"), 8)


_PRICES = """
with l as (select l_orderkey, l_linenumber, l_extendedprice y, l_quantity * (select sum(l_extendedprice) / sum(l_quantity) from lineitem where l_orderkey % 2 = 0) p from lineitem),
s as (select abs(y - p) s, row_number() over (order by abs(y - p)) r from l where l_orderkey % 2 = 0), n as (select count(*) n from s),
q as (select s q from s, n where r = ceil(round((n + 1) * 0.9, 9)))
"""


def _prices(spark, d):
    """Prices predicted from quantities by the mean unit price of even orders; residuals of those set the interval."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_extendedprice").alias("y"))  # noqa: E741
    unit = l.where("l_orderkey % 2 = 0").agg((F.sum("y") / F.sum("l_quantity")).alias("unit"))
    l = l.crossJoin(F.broadcast(unit)).withColumn("p", F.col("l_quantity") * F.col("unit"))  # noqa: E741 - unit is one row
    q = conformal.order_statistic(l.where("l_orderkey % 2 = 0").select(F.abs(F.col("y") - F.col("p")).alias("s")), "s", 0.1)
    return l.where("l_orderkey % 2 = 1").crossJoin(F.broadcast(q.select("q")))


@_query("price_intervals", _PRICES + "select l_orderkey, l_linenumber, round(p - q, 4) lo, round(p + q, 4) hi, y not between p - q and p + q anomaly from l, q where l_orderkey % 2 = 1")
def price_intervals(spark, d):
    """Conformal regression intervals and the anomalies outside them."""
    out = conformal.anomalies(_prices(spark, d), "p", "y", F.col("q"))
    return out.select("l_orderkey", "l_linenumber", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), "anomaly")


@_query("imputation_intervals", _PRICES + "select l_orderkey, l_linenumber, round(p, 4) imputed, round(p - q, 4) lo, round(p + q, 4) hi from l, q where l_orderkey % 2 = 1 and l_linenumber = 3")
def imputation_intervals(spark, d):
    """Missing prices imputed, each with its conformal interval."""
    missing = _prices(spark, d).withColumn("y", F.when(F.col("l_linenumber") != 3, F.col("y")))
    out = conformal.anomalies(missing, "p", "y", F.col("q")).where("y is null")
    return out.select("l_orderkey", "l_linenumber", F.round("imputed", 4).alias("imputed"), F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


_UNIFORM = "(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::bigint / 4294967296.0)"


@_query("weighted_draws", f"""select case when u < 0.2 then 'a' when u < 0.5 then 'b' else 'c' end choice, count(*) n from (select {_UNIFORM.format(seed=3, key="event_id")} u from events) group by 1""")
def weighted_draws(spark, d):
    """Weighted choice with replacement, one seeded draw a row."""
    u = sampling.uniform("event_id", seed=3)
    return table(spark, d, "events").groupBy(sampling.weighted_choice(u, ["a", "b", "c"], [2, 3, 5]).alias("choice")).agg(F.count("*").alias("n"))


@_query("coin_flips", f"""select user_id, count(*) flips, count(*) filter (where {_UNIFORM.format(seed=8, key="event_id")} < 0.5) heads from events group by user_id""")
def coin_flips(spark, d):
    """A seeded coin for every event."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("flips"), F.count_if(sampling.uniform("event_id", seed=8) < 0.5).alias("heads"))


@_query("random_sample", f"""select c_custkey from customer order by {_UNIFORM.format(seed=1, key="c_custkey")}, c_custkey limit 50""")
def random_sample(spark, d):
    """Exactly 50 rows without replacement by a seeded draw."""
    c = table(spark, d, "customer").select("c_custkey")
    return c.orderBy(sampling.uniform("c_custkey", seed=1), "c_custkey").limit(50)


@_query("random_folds", f"""select cast(floor({_UNIFORM.format(seed=5, key="doc_id")} * 5) as integer) fold, count(*) n, sum(quality)::bigint good from labels group by 1""")
def random_folds(spark, d):
    """Labelled rows in five seeded folds."""
    return table(spark, d, "labels").groupBy(F.floor(sampling.uniform("doc_id", seed=5) * 5).cast("int").alias("fold")).agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"))


@_query("population_spread", "select c_mktsegment, round(stddev_pop(c_acctbal), 6) sd, count(*) n from customer group by 1")
def population_spread(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.stddev_pop("c_acctbal"), 6).alias("sd"), F.count("*").alias("n"))


@_query("win_rates_by_type", "select event_type, count(*) n, round(avg(case when value > 50 then 1.0 else 0.0 end), 9) rate from events group by 1")
def win_rates_by_type(spark, d):
    """Success rate of each group."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 50).cast("double")), 9).alias("rate"))


@_query("dropout_scores", """
with x as (select s_suppkey, [s_acctbal / 1000, 1.0, s_nationkey / 10.0] x from supplier),
z as (select s_suppkey, p, list_sum(list_transform(range(0, 3), lambda i: case when ('0x' || substr(md5('11|' || s_suppkey || '|' || p || '|' || i), 1, 8))::bigint / 4294967296.0 < 0.8 then x[i + 1] * ([0.5, -1.0, 2.0])[i + 1] / 0.8 else 0.0 end)) z from x, range(1, 21) r(p))
select s_suppkey, round(avg(z), 7) mean, round(var_pop(z), 7) variance from z group by 1""")
def dropout_scores(spark, d):
    """Mean and variance of a linear score over 20 random masks of its inputs."""
    s = table(spark, d, "supplier").select("s_suppkey", F.array(F.col("s_acctbal") / 1000, F.lit(1.0), F.col("s_nationkey") / F.lit(10.0)).alias("x"))
    return E.rounded(D.dropout(s, "s_suppkey", "x", [0.5, -1.0, 2.0], 0.8, 20, seed=11), 7)


@_query("unigram_bits", """
with c as (select conv_id, turn, unnest(string_split(text, '')) c from conversations), k as (select conv_id, turn, c, count(*) k from c where c <> '' group by all),
m as (select c, sum(k) t from k group by c), w as (select sum(t) s, count(*) n from m), b as (select c, -log2((t + 1) / (s + n)) b from m, w)
select conv_id, turn, sum(k)::bigint n, round(sum(k * b) / sum(k), 7) bits_per_character from k join b using (c) group by conv_id, turn""")
def unigram_bits(spark, d):
    """Bits per character of each text by a model of characters learnt from all of them."""
    out = D.unigram_bits(table(spark, d, "conversations"), ["conv_id", "turn"], "text")
    return out.select("conv_id", "turn", "n", F.round(F.col("bits") / F.col("n"), 7).alias("bits_per_character"))


@_query("model_vote", """select doc_id, ((n_chars > 300)::int + (text like '%the%')::int + (lang = 'en')::int) >= 2 positive, (n_chars > 300)::int + (text like '%the%')::int + (lang = 'en')::int votes
from documents where text is not null and lang is not null and n_chars is not null""")
def model_vote(spark, d):
    """Three different classifiers on one input and their majority."""
    votes = [F.col("n_chars") > 300, F.col("text").contains("the"), F.col("lang") == "en"]
    docs = table(spark, d, "documents").where("text is not null and lang is not null and n_chars is not null")
    return docs.select("doc_id", X.content_filter(F.col("text"), votes).alias("positive"), sum((v.cast("int") for v in votes), F.lit(0)).alias("votes"))
