"""Queries on strings, JSON, validation, linkage and extraction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import jsons, strings
from marlstone.functions.registry import dispatched
from marlstone.operators import extraction as X
from marlstone.operators import linkage as L
from marlstone.operators import validation as V
from marlstone.session import table
from marlstone.sources import search

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@_query("jaro_winkler", """select p_partkey, round(jaro_winkler_similarity(p_name, p_type), 9) jw, round(jaro_winkler_similarity(lower(p_name), lower(p_type)), 9) jw_lower from part""")
def jaro_winkler(spark, d):
    p, a, b = table(spark, d, "part"), F.col("p_name"), F.col("p_type")
    return p.select("p_partkey", F.round(strings.jaro_winkler(a, b), 9).alias("jw"), F.round(strings.jaro_winkler(a, b, True), 9).alias("jw_lower"))


@_query("indel_ratio", """
with recursive p as (select p_partkey, string_split(p_name, '') a, string_split(p_type, '') b from part),
r(p_partkey, i, w) as (select p_partkey, 0, list_transform(b, lambda x: 0) from p union all
  select p.p_partkey, i + 1, list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: case when a[i + 1] = b[k] then 1 + coalesce(w[k - 1], 0) else w[k] end)))
  from r join p using (p_partkey) where i < len(a))
select p_partkey, round(2 * w[len(b)] / (len(a) + len(b)), 9) ratio from r join p using (p_partkey) where i = len(a)""")
def indel_ratio(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.round(strings.indel_ratio(F.col("p_name"), F.col("p_type")), 9).alias("ratio"))


@_query("edit_distance", "select p_partkey, levenshtein(p_name, p_type) distance from part")
def edit_distance(spark, d):
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


def _entities(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal", "s_nationkey")
    nxt = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_name").alias("other"))
    p, q = L.rule_variants(F.col("s_name"), F.col("other"))
    return s.join(nxt, "s_suppkey", "left").select("*", p.alias("p"), q.alias("q"))  # the last has no other, so no negative variants


_LINK = """
with e as (select a.s_suppkey, a.s_name, a.s_acctbal, a.s_nationkey, b.s_name other from supplier a join supplier b on b.s_suppkey = a.s_suppkey + 1),
v as (select s_suppkey, s_name, s_acctbal, s_nationkey, 1 l, 0 k, upper(s_name) n from e union all select s_suppkey, s_name, s_acctbal, s_nationkey, 1, 1, s_name || ' inc' from e
      union all select s_suppkey, s_name, s_acctbal, s_nationkey, 1, 2, regexp_replace(s_name, '\\s+', '-', 'g') from e
      union all select s_suppkey, s_name, s_acctbal, s_nationkey, 0, 0, other from e union all select s_suppkey, s_name, s_acctbal, s_nationkey, 0, 1, other || ' ltd' from e),
s as (select *, jaro_winkler_similarity(lower(s_name), lower(n)) j from v),
r as (select *, row_number() over (partition by s_suppkey, l order by case when l = 1 then j else -j end, k) r from s)
"""


@_query("matched_pairs", _LINK.replace("\\\\", "\\") + "select s_suppkey, s_name name_one, n name_two, round(j, 8) similarity, l \"label\" from r where r = 1")
def matched_pairs(spark, d):
    out = L.matched_pairs(_entities(spark, d), "s_suppkey", "s_name", "p", "q")
    return out.withColumn("similarity", F.round("similarity", 8))


@_query("matched_table", _LINK.replace("\\\\", "\\") + "select s_suppkey, s_acctbal, s_nationkey, s_name name_one, n name_two, l \"label\" from r where r = 1")
def matched_table(spark, d):
    return L.matched_table(_entities(spark, d), "s_suppkey", "s_name", "p", "q", ["s_acctbal", "s_nationkey"])


@_query("same_entity", "select p_partkey, cast(jaro_winkler_similarity(lower(p_name), lower(p_name || ' co')) >= 0.85 as integer) same from part")
def same_entity(spark, d):
    return table(spark, d, "part").select("p_partkey", L.same_entity(F.col("p_name"), F.concat("p_name", F.lit(" co"))).alias("same"))


def _businesses(spark, d):
    """Suppliers as business records, some broken by rule of their key."""
    k = F.col("s_suppkey")
    number = F.lpad((k * 7919 % 1000000000).cast("string"), 9, "0")
    number = F.when(k % 7 == 1, F.concat(number, F.lit("12"))).when(k % 7 == 2, F.concat(F.lit("123abc"), k % 10)).otherwise(number)
    sector = F.element_at(F.array(*[F.lit(x) for x in V.SECTORS]), (k % 24 + 1).cast("int"))
    code = F.when(k % 5 == 3, F.lit("4841")).when(k % 5 == 4, F.lit("991234")).otherwise(F.concat(sector, F.lit("1234")))
    return table(spark, d, "supplier").select(
        F.when(k % 11 != 5, k.cast("string")).alias("id"), k.alias("s_suppkey"), F.when(k % 3 > 0, F.col("s_name")).alias("business_name"), number.alias("business_number"), code.alias("naics_code")
    )


_BUSINESS = """
with b as (select case when s_suppkey % 11 <> 5 then s_suppkey::varchar end id, s_suppkey, case when s_suppkey % 3 > 0 then s_name end business_name,
  case when s_suppkey % 7 = 1 then lpad((s_suppkey * 7919 % 1000000000)::varchar, 9, '0') || '12' when s_suppkey % 7 = 2 then '123abc' || (s_suppkey % 10)
       else lpad((s_suppkey * 7919 % 1000000000)::varchar, 9, '0') end business_number,
  case when s_suppkey % 5 = 3 then '4841' when s_suppkey % 5 = 4 then '991234'
       else (['11','21','22','23','31','32','33','42','44','45','48','49','51','52','53','54','55','56','61','62','71','72','81','92'])[s_suppkey % 24 + 1] || '1234' end naics_code from supplier),
m as (select *, case when id is null then 'Field required' when try_cast(id as bigint) is null then 'Input should be a valid bigint' end e1,
  case when not regexp_full_match(business_number, '[0-9]+') then 'Business number must contain only digits' when length(business_number) <> 9 then 'Business number must be exactly 9 digits' end e2,
  case when not regexp_full_match(naics_code, '[0-9]+') then 'NAICS code must contain only digits' when length(naics_code) <> 6 then 'NAICS code must be exactly 6 digits'
       when left(naics_code, 2) not in ('11','21','22','23','31','32','33','42','44','45','48','49','51','52','53','54','55','56','61','62','71','72','81','92') then 'Invalid NAICS sector code' end e3 from b)
"""


def _rules():
    return [V.coerced("id", "bigint"), V.business_number(), V.industry_code()]


@_query("validate_business", _BUSINESS + """select s_suppkey, coalesce(business_name, 'Unregistered Business') business_name, e1 is null and e2 is null and e3 is null valid,
  concat_ws('; ', 'id: ' || e1, 'business_number: ' || e2, 'naics_code: ' || e3) errors from m""")
def validate_business(spark, d):
    out = V.validated(_businesses(spark, d), _rules())
    text = F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "; ")
    return out.select("s_suppkey", F.coalesce("business_name", F.lit("Unregistered Business")).alias("business_name"), "valid", text.alias("errors"))


@_query("validation_report", _BUSINESS + """, e as (select s_suppkey, 'id' f, e1 x from m where e1 is not null union all select s_suppkey, 'business_number', e2 from m where e2 is not null union all select s_suppkey, 'naics_code', e3 from m where e3 is not null)
select f field, x message, count(*) n from e group by all union all select null, null, count(*) from m where e1 is null and e2 is null and e3 is null""")
def validation_report(spark, d):
    return V.report(_businesses(spark, d), _rules())


@_query("validate_address", """
with a as (select c_custkey, case when c_custkey % 9 = 1 then null when c_custkey % 9 = 2 then 'ABC' else c_custkey::varchar end n,
  case when c_custkey % 8 = 0 then null when c_custkey % 8 = 1 then 'K1A 1A1' when c_custkey % 8 = 2 then 'k1a1a1' when c_custkey % 8 = 3 then 'D1A 1A1' when c_custkey % 8 = 4 then 'K1O 1A1' when c_custkey % 8 = 5 then 'K1A1O1'
       when c_custkey % 8 = 6 then 'K1A 1O1' else 'ABC 123' end p from customer),
b as (select *, upper(trim(p)) u from a)
select c_custkey, case when n is null then 'Field required' when not regexp_full_match(replace(n, ' ', ''), '[0-9]+') then 'Street number must be numeric' end street,
  case when p is null then null when not regexp_full_match(replace(u, ' ', ''), '[A-Z][0-9][A-Z][0-9][A-Z][0-9]') then 'Invalid postal code format' when substr(u, 1, 1) in ('D','F','I','O') then 'Invalid first letter in postal code'
       when substr(u, 3, 1) in ('D','F','I','O','Q','U') then 'Invalid third letter in postal code' when substr(u, 5, 1) in ('D','F','I','O','Q','U') then 'Invalid fifth letter in postal code' end postal from b""")
def validate_address(spark, d):
    k = F.col("c_custkey")
    codes = [None, "K1A 1A1", "k1a1a1", "D1A 1A1", "K1O 1A1", "K1A1O1", "K1A 1O1", "ABC 123"]
    rows = table(spark, d, "customer").select(k, F.when(k % 9 == 1, None).when(k % 9 == 2, "ABC").otherwise(k.cast("string")).alias("street_number"), F.get(F.array(*[F.lit(c) for c in codes]), (k % 8).cast("int")).alias("postal_code"))
    return rows.select("c_custkey", V.street_number().message().alias("street"), V.postal_code().message().alias("postal"))


@_query("json_events", """select event_type, count(*) n, sum(cast(json_extract_string(props, '$.k') as integer)) total, count(*) filter (where cast(json_extract_string(props, '$.k') as integer) > 50) high from events group by 1""")
def json_events(spark, d):
    e = table(spark, d, "events").select("event_type", jsons.parsed(F.col("props"), "k int").alias("r"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("r.k").alias("total"), F.count_if(F.col("r.k") > 50).alias("high"))


@_query("json_field_state", """select event_id, case event_id % 5 when 0 then 'valid' when 1 then 'missing' when 2 then 'null' when 3 then 'invalid' else 'malformed' end state from events""")
def json_field_state(spark, d):
    """Missing, null, invalid and malformed fields told apart, on events' properties broken by rule."""
    k = F.col("event_id") % 5
    j = F.when(k == 0, F.col("props")).when(k == 1, '{"other": 1}').when(k == 2, '{"k": null}').when(k == 3, '{"k": "ABC"}').otherwise("not json")
    return table(spark, d, "events").select("event_id", jsons.state_of(j, "k", "int").alias("state"))


@_query("nested_records", """
select o_custkey, unnest(list(o_orderkey order by o_orderkey)) "key" from orders group by 1""")
def nested_records(spark, d):
    """Orders of a customer as nested JSON, and back to rows."""
    o = table(spark, d, "orders")
    docs = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key")))).alias("orders"))).alias("j"))
    return docs.select("o_custkey", F.inline(jsons.parsed(F.col("j"), "orders array<struct<key long>>")["orders"]))


@_query("object_or_array", "select event_id, cast(json_extract_string(props, '$.k') as integer) k from events where event_id % 2 = 0 union all select event_id, x from (select event_id, unnest([cast(json_extract_string(props, '$.k') as integer), 0]) x from events where event_id % 2 = 1)")
def object_or_array(spark, d):
    e = table(spark, d, "events")
    j = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("["), F.col("props"), F.lit(', {"k": 0}]')))
    return e.select("event_id", F.inline(jsons.parsed(jsons.as_array(j), "array<struct<k int>>")))


@_query("listing_extraction", """
select s_suppkey, 0 as position, s_name as name, 'x' || s_suppkey || '@example.com' as email, case when s_suppkey % 3 = 0 then 'ftp' else 'https' end || '://www.example.com/' || s_suppkey as website,
  case when s_suppkey % 3 = 0 then 'website: Invalid URL' else '' end errors, case when s_suppkey % 3 = 0 then 'validation' end error_class from supplier""")
def listing_extraction(spark, d):
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    text = F.concat(F.lit("Visit "), F.col("s_name"), F.lit("; mail x"), k, F.lit("@example.com; see "), F.when(k % 3 == 0, "ftp").otherwise("https"), F.lit("://www.example.com/"), k, F.lit(" today"))
    provider = X.pattern_provider(r"Visit ([^;]+); mail ([^; ]+); see ([^ ]+)", ["name", "email", "website"])
    out = X.extracted(s.select("s_suppkey", text.alias("t")), "t", provider, "name string, email string, website string", [V.email("email"), V.http_url("website")], "s_suppkey")
    errors = F.array_join(F.transform("errors", lambda e: F.concat(e["field"], F.lit(": "), e["message"])), "; ")
    return out.select("s_suppkey", "position", "name", "email", "website", errors.alias("errors"), "error_class")


@_query("address_kinds", """
with a as (select c_custkey, c_custkey || case c_custkey % 4 when 0 then ' Main St Apt 4' when 1 then ' Plaza Suite 2' when 2 then ' Elm St' else ' House Office Rd' end l from customer)
select c_custkey, case c_custkey % 4 when 0 then 'residential' when 1 then 'commercial' else 'review' end kind, case when c_custkey % 4 < 2 then 'high' else 'low' end certainty, c_custkey % 4 = 1 license from a""")
def address_kinds(spark, d):
    k = F.col("c_custkey")
    line = F.concat(k, F.get(F.array(*[F.lit(x) for x in (" Main St Apt 4", " Plaza Suite 2", " Elm St", " House Office Rd")]), (k % 4).cast("int")))
    kind, certainty = X.address_kind(line)
    return table(spark, d, "customer").select(k, kind.alias("kind"), certainty.alias("certainty"), (kind == "commercial").alias("license"))


@_query("page_headings", r"""select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', '', 'g')) title, len(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)) headings from pages""")
def page_headings(spark, d):
    j = jsons.parsed(X.html_provider(F.col("html")), "title string, headings array<string>")
    return table(spark, d, "pages").select("page_id", j["title"].alias("title"), F.size(j["headings"]).cast("long").alias("headings"))


@_query("rule_entities", r"""select o_orderkey, [strftime(o_orderdate, '%Y-%m-%d')] dates, ['$' || floor(o_totalprice)::bigint] money, [(o_orderkey % 100) || '%'] percentages from orders""")
def rule_entities(spark, d):
    o = table(spark, d, "orders")
    text = F.concat(F.lit("On "), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"), F.lit(" we paid $"), F.floor("o_totalprice"), F.lit(" that is "), F.col("o_orderkey") % 100, F.lit("% more"))
    e = X.entities(text)
    return o.select("o_orderkey", e["dates"].alias("dates"), e["money"].alias("money"), e["percentages"].alias("percentages"))


@_query("content_filter", r"""select conv_id, turn, ((length(text) > 300)::int + (text like '%!%')::int + (text like '%the%')::int) >= 2 blocked from conversations""")
def content_filter(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", X.content_filter(t, [F.length(t) > 300, t.contains("!"), t.contains("the")]).alias("blocked"))


@_query("exact_match", "select round(avg(case when (n_chars > 300) = (quality > 0) then 1.0 else 0.0 end), 9) accuracy, count(*) n from documents join labels using (doc_id)")
def exact_match(spark, d):
    b = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select((F.col("n_chars") > 300).alias("p"), (F.col("quality") > 0).alias("y"))
    return X.exact_match(b, "p", "y").withColumn("accuracy", F.round("accuracy", 9))


@_query("search_papers", r"""select doc_id, score from (select doc_id, cast(len(regexp_extract_all(lower(text), '\bthe\b')) + len(regexp_extract_all(lower(text), '\bof\b')) as bigint) score from documents) where score > 0 order by score desc, doc_id limit 5""")
def search_papers(spark, d):
    return search.relevance(table(spark, d, "documents"), "doc_id", "text", ["the", "of"], 5)


@_query("number_formats", r"""select o_orderkey, replace(lower(o_orderpriority), ' ', '_') path, case when o_totalprice < 0 then '' else '+' end || printf('%.1f', round(o_totalprice / 1000, 1)) signed, printf('%.1f', round(o_totalprice / 10000, 1)) || '%' percent, left(o_orderpriority, 4) head from orders""")
def number_formats(spark, d):
    p = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", strings.topic_path(F.col("o_orderpriority")).alias("path"), strings.signed(F.round(p / 1000, 1)).alias("signed"), strings.percent(F.round(p / 10000, 1)).alias("percent"), F.left("o_orderpriority", F.lit(4)).alias("head"))


@_query("prompts", "select conv_id, turn, concat_ws(chr(10), 'Classify the text.', 'Input: ' || trim(text), 'Polarity: ') prompt from conversations")
def prompts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", strings.prompt("Classify the text.", strings.strip(F.col("text"))).alias("prompt"))


@_query("tool_calls", """select l_orderkey, l_linenumber, case l_linenumber % 4 when 0 then l_quantity + l_partkey when 1 then l_quantity * l_partkey when 2 then case when l_partkey % 5 = 0 then null else l_quantity / (l_partkey % 5) end else l_quantity * 2 end result from lineitem""")
def tool_calls(spark, d):
    k = F.col("l_linenumber") % 4
    name = F.when(k == 0, "add").when(k == 1, "multiply").when(k == 2, "divide").otherwise("double")
    b = F.when(k == 2, F.col("l_partkey") % 5).otherwise(F.col("l_partkey")).cast("double")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", dispatched(name, F.col("l_quantity"), b).alias("result"))


@_query("keyed_lookup", """select c.c_custkey, coalesce(o.n, 0) n, coalesce(p, 'No definition') priority from customer c
left join (select o_custkey, count(*) n, min(o_orderpriority) p from orders group by 1) o on o_custkey = c_custkey""")
def keyed_lookup(spark, d):
    """Lookup with defaults for keys that aren't there."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.min("o_orderpriority").alias("p"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("p", F.lit("No definition")).alias("priority"))


@_query("missing_keys", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def missing_keys(spark, d):
    """Keys that a strict lookup has to report."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@_query("composite_lookup", """select c_custkey, year(o_orderdate) y, 'in ' || year(o_orderdate) || ': ' || count(*) note from customer join orders on o_custkey = c_custkey group by c_custkey, year(o_orderdate)""")
def composite_lookup(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").select("c_custkey").join(o, "c_custkey").select("c_custkey", "y", F.format_string("in %d: %d", "y", "n").alias("note"))


@_query("duplicate_records", "select p_name, count(*) n from part group by 1 having count(*) > 1")
def duplicate_records(spark, d):
    return V.duplicates(table(spark, d, "part"), ["p_name"])


@_query("upsert_latest", """select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) where r = 1""")
def upsert_latest(spark, d):
    """Last write wins."""
    return V.first_per(table(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type")


@_query("timestamps", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') \"day\", year(o_orderdate) y from orders")
def timestamps(spark, d):
    o = table(spark, d, "orders")
    text = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm")
    at = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm"))
    return o.select("o_orderkey", F.date_format(at, "yyyy-MM-dd").alias("day"), F.year(at).cast("long").alias("y"))


@_query("finite_difference", """select round(avg(g), 6) gradient, count(*) n from (select (lead(o_totalprice) over (partition by o_custkey order by o_orderkey) - o_totalprice) / (lead(o_orderkey) over (partition by o_custkey order by o_orderkey) - o_orderkey) g from orders) where g is not null""")
def finite_difference(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    g = (F.lead("o_totalprice").over(w) - F.col("o_totalprice")) / (F.lead("o_orderkey").over(w) - F.col("o_orderkey"))
    return table(spark, d, "orders").select(g.alias("g")).where("g is not null").agg(F.round(F.avg("g"), 6).alias("gradient"), F.count("*").alias("n"))
