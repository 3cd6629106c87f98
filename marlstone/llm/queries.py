"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.llm import decontaminate, html_wrapper, langid, mixing, mtree, near_dup, sharding, toxicity, url_reputation, warc
from marlstone.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def op1_url_filter(spark, d):
    return url_reputation.judged(table(spark, d, "pages"), table(spark, d, "labels"))


def op2_mixing(spark, d):
    out = mixing.mixed(table(spark, d, "documents"), keep=["doc_id"])
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
                      (F.col("__size") * F.col("__times")).alias("taken"))


def op3_near_dup(spark, d):
    out = near_dup.classes(table(spark, d, "documents"))
    return out.select(F.col("k").alias("doc_id"), "class_id", "class_size")


def op4_language(spark, d):
    docs = table(spark, d, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    net = langid.train(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), langid.predicted(docs, net).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )


def op5_html_text(spark, d):
    return html_wrapper.extracted(table(spark, d, "pages"))


def op6_warc(spark, d):
    return warc.round_trip(table(spark, d, "pages"))


def op7_decontaminate(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", decontaminate.judged(docs, table(spark, d, "benchmark")).alias("r")).select("doc_id", "r.*")


def op8_sharding(spark, d):
    out = sharding.sharded(table(spark, d, "documents"), keep=["doc_id"])
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("__shard").alias("shard"),
                      F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_top_k(spark, d):
    return mtree.top(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op10_toxicity(spark, d):
    docs = table(spark, d, "documents")
    model = toxicity.train(docs, table(spark, d, "labels"))
    return docs.select("doc_id", toxicity.scored(docs, model).alias("r")).select("doc_id", "r.*")


QUERIES |= {f.__name__: f for f in (op1_url_filter, op2_mixing, op3_near_dup, op4_language, op5_html_text, op6_warc, op7_decontaminate, op8_sharding, op9_top_k, op10_toxicity)}

ORACLES["op7_decontaminate"] = r"""
with item as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') w from benchmark where text is not null),
win as (select distinct item_id, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') s, least(13, len(w)) n
        from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) i from item where len(w) > 0)),
doc as (select doc_id, row_number() over () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') w from documents),
gram as (select r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') s
         from (select r, w, n, unnest(range(1, len(w) - n + 2)) i from doc, (select distinct n from win) where len(w) >= n)),
occ as (select r, i, g.n, item_id from gram g join win on win.s = g.s and win.n = g.n),
hit as (select r, count(distinct p) h from (select r, unnest(range(i, i + n)) p from occ) group by r),
its as (select r, count(*) k, string_agg(x, ',' order by x) l from (select distinct r, cast(item_id as varchar) x from occ) group by r)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(h, 0) as bigint) n_hit, cast(coalesce(k, 0) as bigint) n_items,
  sha256(coalesce(l, '')) items_sha256, coalesce(h, 0) > 0 and 20 * coalesce(h, 0) >= len(w) contaminated
from doc left join hit using (r) left join its using (r)
"""

# SHA-1 as 40 hex digits, each five of them four base32 letters
ORACLES["op6_warc"] = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
h as (select page_id, octet_length(b) n, sha1(b) h, max(page_id) over (partition by sha1(b)) first from p),
v as (select *, list_transform(range(8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::integer) v from h)
select page_id, cast(n as bigint) payload_bytes,
  array_to_string(flatten(list_transform(v, lambda x: list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> s) % 32 + 1, 1)))), '') payload_digest,
  case when page_id is not distinct from first then 'response' else 'revisit' end record_type, case when page_id is distinct from first then first end refers_to from v
"""

ORACLES["op9_top_k"] = """
with v as (select vec_id, list_transform(embedding, lambda c: floor(256 * cast(c as double))) v, len(embedding) n from embeddings
           where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0),
s as (select q.vec_id query_id, x.vec_id, cast(list_inner_product(q.v, x.v) as bigint) score
      from v q join v x on q.vec_id <> x.vec_id and q.n = x.n where q.vec_id % 50 = 0)
select query_id, cast(r as integer) "rank", vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) r from s) where r <= 5
"""

ORACLES["op1_url_filter"] = r"""
with p as (select page_id, url, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages),
h as (select page_id, url, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) path from p),
l as (select doc_id page_id, case when toxic > 0 or quality <= 0 then 1 else 0 end bad from labels where (toxic > 0 or quality <= 0) is not null and doc_id is not null),
told as (select host, count(*) n, sum(bad) bad from h join l using (page_id) group by host),
hosts as (select host, coalesce(n, 0) n, coalesce(bad, 0) bad, list_extract(string_split(host, '.'), -1) suffix,
            array_to_string(list_slice(string_split(host, '.'), greatest(len(string_split(host, '.')) - 2, 1), len(string_split(host, '.'))), '.') dom
          from (select distinct host from h) left join told using (host)),
doms as (select dom, suffix, sum(n) n, sum(bad) bad from hosts group by all),
sufs as (select suffix, sum(n) n, sum(bad) bad from doms group by all),
m0 as (select (sum(bad) + 0.5) / (sum(n) + 1.0) prior from sufs),
a1 as (select suffix, n, bad, prior from sufs, m0),
k1 as (select sum(case when n > 0 then (bad - n * prior) * (bad - n * prior) / n end) s, sum(case when n > 0 then prior * (1 - prior) end) e,
         sum(case when n > 0 then (n - 1) * prior * (1 - prior) end) f from a1),
s1 as (select case when f > 0 and (s - e) / f > 0 then least(greatest((1 - (s - e) / f) / ((s - e) / f), 1.0), 200.0) else 200.0 end k from k1),
m1 as (select suffix, (prior * k + bad) / (k + n) prior from a1, s1),
a2 as (select dom, n, bad, prior from doms join m1 using (suffix)),
k2 as (select sum(case when n > 0 then (bad - n * prior) * (bad - n * prior) / n end) s, sum(case when n > 0 then prior * (1 - prior) end) e,
         sum(case when n > 0 then (n - 1) * prior * (1 - prior) end) f from a2),
s2 as (select case when f > 0 and (s - e) / f > 0 then least(greatest((1 - (s - e) / f) / ((s - e) / f), 1.0), 200.0) else 200.0 end k from k2),
m2 as (select dom, (prior * k + bad) / (k + n) prior from a2, s2),
a3 as (select host, n, bad, prior from hosts join m2 using (dom)),
k3 as (select sum(case when n > 0 then (bad - n * prior) * (bad - n * prior) / n end) s, sum(case when n > 0 then prior * (1 - prior) end) e,
         sum(case when n > 0 then (n - 1) * prior * (1 - prior) end) f from a3),
s3 as (select case when f > 0 and (s - e) / f > 0 then least(greatest((1 - (s - e) / f) / ((s - e) / f), 1.0), 200.0) else 200.0 end k from k3),
m3 as (select host, (prior * k + bad) a, ((1 - prior) * k + n - bad) b from a3, s3),
rep as (select host, a / (a + b) - 1.0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.3 blocked from m3),
rules(rh, rp, rv) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fit as (select page_id, host, path, blocked,
          (select arg_max(rh || rp, length(rh || rp)) from rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)) rule,
          (select arg_max(rv, length(rh || rp)) from rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)) rv
        from h join rep using (host))
select page_id, host, path, rule, coalesce(rv, case when blocked then 'block' else 'allow' end) verdict from fit
"""
