"""Queries on survey and prediction-powered estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import estimators as E
from marlstone.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    score = (F.col("n_chars") >= 400).cast("double").alias("f")
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("y"), "toxic")
    both = docs.join(labels, "doc_id").select("doc_id", "lang", "y", "toxic", score, "n_chars")
    rest = docs.join(labels, "doc_id", "left_anti").select("doc_id", "lang", score, "n_chars")
    return both, rest


_PPI_SQL = """
with l as (select d.doc_id, d.lang, cast(quality as double) y, case when n_chars >= 400 then 1.0 else 0.0 end f
           from documents d join labels using (doc_id)),
u as (select d.doc_id, d.lang, case when n_chars >= 400 then 1.0 else 0.0 end f
      from documents d where not exists (select 1 from labels x where x.doc_id = d.doc_id)),
a as (select count(*) n, avg(y) my, avg(f - y) mr, var_samp(y) vy, var_samp(f - y) vr from l),
b as (select count(*) nn, avg(f) mf, var_samp(f) vf from u)
"""


def ppi_mean(spark, d):
    both, rest = _labelled(spark, d)
    return E.rounded(E.ppi_mean(both, rest, "y", "f"), 9)


QUERIES["ppi_mean"] = ppi_mean
ORACLES["ppi_mean"] = _PPI_SQL + """
select n, nn as n_unlabelled, round(my, 9) theta_classical, round(1.96 * sqrt(vy / n), 9) half_classical,
  round(mf - mr, 9) theta_pp, round(sqrt(vr / n + vf / nn), 9) se,
  round(mf - mr - 1.96 * sqrt(vr / n + vf / nn), 9) ci_lo, round(mf - mr + 1.96 * sqrt(vr / n + vf / nn), 9) ci_hi
from a, b"""


def _survey(spark, d):
    """Customers with their orders' total as y and account balance as z; every 20th is the sample, weight N/n."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("z"), "c_mktsegment")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.sum("o_totalprice") / 1000).alias("y"))
    u = c.join(o, "c_custkey", "left").na.fill(0.0, ["y"])
    return u, u.where("c_custkey % 20 = 0").withColumn("w", F.lit(20.0))


_SURVEY = """
with u as (select c_custkey, c_acctbal / 1000 z, c_mktsegment, coalesce(y, 0) y from customer left join
           (select o_custkey, sum(o_totalprice) / 1000 y from orders group by o_custkey) on o_custkey = c_custkey),
s as (select *, 20.0 w from u where c_custkey % 20 = 0),
m as (select sum(w) s, sum(w*z) sz, sum(w*y) sy, sum(w*z*z) szz, sum(w*z*y) szy from s),
f as (select (s*szy - sz*sy) / (s*szz - sz*sz) b, sy / s - (s*szy - sz*sy) / (s*szz - sz*sz) * sz / s a from m)
"""


def survey_totals(spark, d):
    u, s = _survey(spark, d)
    greg = E.greg_total(u, s, "y", "z", "w")
    rows = [
        E.expansion_total(s, "y", "w").select(F.lit("expansion").alias("estimator"), F.lit(0.0).alias("predicted"), F.col("total").alias("correction"), "total"),
        E.difference_total(u, s, "y", "z", "w", 300.0).select(F.lit("difference").alias("estimator"), "predicted", "correction", "total"),
        E.difference_total(u, s, "y", "z", "w", 1.0).select(F.lit("year_over_year").alias("estimator"), "predicted", "correction", "total"),
        greg.select(F.lit("greg").alias("estimator"), "predicted", "correction", "total"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return E.rounded(out, 4)


QUERIES["survey_totals"] = survey_totals
ORACLES["survey_totals"] = _SURVEY + """
select 'expansion' estimator, 0.0::double predicted, round(sum(w*y), 4) correction, round(sum(w*y), 4) total from s
union all select 'difference', round((select sum(z)*300 from u), 4), round(sum(w*(y-z*300)), 4), round((select sum(z)*300 from u) + sum(w*(y-z*300)), 4) from s
union all select 'year_over_year', round((select sum(z) from u), 4), round(sum(w*(y-z)), 4), round((select sum(z) from u) + sum(w*(y-z)), 4) from s
union all select 'greg', round((select sum(a+b*z) from u, f), 4), round(sum(w*(y-a-b*z)), 4) + 0.0, round((select sum(a+b*z) from u, f) + sum(w*(y-a-b*z)), 4) from s, f"""


def survey_error(spark, d):
    u, _ = _survey(spark, d)
    truth = u.agg(F.sum("y")).first()[0]
    return E.rounded(E.against_truth(survey_totals(spark, d).select("estimator", "total"), truth), 3)


QUERIES["survey_error"] = survey_error
ORACLES["survey_error"] = _SURVEY + """, t as (select sum(y) truth from u),
e as (select 'expansion' estimator, sum(w*y) total from s
union all select 'difference', (select sum(z)*300 from u) + sum(w*(y-z*300)) from s
union all select 'year_over_year', (select sum(z) from u) + sum(w*(y-z)) from s
union all select 'greg', (select sum(a+b*z) from u, f) + sum(w*(y-a-b*z)) from s, f)
select estimator, round(round(total, 4), 3) total, round(round(total, 4) - truth, 3) error, round(100 * (round(total, 4) - truth) / truth, 3) percent from e, t"""


def calibration(spark, d):
    u, s = _survey(spark, d)
    out = E.calibrated(u, s, "z", "w").agg(F.sum("calibrated_w").alias("count"), F.sum(F.col("calibrated_w") * F.col("z")).alias("total_z"), F.sum(F.col("calibrated_w") * F.col("y")).alias("total_y"))
    return E.rounded(out, 4)


QUERIES["calibration"] = calibration
ORACLES["calibration"] = _SURVEY + """
select round(count(*)::double, 4) count, round(sum(z), 4) total_z, round((select sum(a+b*z) from u, f) + (select sum(w*(y-a-b*z)) from s, f), 4) total_y from u"""


def model_calibrated(spark, d):
    u, s = _survey(spark, d)
    p = F.col("z") * F.col("z") + 5
    return E.rounded(E.model_calibrated_total(u.withColumn("p", p), s.withColumn("p", p), "y", "p", "w"), 4)


QUERIES["model_calibrated"] = model_calibrated
ORACLES["model_calibrated"] = _SURVEY + """
select round((select sum(z*z+5) from u), 4) predicted,
  round(sum(w*y) + ((select sum(z*z+5) from u) - sum(w*(z*z+5))) / sum(w*(z*z+5)*(z*z+5)) * sum(w*(z*z+5)*y), 4) total from s"""


def augmented_greg(spark, d):
    u, s = _survey(spark, d)
    p = F.col("z") * F.col("z") + 5
    return E.rounded(E.augmented_total(u.withColumn("p", p), s.withColumn("p", p), "y", "z", "p", "w"), 4)


QUERIES["augmented_greg"] = augmented_greg
ORACLES["augmented_greg"] = _SURVEY + """,
n as (select sum(w*z*z) aa, sum(w*z*(z*z+5)) ab, sum(w*(z*z+5)*(z*z+5)) bb, sum(w*z*y) ay, sum(w*(z*z+5)*y) yb, sum(w*z) a, sum(w*(z*z+5)) b, sum(w*y) sy from s),
c as (select (ay*bb - yb*ab)/(aa*bb-ab*ab) b1, (yb*aa - ay*ab)/(aa*bb-ab*ab) b2 from n)
select round(b1, 4) b1, round(b2, 4) b2, round(sy + b1*((select sum(z) from u)-a) + b2*((select sum(z*z+5) from u)-b), 4) total from n, c"""


def survey_describe(spark, d):
    from marlstone.operators.sampling import described

    return E.rounded(described(_survey(spark, d)[1], "y"), 6)


QUERIES["survey_describe"] = survey_describe
ORACLES["survey_describe"] = _SURVEY + """
select count(y) count, round(avg(y), 6) mean, round(stddev_samp(y), 6) std, round(min(y), 6) min, round(quantile_cont(y, 0.25), 6) p25,
  round(quantile_cont(y, 0.5), 6) p50, round(quantile_cont(y, 0.75), 6) p75, round(max(y), 6) max from s"""


def ppi_exceedance(spark, d):
    """Share of toxic documents by text length: the rectifier added, its own set and the full interval."""
    both, rest = _labelled(spark, d)
    t = (F.col("toxic") > 0).cast("double")
    return E.rounded(E.rectified(both, rest, t, (F.col("n_chars") > 2500).cast("double")), 9)


QUERIES["ppi_exceedance"] = ppi_exceedance
ORACLES["ppi_exceedance"] = """
with l as (select case when toxic > 0 then 1.0 else 0.0 end g, case when n_chars > 2500 then 1.0 else 0.0 end f from documents join labels using (doc_id)),
u as (select case when n_chars > 2500 then 1.0 else 0.0 end f from documents d where not exists (select 1 from labels x where x.doc_id = d.doc_id)),
a as (select count(*) n, avg(g - f) delta, var_samp(g - f) v from l), b as (select count(*) nn, avg(f) m, var_samp(f) vf from u)
select round(delta, 9) delta, round(delta - 1.96*sqrt(v/n), 9) r_lo, round(delta + 1.96*sqrt(v/n), 9) r_hi, round(m + delta, 9) theta,
  round(m + delta - 1.96*sqrt(v/n + vf/nn), 9) lo, round(m + delta + 1.96*sqrt(v/n + vf/nn), 9) hi from a, b"""


def ppi_moment(spark, d):
    """E[XY] for X the length in thousands and Y the quality."""
    both, rest = _labelled(spark, d)
    x = F.col("n_chars") / 1000.0
    return E.rounded(E.rectified(both, rest, x * F.col("y"), x * F.col("f")), 8)


QUERIES["ppi_moment"] = ppi_moment
ORACLES["ppi_moment"] = """
with l as (select n_chars / 1000.0 * quality::double g, n_chars / 1000.0 * (case when n_chars >= 400 then 1.0 else 0.0 end)::double f from documents join labels using (doc_id)),
u as (select n_chars / 1000.0 * (case when n_chars >= 400 then 1.0 else 0.0 end)::double f from documents d where not exists (select 1 from labels x where x.doc_id = d.doc_id)),
a as (select count(*) n, avg(g - f) delta, var_samp(g - f) v from l), b as (select count(*) nn, avg(f) m, var_samp(f) vf from u)
select round(delta, 8) delta, round(delta - 1.96*sqrt(v/n), 8) r_lo, round(delta + 1.96*sqrt(v/n), 8) r_hi, round(m + delta, 8) theta,
  round(m + delta - 1.96*sqrt(v/n + vf/nn), 8) lo, round(m + delta + 1.96*sqrt(v/n + vf/nn), 8) hi from a, b"""


def ppi_by_language(spark, d):
    both, rest = _labelled(spark, d)
    return E.rounded(E.ppi_mean(both, rest, "y", "f", by="lang"), 9)


QUERIES["ppi_by_language"] = ppi_by_language
ORACLES["ppi_by_language"] = _PPI_SQL.replace("count(*) n,", "lang, count(*) n,").replace("from l)", "from l group by lang)").replace("count(*) nn,", "lang, count(*) nn,").replace("from u)", "from u group by lang)") + """
select lang, n, nn as n_unlabelled, round(my, 9) theta_classical, round(1.96 * sqrt(vy / n), 9) half_classical,
  round(mf - mr, 9) theta_pp, round(sqrt(vr / n + vf / nn), 9) se,
  round(mf - mr - 1.96 * sqrt(vr / n + vf / nn), 9) ci_lo, round(mf - mr + 1.96 * sqrt(vr / n + vf / nn), 9) ci_hi
from a join b using (lang)"""


def ppi_crossfit(spark, d):
    both, rest = _labelled(spark, d)
    x = (F.col("n_chars") / 1000.0).alias("x")
    return E.rounded(E.crossfit_ppi(both.select("doc_id", "y", x), rest.select(x), "y", "x", (F.col("doc_id") % 5).cast("int"), 5), 8)


QUERIES["ppi_crossfit"] = ppi_crossfit
ORACLES["ppi_crossfit"] = """
with l as (select d.doc_id % 5 k, n_chars / 1000.0::double x, quality::double y from documents d join labels using (doc_id)),
u as (select n_chars / 1000.0::double x from documents d where not exists (select 1 from labels q where q.doc_id = d.doc_id)),
f as (select k, regr_slope(y, x) b, regr_intercept(y, x) a from (select q.k, l.x, l.y from (select distinct k from l) q join l on l.k <> q.k) group by k),
r as (select avg(y - a - b*x) r from l join f using (k)), c as (select avg(a) a, avg(b) b from f)
select round(a + b * (select avg(x) from u), 8) predicted, round(r, 8) rectifier, round(a + b * (select avg(x) from u) + r, 8) theta from c, r"""


def ppi_logistic_set(spark, d):
    both, rest = _labelled(spark, d)
    x = (F.col("n_chars") / 1000.0).alias("x")
    grid = spark.range(81).select((F.floor(F.col("id") / 9) * 0.5).alias("t0"), ((F.col("id") % 9) * 0.25 - 1).alias("t1"))
    return E.logistic_set(both.select("y", "f", x), rest.select("f", x), "y", "f", "x", grid)


QUERIES["ppi_logistic_set"] = ppi_logistic_set
ORACLES["ppi_logistic_set"] = """
with l as (select quality::double y, (case when n_chars >= 400 then 1.0 else 0.0 end)::double f, (n_chars / 1000.0)::double x from documents join labels using (doc_id)),
u as (select (case when n_chars >= 400 then 1.0 else 0.0 end)::double f, (n_chars / 1000.0)::double x from documents d where not exists (select 1 from labels q where q.doc_id = d.doc_id)),
g as (select (i // 9) * 0.5::double t0, (i % 9) * 0.25::double - 1 t1 from range(81) r(i)),
m as (select t0, t1, avg(p) m0, avg(p*x) m1, var_samp(p) v0, var_samp(p*x) v1, count(*) nn from (select t0, t1, x, 1/(1+exp(-(t0+t1*x))) - f p from g, u) group by t0, t1),
r as (select avg(f-y) r0, avg((f-y)*x) r1, var_samp(f-y) w0, var_samp((f-y)*x) w1, count(*) n from l)
select t0, t1 from m, r where abs(m0+r0) <= 1.96*sqrt(v0/nn+w0/n) and abs(m1+r1) <= 1.96*sqrt(v1/nn+w1/n)"""


def ppi_efficiency(spark, d):
    both, _ = _labelled(spark, d)
    return E.rounded(E.relative_efficiency(both, "y", "f", 0.5), 9)


QUERIES["ppi_efficiency"] = ppi_efficiency
ORACLES["ppi_efficiency"] = """
select round(r, 9) rho, round((1 + 0.5*(1-r*r)) / (1-r*r), 9) efficiency from (select corr(quality::double, case when n_chars >= 400 then 1.0 else 0.0 end) r from documents join labels using (doc_id))"""


def imputation_pipeline(spark, d):
    """Edit order prices, impute by priority, allocate; and how the allocation correlates with its input."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    out = E.edited_imputed_allocated(o, "o_totalprice", F.col("o_totalprice") > 400000, "o_orderpriority", 10.0, 0.25)
    return E.rounded(out.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("edited").alias("kept"), F.avg("imputed").alias("imputed"), F.avg("allocated").alias("allocated"), F.regr_slope("allocated", "imputed").alias("slope")), 4)


QUERIES["imputation_pipeline"] = imputation_pipeline
ORACLES["imputation_pipeline"] = """
with e as (select o_orderpriority, case when not o_totalprice > 400000 then o_totalprice end edited from orders),
i as (select *, coalesce(edited, avg(edited) over (partition by o_orderpriority)) imputed from e)
select o_orderpriority, count(*) n, count(edited) kept, round(avg(imputed), 4) imputed, round(avg(10 + 0.25*imputed), 4) allocated, round(regr_slope(10 + 0.25*imputed, imputed), 4) slope from i group by 1"""


def imputation_variance(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 10).alias("rep"), (F.col("o_totalprice") / 1000).alias("v"))
    return E.rounded(E.total_variance(o, "rep", "v"), 5)


QUERIES["imputation_variance"] = imputation_variance
ORACLES["imputation_variance"] = """
select round(avg(s), 5) "within", round(var_samp(m), 5) "between", round(avg(s) + var_samp(m), 5) total from (select o_orderkey % 10 rep, avg(o_totalprice/1000) m, var_samp(o_totalprice/1000) s from orders group by 1)"""


def ppi_forest(spark, d):
    """Prediction-powered total with a forest of ten trees fitted on the sample. Rows only: no SQL."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    u, s = _survey(spark, d)
    v = VectorAssembler(inputCols=["z"], outputCol="x")
    model = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=10, seed=42).fit(v.transform(s))
    a = model.transform(v.transform(u)).agg(F.sum("prediction").alias("predicted"))
    b = model.transform(v.transform(s)).agg(F.sum(F.col("w") * (F.col("y") - F.col("prediction"))).alias("correction"))
    return a.crossJoin(b).withColumn("total", F.col("predicted") + F.col("correction"))


QUERIES["ppi_forest"] = ppi_forest
