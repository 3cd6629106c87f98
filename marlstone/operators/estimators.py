"""Survey and prediction-powered estimators as aggregations.

All take DataFrames and column names and return one row (or one a group): the relations are read
once each, combined map-side, and only one-row results meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z95 = 1.96


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded, for comparing results across engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql_round(x: Column, digits: int) -> Column:
    """A double rounded as the SQL side does it: scaled, to the next whole number (halves away from 0), scaled back.

    The sign stays where nothing else does (-0.0), which F.round turns into 0.0. Doubles too large to be scaled stay as they are.
    """
    scale = F.lit(10.0**digits)
    scaled = F.abs(x) * scale
    return F.when(scaled == float("inf"), x).otherwise(F.signum(x) * F.round(scaled) / scale)


def ppi_mean(labelled: DataFrame, unlabelled: DataFrame, y: str, f: str, z: float = Z95, by: str | None = None) -> DataFrame:
    """Mean of y by classical and by prediction-powered inference, with intervals.

    labelled has y and the prediction f, unlabelled has f. With by, one row for each of its
    values that both sides have.
    """
    keys = [by] if by else []
    a = labelled.groupBy(*keys).agg(
        F.count(y).alias("n"), F.avg(y).alias("my"), F.avg(F.col(f) - F.col(y)).alias("mr"), F.var_samp(y).alias("vy"), F.var_samp(F.col(f) - F.col(y)).alias("vr")
    )
    b = unlabelled.groupBy(*keys).agg(F.count(f).alias("n_unlabelled"), F.avg(f).alias("mf"), F.var_samp(f).alias("vf"))
    both = a.join(b, by) if by else a.crossJoin(b)  # one row each
    se = F.sqrt(F.col("vr") / F.col("n") + F.col("vf") / F.col("n_unlabelled"))
    theta = F.col("mf") - F.col("mr")
    return both.select(
        *keys, "n", "n_unlabelled", F.col("my").alias("theta_classical"), (z * F.sqrt(F.col("vy") / F.col("n"))).alias("half_classical"),
        theta.alias("theta_pp"), se.alias("se"), (theta - z * se).alias("ci_lo"), (theta + z * se).alias("ci_hi"),
    )


def ppi_tuned_mean(labelled: DataFrame, unlabelled: DataFrame, y: str, f: str, z: float = Z95) -> DataFrame:
    """Power-tuned mean: my + lam (mf_unlabelled - mf_labelled), lam of least variance, with its interval.

    lam = cov(y, f) / ((1 + n / N) var f over both); 0 is the classical mean, 1 the prediction-powered one.
    """
    a = labelled.agg(F.count(y).alias("n"), F.avg(y).alias("my"), F.avg(f).alias("ml"), F.covar_samp(y, f).alias("c"), F.var_samp(y).alias("vy"), F.var_samp(f).alias("vl"))
    b = unlabelled.agg(F.count(f).alias("n_unlabelled"), F.avg(f).alias("mu"))
    v = labelled.select(f).unionByName(unlabelled.select(f)).agg(F.var_samp(f).alias("vf"))
    both = a.crossJoin(b).crossJoin(v)  # one row each
    lam = F.col("c") / ((1 + F.col("n") / F.col("n_unlabelled")) * F.col("vf"))
    both = both.withColumn("lam", F.coalesce(F.when(F.col("vf") > 0, lam), F.lit(0.0)))
    L = F.col("lam")
    se = F.sqrt((F.col("vy") - 2 * L * F.col("c") + L * L * F.col("vl")) / F.col("n") + L * L * F.col("vf") / F.col("n_unlabelled"))
    theta = F.col("my") + L * (F.col("mu") - F.col("ml"))
    return both.select("n", "n_unlabelled", "lam", theta.alias("theta"), se.alias("se"), (theta - z * se).alias("ci_lo"), (theta + z * se).alias("ci_hi"))


def design_weights(population: DataFrame, sample: DataFrame, by: list[str] | None = None, name: str = "w") -> DataFrame:
    """sample with the weight N / n of its stratum (of everything without by), from the counts of both."""
    by = by or []
    N, n = population.groupBy(*by).agg(F.count("*").alias("__all")), sample.groupBy(*by).agg(F.count("*").alias("__some"))
    both = N.join(n, by) if by else N.crossJoin(n)  # a row a stratum
    out = sample.join(both, by) if by else sample.crossJoin(F.broadcast(both))
    return out.withColumn(name, F.col("__all") / F.col("__some")).drop("__all", "__some")


# --- Design-based totals. Every function makes one pass over the population U and one over the
# --- sample S and joins two one-row results.


def _one(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.crossJoin(F.broadcast(b))  # one row each


def expansion_total(sample: DataFrame, y: str, w: str) -> DataFrame:
    """Design-weighted total: sum of w y."""
    return sample.agg(F.sum(F.col(w) * F.col(y)).alias("total"), F.count("*").alias("n"))


def difference_total(population: DataFrame, sample: DataFrame, y: str, z: str, w: str, b0: float) -> DataFrame:
    """Sum over U of b0 z, plus the weighted residuals of S. b0 = 1 with last year's z: year-over-year change."""
    u = population.agg((F.sum(z) * F.lit(b0)).alias("predicted"))
    s = sample.agg(F.sum(F.col(w) * (F.col(y) - F.col(z) * F.lit(b0))).alias("correction"))
    return _one(u, s).withColumn("total", F.col("predicted") + F.col("correction"))


def regression(sample: DataFrame, y: str, z: str, w: str) -> DataFrame:
    """Weighted least squares of y on (1, z) from weighted moments: (intercept, slope), one row.

    A constant z gives slope 0 and the mean as intercept.
    """
    W, Z, Y = F.col(w), F.col(z), F.col(y)
    m = sample.where(Z.isNotNull() & Y.isNotNull()).agg(F.sum(W).alias("s"), F.sum(W * Z).alias("sz"), F.sum(W * Y).alias("sy"), F.sum(W * Z * Z).alias("szz"), F.sum(W * Z * Y).alias("szy"))
    det = F.col("s") * F.col("szz") - F.col("sz") * F.col("sz")
    slope = F.coalesce(F.when(det != 0, (F.col("s") * F.col("szy") - F.col("sz") * F.col("sy")) / det), F.lit(0.0))
    return m.withColumn("slope", slope).select(((F.col("sy") - F.col("slope") * F.col("sz")) / F.col("s")).alias("intercept"), "slope")


def greg_total(population: DataFrame, sample: DataFrame, y: str, z: str, w: str) -> DataFrame:
    """Generalised regression: fit on S, predict on U, add weighted residuals."""
    fit = regression(sample, y, z, w)
    u = population.agg(F.count("*").alias("n_u"), F.sum(z).alias("z_u"))
    W, Z, Y = F.col(w), F.col(z), F.col(y)
    s = _one(sample, fit).agg(F.sum(W * (Y - F.col("intercept") - F.col("slope") * Z)).alias("correction"))
    out = _one(_one(u, fit), s).withColumn("predicted", F.col("intercept") * F.col("n_u") + F.col("slope") * F.col("z_u"))
    return out.select("intercept", "slope", "predicted", "correction", (F.col("predicted") + F.col("correction")).alias("total"))


def calibrated(population: DataFrame, sample: DataFrame, z: str, w: str) -> DataFrame:
    """sample with g-weights: ``calibrated_w`` reproduces the population's count and total of z exactly."""
    W, Z = F.col(w), F.col(z)
    u = population.agg(F.count("*").cast("double").alias("n_u"), F.sum(z).alias("z_u"))
    m = sample.agg(F.sum(W).alias("s"), F.sum(W * Z).alias("sz"), F.sum(W * Z * Z).alias("szz"))
    det = F.col("s") * F.col("szz") - F.col("sz") * F.col("sz")
    d0, d1 = F.col("n_u") - F.col("s"), F.col("z_u") - F.col("sz")
    lam = _one(u, m).select(((d0 * F.col("szz") - d1 * F.col("sz")) / det).alias("l0"), ((d1 * F.col("s") - d0 * F.col("sz")) / det).alias("l1"))
    return _one(sample, lam).withColumn("calibrated_w", W * (1 + F.col("l0") + F.col("l1") * Z)).drop("l0", "l1")


def model_calibrated_total(population: DataFrame, sample: DataFrame, y: str, p: str, w: str) -> DataFrame:
    """Weights nearest to w (chi-square distance) whose total of predictions p is the population's."""
    W, P, Y = F.col(w), F.col(p), F.col(y)
    u = population.agg(F.sum(p).alias("p_u"))
    m = sample.agg(F.sum(W * P).alias("sp"), F.sum(W * P * P).alias("spp"), F.sum(W * Y).alias("sy"), F.sum(W * P * Y).alias("spy"))
    lam = (F.col("p_u") - F.col("sp")) / F.col("spp")
    return _one(u, m).select(F.col("p_u").alias("predicted"), (F.col("sy") + lam * F.col("spy")).alias("total"))


def augmented_total(population: DataFrame, sample: DataFrame, y: str, z1: str, z2: str, w: str) -> DataFrame:
    """GREG on two auxiliaries without intercept, such as [z, prediction], by 2 x 2 normal equations."""
    W, A, B, Y = F.col(w), F.col(z1), F.col(z2), F.col(y)
    m = sample.agg(F.sum(W * A * A).alias("aa"), F.sum(W * A * B).alias("ab"), F.sum(W * B * B).alias("bb"), F.sum(W * A * Y).alias("ay"), F.sum(W * B * Y).alias("by_"), F.sum(W * A).alias("a"), F.sum(W * B).alias("b"), F.sum(W * Y).alias("sy"))
    u = population.agg(F.sum(z1).alias("a_u"), F.sum(z2).alias("b_u"))
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    b1 = (F.col("ay") * F.col("bb") - F.col("by_") * F.col("ab")) / det
    b2 = (F.col("by_") * F.col("aa") - F.col("ay") * F.col("ab")) / det
    both = _one(u, m).withColumns({"b1": b1, "b2": b2})
    return both.select("b1", "b2", (F.col("sy") + F.col("b1") * (F.col("a_u") - F.col("a")) + F.col("b2") * (F.col("b_u") - F.col("b"))).alias("total"))


def rectified(labelled: DataFrame, unlabelled: DataFrame, g_true, g_pred, z: float = Z95) -> DataFrame:
    """Mean of any g by prediction-powered inference, the rectifier g(Y) - g(f) added.

    g_true and g_pred are Columns over labelled; g_pred also over unlabelled. (r_lo, r_hi) is the
    rectifier's own set, which leaves out the unlabelled part's variance; (lo, hi) has both.
    """
    a = labelled.agg(F.count(g_true).alias("n"), F.avg(g_true - g_pred).alias("delta"), F.var_samp(g_true - g_pred).alias("v"))
    b = unlabelled.agg(F.count(g_pred).alias("nn"), F.avg(g_pred).alias("m"), F.var_samp(g_pred).alias("vf"))
    r = z * F.sqrt(F.col("v") / F.col("n"))
    h = z * F.sqrt(F.col("v") / F.col("n") + F.col("vf") / F.col("nn"))
    theta = F.col("m") + F.col("delta")
    return _one(a, b).select("delta", (F.col("delta") - r).alias("r_lo"), (F.col("delta") + r).alias("r_hi"), theta.alias("theta"), (theta - h).alias("lo"), (theta + h).alias("hi"))


def relative_efficiency(df: DataFrame, y: str, f: str, ratio: float) -> DataFrame:
    """Correlation rho of y and f, and (1 + ratio (1 - rho^2)) / (1 - rho^2); null where rho^2 = 1."""
    rest = 1 - F.col("rho") * F.col("rho")
    return df.agg(F.corr(y, f).alias("rho")).withColumn("efficiency", F.when(rest > 1e-12, (1 + F.lit(ratio) * rest) / rest))


def crossfit_ppi(labelled: DataFrame, unlabelled: DataFrame, y: str, z: str, fold, folds: int) -> DataFrame:
    """PPI mean where each fold's rectifier uses a line fitted on the other folds, all from moments.

    fold: a Column over labelled with values 0..folds-1. The unlabelled prediction is the mean of
    the folds' lines.
    """
    Z, Y = F.col(z), F.col(y)
    per = labelled.withColumn("fold", fold).groupBy("fold").agg(F.count(y).alias("n"), F.sum(Z).alias("sz"), F.sum(Y).alias("sy"), F.sum(Z * Z).alias("szz"), F.sum(Z * Y).alias("szy"))
    every = per.agg(*[F.sum(c).alias(f"t_{c}") for c in ("n", "sz", "sy", "szz", "szy")])
    o = {c: F.col(f"t_{c}") - F.col(c) for c in ("n", "sz", "sy", "szz", "szy")}  # the other folds
    lines = _one(per, every).withColumn("b", (o["n"] * o["szy"] - o["sz"] * o["sy"]) / (o["n"] * o["szz"] - o["sz"] * o["sz"])).withColumn("a", (o["sy"] - F.col("b") * o["sz"]) / o["n"])
    pooled = lines.agg(F.sum(F.col("sy") - F.col("a") * F.col("n") - F.col("b") * F.col("sz")).alias("r"), F.sum("n").alias("n"), F.avg("a").alias("a"), F.avg("b").alias("b"))
    return _one(pooled, unlabelled.agg(F.avg(Z).alias("m"))).select((F.col("a") + F.col("b") * F.col("m")).alias("predicted"), (F.col("r") / F.col("n")).alias("rectifier"), (F.col("a") + F.col("b") * F.col("m") + F.col("r") / F.col("n")).alias("theta"))


def logistic_set(labelled: DataFrame, unlabelled: DataFrame, y: str, f: str, x: str, grid: DataFrame, z: float = Z95) -> DataFrame:
    """Coefficients (t0, t1) of grid that a prediction-powered confidence set of the logistic slope keeps.

    For x_j in (1, x): the mean over unlabelled of x_j (sigmoid(t0 + t1 x) - f), plus the rectifier
    mean of x_j (f - y), has to lie within z standard errors of 0. Unlabelled rows are counted by
    (x, f) first; grid is a stated parameter table, whose rows meet those counts.
    """
    X = F.col(x)
    p = 1 / (1 + F.exp(-(F.col("t0") + F.col("t1") * X))) - F.col(f)
    counts = unlabelled.where(X.isNotNull() & F.col(f).isNotNull()).groupBy(x, f).agg(F.count("*").alias("__c"))
    C, sums = F.col("__c"), {}
    for j, v in enumerate((p, p * X)):
        sums |= {f"s{j}": F.sum(C * v), f"q{j}": F.sum(C * v * v)}
    m = F.broadcast(grid).crossJoin(counts).groupBy("t0", "t1").agg(F.sum(C).alias("nn"), *[v.alias(k) for k, v in sums.items()])
    for j in (0, 1):
        mean = F.col(f"s{j}") / F.col("nn")
        m = m.withColumn(f"m{j}", mean).withColumn(f"v{j}", (F.col(f"q{j}") - F.col("nn") * mean * mean) / (F.col("nn") - 1))
    e = F.col(f) - F.col(y)
    r = labelled.agg(F.avg(e).alias("r0"), F.avg(e * X).alias("r1"), F.var_samp(e).alias("w0"), F.var_samp(e * X).alias("w1"), F.count("*").alias("n"))
    ok = [F.abs(F.col(f"m{j}") + F.col(f"r{j}")) <= z * F.sqrt(F.col(f"v{j}") / F.col("nn") + F.col(f"w{j}") / F.col("n")) for j in (0, 1)]
    return _one(m, r).where(ok[0] & ok[1]).select("t0", "t1")


def total_variance(df: DataFrame, rep: str, v: str) -> DataFrame:
    """Within and between parts of the variance over repeated imputations: E[Var] + Var[E]."""
    per = df.groupBy(rep).agg(F.avg(v).alias("m"), F.var_samp(v).alias("s"))
    return per.agg(F.avg("s").alias("within"), F.var_samp("m").alias("between")).withColumn("total", F.col("within") + F.col("between"))


def edited_imputed_allocated(df: DataFrame, value: str, bad, by: str, alpha: float, gamma: float) -> DataFrame:
    """Edit (bad values become null), impute (their group's mean), allocate (alpha + gamma x value)."""
    from pyspark.sql import Window

    edited = df.withColumn("edited", F.when(~bad, F.col(value)))
    mean = F.avg("edited").over(Window.partitionBy(by))
    return edited.withColumn("imputed", F.coalesce("edited", mean)).withColumn("allocated", F.lit(alpha) + F.lit(gamma) * F.col("imputed"))


def against_truth(estimates: DataFrame, truth: float) -> DataFrame:
    """(estimator, total) with error and percent error."""
    e = F.col("total") - F.lit(truth)
    return estimates.withColumns({"error": e, "percent": 100 * e / F.lit(truth)})
