"""Algebra of discrete distributions in long form: one row a (context, token)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(df: DataFrame, ctx: str, z: str, temperature: float = 1.0, out: str = "p") -> DataFrame:
    """Shifted by the maximum, so that it neither over- nor underflows. Temperature above 0."""
    if temperature <= 0:
        raise ValueError("temperature has to be above 0")
    over = Window.partitionBy(ctx)
    e = F.exp((F.col(z) - F.max(z).over(over)) / F.lit(temperature))
    return df.withColumn("__e", e).withColumn(out, F.col("__e") / F.sum("__e").over(over)).drop("__e")


def restricted_softmax(df: DataFrame, ctx: str, token: str, z: str, allowed: list[str], out: str = "p") -> DataFrame:
    """Softmax over the allowed tokens only; the others have probability 0."""
    return softmax(df.withColumn("__z", F.when(F.col(token).isin(allowed), F.col(z).cast("double")).otherwise(F.lit(float("-inf")))), ctx, "__z", out=out).drop("__z")


def top_k(df: DataFrame, ctx: str, token: str, v: str, k: int) -> DataFrame:
    """The k largest of each context; ties to the smaller token."""
    r = F.row_number().over(Window.partitionBy(ctx).orderBy(F.col(v).desc(), token))
    return df.withColumn("__r", r).where(F.col("__r") <= k).drop("__r")


def nucleus(df: DataFrame, ctx: str, token: str, p: str, mass: float, tolerance: float = 1e-9) -> DataFrame:
    """The smallest set of most likely tokens whose probability is at least mass."""
    w = Window.partitionBy(ctx).orderBy(F.col(p).desc(), token).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__c", F.coalesce(F.sum(p).over(w), F.lit(0.0))).where(F.col("__c") < mass - tolerance).drop("__c")


def renormalised(df: DataFrame, ctx: str, p: str) -> DataFrame:
    return df.withColumn(p, F.col(p) / F.sum(p).over(Window.partitionBy(ctx)))


def sampling_config(df: DataFrame, ctx: str, token: str, z: str, k: int, mass: float, temperature: float) -> DataFrame:
    """Top-k of the logits, then the nucleus of their softmax, then the softmax at the temperature."""
    kept = nucleus(softmax(top_k(df, ctx, token, z, k), ctx, z, out="__p"), ctx, token, "__p", mass)
    return softmax(kept.drop("__p"), ctx, z, temperature)


def argmax(df: DataFrame, ctx: str, token: str, v: str) -> DataFrame:
    """The token of the largest value of each context; ties to the smaller token."""
    return top_k(df, ctx, token, v, 1)


def argmin(df: DataFrame, ctx: str, token: str, v: str) -> DataFrame:
    return top_k(df.withColumn("__v", -F.col(v)), ctx, token, "__v", 1).drop("__v")


def log_ensemble(df: DataFrame, ctx: str, token: str, p: str) -> DataFrame:
    """Sum over models of ln p; a probability of 0 gives minus infinity."""
    return df.groupBy(ctx, token).agg(F.sum(F.when(F.col(p) > 0, F.ln(p)).otherwise(F.lit(float("-inf")))).alias("score"))


def mixture(df: DataFrame, weights: DataFrame, part: str, ctx: str, token: str, p: str, w: str) -> DataFrame:
    """Sum over parts (prompts) of p(token | part) p(part)."""
    return df.join(F.broadcast(weights), part).groupBy(ctx, token).agg(F.sum(F.col(p) * F.col(w)).alias("p"))


def majority(df: DataFrame, ctx: str, answer: str) -> DataFrame:
    """The most frequent answer of each context; ties to the smaller."""
    return argmax(df.groupBy(ctx, answer).agg(F.count("*").alias("votes")), ctx, answer, "votes")


def bayes_risk(df: DataFrame, ctx: str, answer: str, p: str, risk: Column) -> DataFrame:
    """Expected risk of each answer against the others of its context; risk is a Column over a and b."""
    a = df.select(F.col(ctx), F.col(answer).alias("a"))
    b = df.select(F.col(ctx), F.col(answer).alias("b"), F.col(p).alias("__p"))
    return a.join(b, ctx).groupBy(ctx, F.col("a").alias(answer)).agg(F.sum(risk * F.col("__p")).alias("risk"))


def entropies(df: DataFrame, ctx: str, p: str, q: str) -> DataFrame:
    """Entropy, cross-entropy and divergence in bits. Terms with p = 0 are 0; q = 0 with p > 0 gives infinity."""
    P, Q = F.col(p), F.col(q)
    inf = F.lit(float("inf"))
    h = F.sum(F.when(P > 0, -P * F.log2(P)).otherwise(0.0))
    c = F.sum(F.when(P > 0, F.when(Q > 0, -P * F.log2(Q)).otherwise(inf)).otherwise(0.0))
    return df.groupBy(ctx).agg(h.alias("entropy"), c.alias("cross_entropy")).withColumn("kl", F.col("cross_entropy") - F.col("entropy"))


def attention(items: DataFrame, seq: str, pos: str, q: str, k: str, v: str, keys: DataFrame | None = None) -> DataFrame:
    """Self attention of each sequence: softmax over its positions of q.k, times v. keys: another table (cross).

    Positions of one sequence meet by an equality join on the sequence. There is no scaling. Null keys and values add
    nothing; a position that meets no value at all has an empty y.
    """
    other = (keys if keys is not None else items).select(seq, F.col(pos).alias("__j"), F.col(k).alias("__k"), F.col(v).alias("__v"))
    dot = F.aggregate(F.zip_with(q, "__k", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = items.select(seq, pos, q).join(other, seq).withColumn("__z", dot).withColumn("__c", F.struct(seq, pos))
    w = softmax(scored, "__c", "__z", out="__w")
    parts = w.select(seq, pos, "__w", F.posexplode_outer("__v").alias("d", "x")).groupBy(seq, pos, "d").agg(F.sum(F.col("__w") * F.col("x")).alias("y"))
    known = F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "y")))
    return parts.groupBy(seq, pos).agg(F.transform(F.array_sort(known), lambda s: s["y"]).alias("y"))


def matvec(rows: list[list[float]], x: Column) -> Column:
    """A fixed matrix times a vector column."""
    return F.array(*[F.aggregate(F.zip_with(F.array(*[F.lit(float(c)) for c in r]), x, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y) for r in rows])


def label_of(text: Column, words: dict[str, str], fallback: str = "review") -> Column:
    """The class whose label word comes first in a text, or the fallback."""
    found = F.lower(F.regexp_extract(text, r"(?i)\b(" + "|".join(sorted(words)) + r")\b", 1))
    out = F.lit(fallback)
    for w, c in words.items():
        out = F.when(found == w.lower(), c).otherwise(out)
    return out


def dropout(df: DataFrame, key: str, x: str, weights: list[float], keep: float, passes: int, seed: int = 0) -> DataFrame:
    """(key, mean, variance) of a linear score over passes random masks: each input is kept with probability keep and divided by it.

    Masks come from the MD5 of seed, key, pass and input, so that reruns agree.
    """
    at = F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), F.col("pass").cast("string"))
    drawn = lambda i: F.conv(F.substring(F.md5(F.concat(at, F.lit("|"), i.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    w = F.array(*[F.lit(float(c)) for c in weights])
    terms = F.transform(F.zip_with(x, w, lambda a, b: a * b), lambda t, i: F.when(drawn(i) < keep, t / keep).otherwise(0.0))
    runs = df.select(key, x, F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("pass")).select(key, F.aggregate(terms, F.lit(0.0), lambda s, t: s + t).alias("z"))
    return runs.groupBy(key).agg(F.avg("z").alias("mean"), F.var_pop("z").alias("variance"))


def unigram_bits(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key, n, bits): bits of each text by a model of single characters learnt from all texts, add-one smoothed."""
    chars = df.select(*key, F.explode(F.split(text, "")).alias("c")).where("c <> ''").groupBy(*key, "c").agg(F.count("*").alias("k"))
    model = chars.groupBy("c").agg(F.sum("k").alias("t"))
    whole = model.agg(F.sum("t").alias("all"), F.count("*").alias("kinds"))
    p = (F.col("t") + 1) / (F.col("all") + F.col("kinds"))
    model = model.crossJoin(F.broadcast(whole)).select("c", (-F.log2(p)).alias("b"))  # whole is one row
    return chars.join(model, "c").groupBy(*key).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("b")).alias("bits"))
