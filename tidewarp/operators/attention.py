"""Attention over rows of vectors: direct, and by blocks whose partial results merge through log-sum-exp.

q rows: seq_id, pos, q; kv rows: seq_id, pos, k, v; ranges as in masks. Blocks meet through work blocks, so keys come by an
equi-join on (sequence, key block), never by a cross join. Partials (max, sum, weighted values) merge in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Stands for the log-sum-exp of a merge without any finite source.
EMPTY_LSE = -1.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scores(q: DataFrame, kv: DataFrame, rows: DataFrame, block: int, scale: float) -> DataFrame:
    """seq_id, q_pos, kv_block, s (score), v for every attended pair of positions."""
    b = block
    touched = lambda s, e: F.when(F.col(s) < F.col(e), F.sequence(F.floor(F.col(s) / b), F.floor((F.col(e) - 1) / b))).otherwise(F.array().cast("array<bigint>"))
    ask = rows.select("seq_id", "q_pos", "s0", "e0", "s1", "e1", F.explode(F.array_union(touched("s0", "e0"), touched("s1", "e1"))).alias("kv_block"))
    ask = ask.join(q.select("seq_id", F.col("pos").alias("q_pos"), "q"), ["seq_id", "q_pos"])
    keys = kv.select("seq_id", F.floor(F.col("pos") / b).alias("kv_block"), F.col("pos").alias("k_pos"), "k", "v")
    j = ask.join(keys, ["seq_id", "kv_block"]).where("(k_pos >= s0 and k_pos < e0) or (k_pos >= s1 and k_pos < e1)")
    return j.select("seq_id", "q_pos", "kv_block", "k_pos", (dot(F.col("q"), F.col("k")) * F.lit(scale)).alias("s"), "v")


def _summed(df: DataFrame, by: list[str], weight: Column, value: str, dim: int) -> DataFrame:
    """Sum of weight and of weight * value, element by element, as built-in sums."""
    parts = [F.sum(weight * F.col(value)[i].cast("double")).alias(f"_{i}") for i in range(dim)]
    return df.groupBy(*by).agg(F.sum(weight).alias("l"), *parts).select(*by, "l", F.array(*(f"_{i}" for i in range(dim))).alias("o"))


def _softmax(pairs: DataFrame, by: list[str], dim: int) -> DataFrame:
    top = pairs.groupBy(*by).agg(F.max("s").alias("m"))
    df = _summed(pairs.join(top, by), [*by, "m"], F.exp(F.col("s") - F.col("m")), "v", dim)
    return df.select(*by, F.transform("o", lambda x: x / F.col("l")).alias("out"), (F.col("m") + F.log("l")).alias("lse"))


def direct(pairs: DataFrame, dim: int) -> DataFrame:
    """seq_id, q_pos, out, lse over all keys at once."""
    return _softmax(pairs, ["seq_id", "q_pos"], dim)


def partial(pairs: DataFrame, dim: int) -> DataFrame:
    """seq_id, q_pos, kv_block, out, lse of each key block alone."""
    return _softmax(pairs, ["seq_id", "q_pos", "kv_block"], dim)


def merge(parts: DataFrame, by: list[str], dim: int) -> DataFrame:
    """Log-sum-exp merge of partial (out, lse): sources that are not finite are left out; without any, lse is EMPTY_LSE and
    out is 0. Two aggregations, first the largest lse, so that no exponential overflows."""
    finite = F.col("lse").isNotNull() & ~F.isnan("lse") & (F.abs("lse") < float("inf"))
    top = parts.groupBy(*by).agg(F.max(F.when(finite, F.col("lse"))).alias("m"))
    w = F.when(finite, F.exp(F.col("lse") - F.col("m"))).otherwise(0.0)
    df = _summed(parts.join(top, by), [*by, "m"], w, "out", dim)
    lse = F.when(F.col("m").isNull(), EMPTY_LSE).otherwise(F.col("m") + F.log("l"))
    return df.select(*by, F.transform("o", lambda x: F.when(F.col("l") > 0, x / F.col("l")).otherwise(0.0)).alias("out"), lse.alias("lse"))


def pairwise_merge(lse_a: Column, out_a: Column, lse_b: Column, out_b: Column) -> tuple[Column, Column]:
    """Two partials: out by a sigmoid of the difference, lse by its log."""
    share = 1 / (1 + F.exp(lse_a - lse_b))
    out = F.zip_with(out_a, out_b, lambda x, y: x - share * (x - y))
    return out, lse_a + F.log1p(F.exp(lse_b - lse_a))


def blockwise_sum(blocks: DataFrame, by: list[str], value: str = "x") -> DataFrame:
    """Sums of the source rows of each target row."""
    return blocks.groupBy(*by).agg(F.sum(value).alias(value))


def gradients(pairs: DataFrame, fwd: DataFrame, d_out: DataFrame, dim: int) -> DataFrame:
    """dV and the score gradients dS of every pair: P = exp(S - L), dP = dO . V, dS = P (dP - dO . O). pairs carry v."""
    x = pairs.join(fwd.select("seq_id", "q_pos", "out", "lse"), ["seq_id", "q_pos"]).join(d_out.select("seq_id", "q_pos", "d_out"), ["seq_id", "q_pos"])
    p = F.exp(F.col("s") - F.col("lse"))
    return x.withColumn("p", p).withColumn("ds", F.col("p") * (dot(F.col("d_out"), F.col("v")) - dot(F.col("d_out"), F.col("out"))))


def d_v(grads: DataFrame, dim: int) -> DataFrame:
    return _summed(grads.withColumnRenamed("q_pos", "_q"), ["seq_id", "k_pos"], F.col("p"), "d_out", dim).select("seq_id", "k_pos", F.col("o").alias("d_v"))


def differences(a: DataFrame, b: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and largest absolute difference of a column."""
    d = a.select(*by, F.col(value).alias("x")).join(b.select(*by, F.col(value).alias("y")), by).select(F.abs(F.col("x") - F.col("y")).alias("d"))
    return d.agg(F.avg("d").alias("mean_abs"), F.max("d").alias("max_abs"))


def masked_loss(rows: DataFrame) -> DataFrame:
    """Sum of loss * mask, of the mask, and their ratio."""
    x = rows.agg(F.sum(F.col("loss") * F.col("mask")).alias("loss_sum"), F.sum("mask").alias("n"))
    return x.withColumn("mean_loss", F.when(F.col("n") > 0, F.col("loss_sum") / F.col("n")))
