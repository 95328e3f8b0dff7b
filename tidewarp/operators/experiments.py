"""Analytics over experiment records: best configurations, skips, relabelled unions, grids, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.parsing import comm_ops
from ..functions.cost import buffer_bytes


def best(df: DataFrame, keys: list[str], metric: str, ties: list[str]) -> DataFrame:
    """The row of the least metric of each group, ties by the given columns. One aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    order = [metric, *ties, *(c for c in rest if c != metric and c not in ties)]
    one = df.where(F.col(metric).isNotNull()).groupBy(*keys).agg(F.min(F.struct(*order)).alias("_best"))
    return one.select(*keys, *(F.col("_best")[c].alias(c) for c in rest))


def best_in_turn(df: DataFrame, turns: list[str], metric: str, keys: list[str]) -> DataFrame:
    """Best over each parameter of `turns` in turn, the others kept as keys."""
    left = list(turns)
    for t in turns:
        left.remove(t)
        df = best(df, [*keys, *left], metric, [t])
    return df


def without_done(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


def only_kept(grid: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    return grid.join(kept.select(*keys).distinct(), keys, "left_semi")


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of a few parameter values."""
    frames = [spark.createDataFrame([(v,) for v in own], [name]) for name, own in values.items()]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), frames)  # literals of the caller's


def parallel_sizes(n_devices: int, tp: int) -> list[tuple[int, int]]:
    """(cp, dp) with cp a power of two and tp * cp * dp = devices."""
    rest = n_devices // tp
    return [(c, rest // c) for c in (1 << i for i in range(rest.bit_length())) if c <= rest and rest % c == 0]


def warm_mean(df: DataFrame, by: list[str], order: str, metric: str, skip: int = 2) -> DataFrame:
    """Mean of a metric without the first `skip` rows of each group."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > skip).groupBy(*by).agg(F.avg(metric).alias(metric))


def iterations(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The rows of each run up to iteration n, counted from 0: a loop that stops after iteration n has done n + 1."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n + 1).drop("_n")


def run_summary(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg("inter_node_cost").alias("inter_node_cost"), F.max("max_mem_mb").alias("max_mem_mb"), F.avg("compute_imbalance").alias("compute_imbalance"), F.avg("plan_seconds").alias("plan_seconds"))


def dominated(df: DataFrame, key: str, cols: list[str], chunks: int = 64) -> DataFrame:
    """Configurations for which another one of their group is at least as good in both columns and better in one (smaller is better).

    A row is dominated if the least second value over smaller first values is not above its own, or a row of the same first
    value has a smaller one. The running minimum is taken over chunks of each group's values, then inside each chunk. Rows
    with a null in the key or a column compare with nothing."""
    a, b = cols
    steps = df.where(" and ".join(f"{c} is not null" for c in (key, a, b))).groupBy(key, a).agg(F.min(b).alias("_low"))
    bounds = steps.groupBy(key).agg(F.percentile_approx(a, [i / chunks for i in range(1, chunks)]).alias("_bounds"))
    steps = steps.join(bounds, key).withColumn("_chunk", F.size(F.filter("_bounds", lambda x: x < F.col(a)))).drop("_bounds")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = steps.groupBy(key, "_chunk").agg(F.min("_low").alias("_least"))
    before = before.select(key, "_chunk", F.min("_least").over(ahead(Window.partitionBy(key).orderBy("_chunk"))).alias("_before"))
    inside = F.min("_low").over(ahead(Window.partitionBy(key, "_chunk").orderBy(a)))
    steps = steps.withColumn("_inside", inside).join(before, [key, "_chunk"]).select(key, a, "_low", F.least("_inside", "_before").alias("_under"))
    return df.join(steps, [key, a]).where((F.col("_under") <= F.col(b)) | (F.col("_low") < F.col(b))).select(*df.columns).distinct()


def dump_volumes(dumps: DataFrame) -> DataFrame:
    """Inter-node bytes sent and received of each device from instruction dumps (run, node, dev, line), and the run's largest."""
    ops = dumps.select("run", "node", "dev", F.explode(comm_ops(F.col("line"))).alias("op")).where("op.node <> node")
    size = buffer_bytes(F.col("op.buffer"), F.col("op.tokens"))
    per = ops.groupBy("run", "node", "dev").agg(F.sum(F.when(F.col("op.kind") == "send", size).otherwise(0)).alias("sent"), F.sum(F.when(F.col("op.kind") == "recv", size).otherwise(0)).alias("received"))
    return per.groupBy("run").agg(F.max(F.greatest("sent", "received")).alias("max_bytes"))


def device_times(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean over iterations of each device, then mean and largest over devices."""
    per = df.groupBy(*by, "device").agg(F.avg("ms").alias("ms"))
    return per.groupBy(*by).agg(F.avg("ms").alias("mean_ms"), F.max("ms").alias("max_ms"))
