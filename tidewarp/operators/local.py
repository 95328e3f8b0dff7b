"""What a device holds: its blocks of token rows, padding zeroed, block tables, and outputs put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT, Plan
from ..functions.padding import zigzag_rank
from ..tables import joined


def local_rows(rows: DataFrame, data: DataFrame, data_device: DataFrame, plan: Plan = DEFAULT) -> DataFrame:
    """Token rows (batch_id, seq_id, pos, ...) with the device of their block; a token goes to each device that holds its
    query or key block, once. Rows without pos are whole sequences (batch_id, seq_id, raw_len, ...): their tokens are made
    after the join, so that none is shuffled."""
    own = joined(data.where("is_input = 1"), data_device, ["batch_id", "is_input", "data_id"]).select("batch_id", "seq_id", "block", "device").distinct()
    if "pos" in rows.columns:
        return joined(rows.withColumn("block", F.floor(F.col("pos") / plan.block).cast("bigint")), own, ["batch_id", "seq_id", "block"])
    end = F.least((F.col("block") + 1) * plan.block, F.col("raw_len").cast("bigint"))
    return joined(rows, own, ["batch_id", "seq_id"]).withColumn("pos", F.explode(F.sequence(F.col("block") * plan.block, end - 1)))


def zeroed(rows: DataFrame, value: str, cp: int) -> DataFrame:
    """Padded rows (pos, raw_len, padded_len, value) with their zigzag rank, padding set to 0."""
    return rows.withColumn(value, F.when(F.col("pos") < F.col("raw_len"), F.col(value)).otherwise(0)).withColumn("rank", zigzag_rank(F.col("pos"), F.col("padded_len"), cp))


def block_table(works: DataFrame, work_device: DataFrame, slots: DataFrame) -> DataFrame:
    """Per batch, device and query block the slots of its key blocks, filled with -1 to the device's longest list."""
    kv = slots.where("kind = 'KV'").select("batch_id", F.col("data_id").alias("kv_id"), "slot")
    rows = joined(joined(works, work_device, ["batch_id", "work_id"]), kv, ["batch_id", "kv_id"])
    lists = rows.groupBy("batch_id", "device", "q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("kv_block", "slot"))), lambda x: x["slot"]).alias("slots"))
    most = F.max(F.size("slots")).over(Window.partitionBy("batch_id", "device"))
    return lists.withColumn("most", most).select("batch_id", "device", "q_id", F.concat("slots", F.array_repeat(F.lit(-1).cast("bigint"), F.col("most") - F.size("slots"))).alias("slots"))


def reconstructed(rows: DataFrame, value: str) -> DataFrame:
    """Rows (seq_id, pos, head, value) of any devices as one ordered list of values per sequence and position."""
    return rows.groupBy("seq_id", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("head", value))), lambda x: x[value]).alias(value))


def gathered(rows: DataFrame, mask: str) -> DataFrame:
    """Rows where the mask holds, densely numbered in each sequence."""
    return rows.where(mask).withColumn("dense", (F.row_number().over(Window.partitionBy("seq_id").orderBy("pos")) - 1).cast("bigint"))


def scattered(dense: DataFrame, rows: DataFrame, mask: str, values: list[str]) -> DataFrame:
    """The reverse of `gathered`: values of (seq_id, dense, …) back at the places of rows where the mask holds, null elsewhere."""
    places = gathered(rows, mask).select("seq_id", "pos", "dense")
    back = joined(places, dense.select("seq_id", "dense", *values), ["seq_id", "dense"]).drop("dense")
    return joined(rows.drop(*values), back, ["seq_id", "pos"], "left")


def partial_gradients(work_stages: DataFrame, backward: DataFrame) -> DataFrame:
    """Slots that partial gradients take: one per stage for a query block, one per occurrence in a stage for a key block."""
    x = joined(work_stages, backward.select("batch_id", "work_id", "dq_id", "dkv_id"), ["batch_id", "work_id"])
    dkv = x.withColumn("replica", F.row_number().over(Window.partitionBy("batch_id", "device", "stage", "dkv_id").orderBy("work_id")) - 1)
    return dkv.select("batch_id", "device", "stage", F.lit("dKV").alias("kind"), F.col("dkv_id").alias("id"), "replica").unionByName(
        x.select("batch_id", "device", "stage", F.lit("dQ").alias("kind"), F.col("dq_id").alias("id"), F.lit(0).alias("replica")).distinct()
    )
