"""Padding of lengths, blocks of sequences, zigzag and ring slices, powers of two, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def ceil_div(n: Column, by: Column | int) -> Column:
    return F.floor((n + by - 1) / by).cast("bigint")


def pad_block(n: Column, block: int) -> Column:
    """Up to a multiple of the block."""
    return ceil_div(n, block) * block


def pad_2cp(n: Column, cp: int) -> Column:
    """Adds 1 to 2*cp, also where the length is a multiple already."""
    return (n + 2 * cp - F.pmod(n, F.lit(2 * cp))).cast("bigint")


def pad_2cp_exact(n: Column, cp: int) -> Column:
    return pad_block(n, 2 * cp)


def block_tokens(n: Column, index: Column, block: int) -> Column:
    """Tokens that the index-th block really holds."""
    return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(block).cast("bigint"), n - index * block))


def zigzag_rank(pos: Column, n: Column, cp: int) -> Column:
    """Rank of a position of a padded sequence: chunks r and 2cp-1-r of 2cp belong to r."""
    chunk = F.floor(pos * (2 * cp) / n)
    return F.least(chunk, 2 * cp - 1 - chunk).cast("bigint")


def ring_rank(pos: Column, n: Column, cp: int) -> Column:
    """Rank of a position when the sequence is cut into cp contiguous chunks of ceil(n / cp)."""
    return F.floor(pos / ceil_div(n, cp)).cast("bigint")


def two_level_rank(pos: Column, n: Column, ring: int, group: int) -> tuple[Column, Column]:
    """Zigzag over the ring, then contiguous over the group inside each rank's two chunks together."""
    half = F.floor(n / (2 * ring)).cast("bigint")
    chunk = F.floor(pos / half)
    outer = F.least(chunk, 2 * ring - 1 - chunk).cast("bigint")
    inside = F.when(chunk < ring, F.pmod(pos, half)).otherwise(half + F.pmod(pos, half))
    return outer, F.floor(inside * group / (2 * half)).cast("bigint")


def padded(rows: DataFrame, lengths: DataFrame, value: str, fill=0) -> DataFrame:
    """Ragged rows (seq_id, pos, value) stretched to lengths (seq_id, padded_len), missing places filled."""
    grid = lengths.where("padded_len > 0").select("seq_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("padded_len") - 1)).alias("pos"))
    return grid.join(rows, ["seq_id", "pos"], "left").select("seq_id", "pos", F.coalesce(value, F.lit(fill)).alias(value))


def unpadded(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Only the places that lengths (seq_id, raw_len) really have."""
    return rows.join(lengths.select("seq_id", "raw_len"), "seq_id").where("pos < raw_len").drop("raw_len")


def power_up(n: Column) -> Column:
    """Smallest power of two that is n or more."""
    return F.pow(F.lit(2.0), F.when(n <= 1, 0).otherwise(F.length(F.bin((n - 1).cast("bigint"))))).cast("bigint")


def power_down(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.length(F.bin(n.cast("bigint"))) - 1).cast("bigint")


def is_power(n: Column) -> Column:
    n = n.cast("bigint")
    return (n > 0) & (n.bitwiseAND(n - 1) == 0)


def rank_of(node: Column, device: Column, per_node: int) -> Column:
    return node * per_node + device


def device_of(rank: Column, per_node: int) -> Column:
    return F.struct(F.floor(rank / per_node).cast("int").alias("node"), F.pmod(rank, F.lit(per_node)).cast("int").alias("dev"))


def grid_ranks(df: DataFrame, cp: int) -> DataFrame:
    """cp_rank and dp_rank of each rank: contiguous context groups, strided data groups."""
    return df.withColumn("cp_rank", F.pmod("rank", F.lit(cp))).withColumn("dp_rank", F.floor(F.col("rank") / cp).cast("bigint"))


def divided(n: Column, by: int) -> Column:
    """n / by, for lengths that must divide: any other length ends the query, naming it."""
    told = F.concat(F.lit("a length does not divide by "), F.lit(str(by)), F.lit(": "), n.cast("string"))
    return F.when(F.pmod(n, F.lit(by)) != 0, F.raise_error(told).cast("bigint")).otherwise(F.floor(n / by).cast("bigint"))
