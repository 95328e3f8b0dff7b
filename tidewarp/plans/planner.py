"""From a corpus to per-device plans, in one place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import DEFAULT, Plan
from ..functions import tokens
from ..operators import batching, blocks, placement, schedule
from ..sources import table
from ..tables import joined, written


def sequences(spark: SparkSession, sf_dir: str, count: Callable[[Column], Column] = tokens.n_tokens) -> DataFrame:
    """doc_id and raw_len of every document. count: the tokenizer's number of tokens of a text, as a column."""
    return table(spark, sf_dir, "documents").select("doc_id", count(F.col("text")).cast("bigint").alias("raw_len"))


def packed(lengths: DataFrame, plan: Plan = DEFAULT, last: str = "if_full") -> DataFrame:
    """Sequences (doc_id, raw_len) in batches: batch_id, seq_id, doc_id, raw_len."""
    fine = lengths.where(F.col("raw_len").between(1, plan.max_len)).select(F.col("doc_id").alias("place"), F.col("doc_id").alias("id"), F.col("raw_len").alias("n"))
    got = batching.pack(fine, plan.budget, last=last)
    return written(got.where("batch_id is not null").select("batch_id", F.col("seq_in_batch").alias("seq_id"), F.col("id").alias("doc_id"), F.col("n").alias("raw_len")), "packed")


@dataclass
class Planned:
    """The tables of a plan; each is built when it is asked for. Placement is the closed-form heuristic, or the partition.

    mask: a name, or the rows of a mask of one's own; cost_of: the cost model; solver: the partition, called as
    `placement.partition` is."""

    seqs: DataFrame
    mask: str | DataFrame = "causal"
    plan: Plan = DEFAULT
    refine: bool = False
    cost_of: Callable = blocks.roofline
    solver: Callable[..., DataFrame] = placement.partition

    @cached_property
    def works(self) -> DataFrame:
        return written(blocks.work_blocks(self.seqs, self.mask, self.plan, self.cost_of), "works")

    @cached_property
    def data(self) -> DataFrame:
        return blocks.data_blocks(self.seqs, self.plan)

    @cached_property
    def groups(self) -> DataFrame:
        return blocks.colocation(self.data, self.plan)

    @cached_property
    def heuristic(self) -> tuple[DataFrame, DataFrame]:
        return placement.heuristic(self.works, self.data, self.seqs, self.plan)

    @cached_property
    def parts(self) -> DataFrame:
        parts = written(self.solver(self.works, self.data, self.groups, *self.heuristic, self.plan), "parts")
        return placement.repair(parts, self.works, self.groups, self.plan)

    @cached_property
    def placed(self) -> tuple[DataFrame, DataFrame]:
        return placement.split_placement(self.parts, self.groups) if self.refine else self.heuristic

    @cached_property
    def homes(self) -> DataFrame:
        """The devices of the data; of the heuristic without the works."""
        return self.placed[1] if self.refine else placement.homes(self.data, self.seqs, self.plan)

    @cached_property
    def staged(self) -> tuple[DataFrame, DataFrame]:
        return schedule.stages(self.works, self.placed[0], self.placed[1], self.data, self.plan)

    @cached_property
    def out_moves(self) -> DataFrame:
        return schedule.required(self.works, self.placed[0], self.placed[1], inputs=False)

    @cached_property
    def with_devices(self) -> tuple[DataFrame, DataFrame]:
        """Works and data, each with its device; the heuristic's need no join of a placement."""
        if self.refine:
            return joined(self.works, self.placed[0], ["batch_id", "work_id"]), joined(self.data, self.placed[1], ["batch_id", "is_input", "data_id"])
        return placement.with_devices(self.works, self.seqs, self.plan), placement.with_homes(self.data, self.seqs, self.plan)

    @cached_property
    def instructions(self) -> DataFrame:
        return schedule.instructions(*self.with_devices, self.plan)

    @cached_property
    def backward(self) -> Planned:
        """The plan of the backward pass: its own blocks, stages, transfers and instructions, on the forward pass's devices."""
        return Backward(self.seqs, self.mask, self.plan, self.refine, self.cost_of, self.solver, self)


@dataclass
class Backward(Planned):
    """The plan of the backward pass of another. Its works are made only when they are asked for; blocks and homes are one table."""

    forward: Planned | None = None

    @cached_property
    def rows(self) -> DataFrame:
        return written(blocks.backward_blocks(self.forward.data, self.forward.homes), "backward-blocks")

    @cached_property
    def works(self) -> DataFrame:
        return written(blocks.backward_works(self.forward.works, self.rows), "backward-works")

    @cached_property
    def data(self) -> DataFrame:
        return self.rows.select(*blocks.DATA)

    @cached_property
    def placed(self) -> tuple[DataFrame, DataFrame]:
        return self.forward.placed[0], self.rows.select("batch_id", "is_input", "data_id", "device")

    @cached_property
    def instructions(self) -> DataFrame:
        return schedule.instructions(*self.forward.with_devices, self.plan, back=True)


#: The tables of a plan, as `dump` writes them.
TABLES = ("seqs", "works", "data", "groups", "work_device", "data_device", "work_stages", "moves", "out_moves", "instructions")


def dump(p: Planned, path: str) -> None:
    """The tables of a plan as Parquet below a folder, to be looked at or run later."""
    own = {"work_device": p.placed[0], "data_device": p.placed[1], "work_stages": p.staged[0], "moves": p.staged[1]}
    for name in TABLES:
        (own[name] if name in own else getattr(p, name)).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that `dump` wrote, by name."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def plan_corpus(spark: SparkSession, sf_dir: str, mask: str = "causal", plan: Plan = DEFAULT, refine: bool = False) -> Planned:
    return Planned(packed(sequences(spark, sf_dir), plan), mask, plan, refine)


def device_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works, cost, blocks and bytes of each device, with the batch's imbalance: the flagship query."""
    p = plan_corpus(spark, sf_dir)
    load = placement.device_load(p.placed[0], p.works, p.placed[1], p.data)
    return joined(load, placement.imbalance(load, p.plan.cluster.n_devices), "batch_id")
