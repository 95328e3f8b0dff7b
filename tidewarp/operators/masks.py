"""Attention masks as half-open key ranges per query position, one or two a position.

A mask takes sequences (seq_id, raw_len, …) and gives rows (seq_id, q_pos, s0, e0, s1, e1): [s0, e0) and [s1, e1) are
attended, an empty second range where a mask has one range. One row per token, never one per pair; the rows come from an
explode inside the task that holds the sequence, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import udtf

from ..config import DEFAULT, Plan
from ..functions.padding import ceil_div

Ranges = tuple[Column, Column, Column, Column]


def _big(x) -> Column:
    return F.lit(x).cast("bigint") if isinstance(x, int) else x.cast("bigint")


def causal(i: Column, n: Column, plan: Plan = DEFAULT) -> Ranges:
    return _big(0), i + 1, _big(0), _big(0)


def lambda_(i: Column, n: Column, plan: Plan = DEFAULT) -> Ranges:
    """The first tokens and a window of the latest; the two may overlap."""
    return _big(0), F.least(_big(plan.n_starting), i + 1), F.greatest(_big(0), i - plan.l_pretrain + 1), i + 1


def shared_question(i: Column, n: Column, plan: Plan = DEFAULT) -> Ranges:
    """A question, then answers that see the question and themselves; the last answer takes the remainder."""
    q = F.floor(n * F.lit(plan.question_proportion)).cast("bigint")
    a = F.floor((n - q) / plan.n_answers).cast("bigint")
    start = F.when(a > 0, F.least(q + F.floor((i - q) / a).cast("bigint") * a, q + (plan.n_answers - 1) * a)).otherwise(q)
    asks = i < q
    return _big(0), F.when(asks, i + 1).otherwise(q), F.when(asks, i + 1).otherwise(start), i + 1


def causal_blockwise(i: Column, n: Column, plan: Plan = DEFAULT) -> Ranges:
    """The first block and some blocks back; the first and the last block are fully causal."""
    b = plan.blockwise
    blk, count = F.floor(i / b).cast("bigint"), ceil_div(n, b)
    first, last = blk == 0, blk == count - 1
    edge = (count - 2) * b
    return (
        _big(0), F.when(first, i + 1).when(last, edge).otherwise(_big(b)),
        F.when(first, i + 1).when(last, edge).otherwise(F.greatest(_big(b), i - plan.k_local * b)), i + 1,
    )


MASKS: dict[str, Callable[..., Ranges]] = {"causal": causal, "lambda": lambda_, "shared_question": shared_question, "causal_blockwise": causal_blockwise}


Line = tuple[Column, int]
Segment = tuple[Column, Column, Line, Line, Line, Line]


def _segment(a, b, s0, e0, s1=None, e1=None) -> Segment:
    """Positions a .. b-1 and their two ranges, which do not overlap; an end is a constant, or (constant, 1) if it moves on
    with the position."""
    line = lambda x: (_big(0), 0) if x is None else (_big(x[0]), 1) if isinstance(x, tuple) else (_big(x), 0)
    return _big(a), _big(b), line(s0), line(e0), line(s1), line(e1)


def causal_segments(n: Column, plan: Plan = DEFAULT) -> list[Segment]:
    return [_segment(0, n, 0, (1,))]


def lambda_segments(n: Column, plan: Plan = DEFAULT) -> list[Segment]:
    t = F.least(n, _big(plan.n_starting + plan.l_pretrain - 1))  # up to here the two ranges meet
    return [_segment(0, t, 0, (1,)), _segment(t, n, 0, plan.n_starting, (1 - plan.l_pretrain,), (1,))]


def shared_question_segments(n: Column, plan: Plan = DEFAULT) -> list[Segment]:
    q = F.floor(n * F.lit(plan.question_proportion)).cast("bigint")
    a = F.floor((n - q) / plan.n_answers).cast("bigint")
    out = [_segment(0, q, 0, (1,))]
    for k in range(plan.n_answers):
        last = k == plan.n_answers - 1
        out.append(_segment(q + k * a, n if last else q + (k + 1) * a, 0, q, q + k * a, (1,)))
    return out


def causal_blockwise_segments(n: Column, plan: Plan = DEFAULT) -> list[Segment]:
    b = plan.blockwise
    whole = F.least(n, _big((plan.k_local + 1) * b))  # up to here the block in front and the latest ones meet
    last = F.greatest(whole, (ceil_div(n, b) - 1) * b)
    return [_segment(0, whole, 0, (1,)), _segment(whole, last, 0, b, (-plan.k_local * b,), (1,)), _segment(last, n, 0, (1,))]


#: Masks whose ranges move on with the position, or stay, over a few segments of it: the ranges as segments instead of tokens.
SEGMENTS: dict[str, Callable[..., list[Segment]]] = {"causal": causal_segments, "lambda": lambda_segments, "shared_question": shared_question_segments, "causal_blockwise": causal_blockwise_segments}


def ranges(sequences: DataFrame, mask: str = "causal", plan: Plan = DEFAULT) -> DataFrame:
    """All columns of the sequences with q_pos, s0, e0, s1, e1: a row per token."""
    rows = sequences.where("raw_len > 0").withColumn("q_pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("raw_len").cast("bigint") - 1)))
    s0, e0, s1, e1 = MASKS[mask](F.col("q_pos"), F.col("raw_len").cast("bigint"), plan)
    return rows.withColumns({"s0": s0, "e0": e0, "s1": s1, "e1": e1})


def modality(sequences: DataFrame, self_only: bool = False) -> DataFrame:
    """Sequences (seq_id, text_lengths, image_size): text tokens are causal, image tokens see up to their image's end, or
    their image only. Images lie between consecutive text segments."""
    z = F.col("image_size").cast("bigint")
    starts = F.aggregate(
        F.col("text_lengths"), F.array().cast("array<struct<at:bigint,len:bigint>>"),
        lambda acc, x: F.concat(acc, F.array(F.struct((F.coalesce(F.get(acc, F.size(acc) - 1)["at"] + F.get(acc, F.size(acc) - 1)["len"] + z, F.lit(0).cast("bigint"))).alias("at"), x.cast("bigint").alias("len")))),
    )
    seg = sequences.withColumn("_s", starts).select("seq_id", z.alias("z"), F.size("_s").alias("k"), F.posexplode("_s").alias("j", "s"))
    span = F.when(F.col("j") < F.col("k") - 1, F.col("s.len") + F.col("z")).otherwise(F.col("s.len"))
    rows = seg.where(span > 0).select("seq_id", "z", "s", F.explode(F.sequence(F.lit(0).cast("bigint"), span - 1)).alias("d"))
    text, image = F.col("d") < F.col("s.len"), F.col("s.at") + F.col("s.len")
    pos = F.col("s.at") + F.col("d")
    return rows.select(
        "seq_id", pos.alias("q_pos"), F.when(text, F.lit(0).cast("bigint")).otherwise(image if self_only else F.lit(0).cast("bigint")).alias("s0"),
        F.when(text, pos + 1).otherwise(image + F.col("z")).alias("e0"), F.lit(0).cast("bigint").alias("s1"), F.lit(0).cast("bigint").alias("e1"),
    )


def full(sequences: DataFrame) -> DataFrame:
    rows = sequences.where("raw_len > 0").withColumn("q_pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("raw_len").cast("bigint") - 1)))
    zero = F.lit(0).cast("bigint")
    return rows.withColumns({"s0": zero, "e0": F.col("raw_len").cast("bigint"), "s1": zero, "e1": zero})


def attended(rows: DataFrame) -> Column:
    """Keys that a row attends: both ranges without their overlap."""
    one, two = F.greatest(F.lit(0), F.col("e0") - F.col("s0")), F.greatest(F.lit(0), F.col("e1") - F.col("s1"))
    both = F.greatest(F.lit(0), F.least("e0", "e1") - F.greatest("s0", "s1"))
    return (one + two - F.when((one > 0) & (two > 0), both).otherwise(0)).cast("bigint")


def counts(rows: DataFrame) -> DataFrame:
    """seq_id and attended pairs."""
    return rows.groupBy("seq_id").agg(F.sum(attended(rows)).cast("bigint").alias("pairs"))


def sparsity(rows: DataFrame, pooled: bool = True) -> DataFrame:
    """Attended pairs over causal pairs, of all sequences together or of the last one only."""
    per = rows.groupBy("seq_id").agg(F.sum(attended(rows)).alias("pairs"), F.sum(F.col("q_pos") + 1).alias("causal"))
    if not pooled:
        per = per.groupBy().agg(F.max_by(F.struct("pairs", "causal"), "seq_id").alias("x")).select("x.*")
    return per.agg((F.sum("pairs") / F.sum("causal")).alias("sparsity"))


def zigzag_slice(rows: DataFrame, cp: int, rank: int) -> DataFrame:
    """The rows of a rank's two chunks, padded_len being a multiple of 2 * cp; q_local is the place in the slice."""
    chunk = F.col("padded_len") / (2 * cp)
    c = F.floor(F.col("q_pos") / chunk).cast("bigint")
    local = F.when(c == rank, F.pmod("q_pos", chunk)).otherwise(chunk + F.pmod("q_pos", chunk)).cast("bigint")
    return rows.where((c == rank) | (c == 2 * cp - 1 - rank)).withColumn("q_local", local)


def step_clip(rows: DataFrame, cp: int, rank: int, step: int) -> DataFrame:
    """Ranges as the keys of one ring step see them: the owner's two chunks side by side; a range that meets both chunks runs
    from its start in the first to its end in the second."""
    owner = (rank - step) % cp
    size = F.floor(F.col("padded_len") / (2 * cp)).cast("bigint")

    def clip(s: str, e: str) -> tuple[Column, Column]:
        parts = []
        for chunk, base in ((owner, F.lit(0).cast("bigint")), (2 * cp - 1 - owner, size)):
            lo, hi = size * chunk, size * (chunk + 1)
            parts.append((F.least(F.greatest(F.col(s), lo), hi) - lo + base, F.least(F.greatest(F.col(e), lo), hi) - lo + base))
        (a0, b0), (a1, b1) = parts
        in0, in1 = a0 < b0, a1 < b1
        return F.when(in0, a0).otherwise(F.when(in1, a1).otherwise(a0)), F.when(in1, b1).otherwise(b0)

    c0, d0 = clip("s0", "e0")
    c1, d1 = clip("s1", "e1")
    return rows.withColumns({"s0": c0, "e0": d0, "s1": c1, "e1": d1})


def register_udtf(spark, name: str, mask: Callable[[int, str], list[tuple[int, int, int, int]]]) -> None:
    """Register a Python callback (length, parameters as JSON) -> a tuple of ranges per position as the table function
    name(length, parameters) -> q_pos, s0, e0, s1, e1: the hook for masks of the user's own."""

    @udtf(returnType="q_pos bigint, s0 bigint, e0 bigint, s1 bigint, e1 bigint", useArrow=True)
    class Mask:
        def eval(self, n: int, params: str):
            for i, r in enumerate(mask(n, params)):
                yield (i, *r)

    spark.udtf.register(name, Mask)
