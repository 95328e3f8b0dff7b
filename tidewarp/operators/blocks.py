"""Data blocks, pruned work blocks, identifiers, costs. Relational throughout; `batch_id` keys every window.

Sequences: batch_id, seq_id (0 .. in the batch), raw_len. A work block is a (query block, key block) pair that the mask may
meet. Its candidates are exploded from each query block's range hulls onto key-block numbers, so the range join between
blocks is an equi-form explode: no pair of blocks that the hulls rule out is ever made, and no row for each token.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT, Plan
from ..functions import cost
from ..functions.padding import block_tokens, ceil_div
from ..tables import joined
from . import masks

def _before(batch: str = "batch_id"):
    """The sequences of the batch before this one."""
    return Window.partitionBy(batch).orderBy("seq_id").rowsBetween(Window.unboundedPreceding, -1)


def offsets(sequences: DataFrame, plan: Plan = DEFAULT) -> DataFrame:
    """Adds n_blocks and the running offsets of input and output identifiers, i_off and o_off."""
    n = ceil_div(F.col("raw_len").cast("bigint"), plan.block)
    df = sequences.withColumn("n_blocks", n)
    m = plan.model
    running = lambda c: F.coalesce(F.sum(c).over(_before()), F.lit(0)).cast("bigint")
    return df.withColumns({"i_off": running(F.col("n_blocks") * (m.q_blocks + m.kv_blocks)), "o_off": running(F.col("n_blocks") * 2 * m.q_blocks)})


def cu_seqlens(sequences: DataFrame) -> DataFrame:
    """Exclusive running sum of lengths in a batch."""
    return sequences.withColumn("cu_start", F.coalesce(F.sum("raw_len").over(_before()), F.lit(0)).cast("bigint"))


def data_blocks(sequences: DataFrame, plan: Plan = DEFAULT) -> DataFrame:
    """Q, KV, OUT and LSE blocks with identifiers, real tokens and bytes."""
    m = plan.model
    base = offsets(sequences, plan).where("n_blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)))
    kinds = F.array(
        *(F.struct(F.lit(k).alias("kind"), F.lit(h).alias("head")) for k, heads in (("Q", m.q_blocks), ("KV", m.kv_blocks), ("OUT", m.q_blocks), ("LSE", m.q_blocks)) for h in range(heads))
    )
    df = base.withColumn("x", F.explode(kinds)).select("*", F.col("x.kind").alias("kind"), F.col("x.head").alias("head"))
    n, h, b = F.col("n_blocks"), F.col("head"), F.col("block")
    data_id = (
        F.when(F.col("kind") == "Q", F.col("i_off") + h * n + b).when(F.col("kind") == "KV", F.col("i_off") + m.q_blocks * n + h * n + b)
        .when(F.col("kind") == "OUT", F.col("o_off") + 2 * (h * n + b)).otherwise(F.col("o_off") + 2 * (h * n + b) + 1)
    )
    tokens = block_tokens(F.col("raw_len").cast("bigint"), b, plan.block)
    per_token = (
        F.when(F.col("kind").isin("Q", "OUT"), m.head_block * m.head_dim * m.element_bytes)
        .when(F.col("kind") == "KV", 2 * max(1, m.n_groups // m.kv_blocks) * m.head_dim * m.element_bytes).otherwise(4 * m.head_block)
    )
    return df.select("batch_id", data_id.cast("bigint").alias("data_id"), F.col("kind").isin("Q", "KV").cast("int").alias("is_input"), "kind", "seq_id", "head", "block", tokens.alias("n_tokens"), (tokens * per_token).cast("bigint").alias("bytes"))


def _touched(lo, hi, b: int):
    """The blocks that the keys lo .. hi-1 lie in."""
    return F.when(lo < hi, F.sequence(F.floor(lo / b), F.floor((hi - 1) / b))).otherwise(F.array().cast("array<bigint>"))


def _clamped_sum(line, i0, i1, lo, hi):
    """Sum over the positions i0 .. i1-1 of a line's value, held between lo and hi; in closed form."""
    at, slope = line
    n = i1 - i0
    if not slope:
        return n * F.least(F.greatest(at, lo), hi)
    first = at + i0
    under = F.least(F.greatest(lo - first, F.lit(0)), n)
    over = F.least(F.greatest(first + n - hi, F.lit(0)), n)
    mid = n - under - over
    return under * lo + over * hi + mid * (first + under) + F.floor(mid * (mid - 1) / 2)


def block_pairs(sequences: DataFrame, mask: str = "causal", plan: Plan = DEFAULT) -> DataFrame:
    """batch_id, seq_id, raw_len, q_block, kv_block, pairs: block pairs with token pairs that the mask attends.

    The named masks are segments of positions whose ranges move on with the position or stay. A segment's part of a query
    block meets the key blocks between its least and largest key, and its token pairs there are a closed form: no row per token.
    """
    if mask not in masks.SEGMENTS:
        return pairs_of_rows(masks.ranges(sequences.select("batch_id", "seq_id", "raw_len"), mask, plan), plan)
    b = plan.block
    n = F.col("raw_len").cast("bigint")
    out = None
    for a, z, *ends in masks.SEGMENTS[mask](n, plan):
        part = sequences.where("raw_len > 0").select("batch_id", "seq_id", "raw_len", a.alias("a"), z.alias("z"), *(c.alias(f"l{k}") for k, (c, _) in enumerate(ends))).where("a < z")
        part = part.withColumn("q_block", F.explode(F.sequence(F.floor(F.col("a") / b), F.floor((F.col("z") - 1) / b))))
        part = part.withColumn("i0", F.greatest("a", F.col("q_block") * b)).withColumn("i1", F.least("z", (F.col("q_block") + 1) * b))
        s0, e0, s1, e1 = lines = [(F.col(f"l{k}"), slope) for k, (_, slope) in enumerate(ends)]
        hull = lambda s, e: _touched(s[0] + (F.col("i0") if s[1] else 0), e[0] + (F.col("i1") - 1 if e[1] else 0), b)
        part = part.withColumn("kv_block", F.explode(F.array_union(hull(s0, e0), hull(s1, e1))))
        lo, hi = F.col("kv_block") * b, (F.col("kv_block") + 1) * b
        sums = [_clamped_sum(x, F.col("i0"), F.col("i1"), lo, hi) for x in lines]
        part = part.select("batch_id", "seq_id", "raw_len", "q_block", "kv_block", (sums[1] - sums[0] + sums[3] - sums[2]).alias("pairs"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("batch_id", "seq_id", "raw_len", "q_block", "kv_block").agg(F.sum("pairs").cast("bigint").alias("pairs")).where("pairs > 0")


def pairs_of_rows(rows: DataFrame, plan: Plan = DEFAULT) -> DataFrame:
    """Block pairs of any mask's rows (batch_id, seq_id, raw_len, q_pos, s0, e0, s1, e1), as a callback gives them.

    Tokens are folded to (sequence, query block) inside the task before anything is shuffled; empty pairs of a hull are
    filtered once their token pairs are counted.
    """
    b = plan.block
    rows = rows.withColumn("q_block", F.floor(F.col("q_pos") / b).cast("bigint"))
    wide = rows.withColumn("kv_block", F.explode(F.array_union(_touched(F.col("s0"), F.col("e0"), b), _touched(F.col("s1"), F.col("e1"), b))))
    lo, hi = F.col("kv_block") * b, (F.col("kv_block") + 1) * b
    part = lambda s, e: F.greatest(F.lit(0), F.least(e, hi) - F.greatest(s, lo))
    both = part(F.greatest("s0", "s1"), F.least("e0", "e1"))
    both = F.when((F.col("s0") < F.col("e0")) & (F.col("s1") < F.col("e1")), both).otherwise(0)
    attended = part(F.col("s0"), F.col("e0")) + part(F.col("s1"), F.col("e1")) - both
    return wide.groupBy("batch_id", "seq_id", "raw_len", "q_block", "kv_block").agg(F.sum(attended).cast("bigint").alias("pairs")).where("pairs > 0")


def roofline(density, plan: Plan = DEFAULT):
    """Forward and backward milliseconds of a work of padded blocks: the larger of computing and of moving its bytes."""
    m, padded = plan.model, F.lit(plan.block).cast("bigint")
    f, fb = (cost.compute_ms(cost.flops(padded * padded, m, density, back), plan.cluster) for back in (False, True))
    mem, mem_b = (cost.memory_ms(of(padded, padded, m, density), plan.cluster) for of in (cost.bytes_forward, cost.bytes_backward))
    return F.greatest(f, mem), F.greatest(fb, mem_b)


def work_blocks(sequences: DataFrame, mask: str | DataFrame = "causal", plan: Plan = DEFAULT, cost_of=roofline) -> DataFrame:
    """Work blocks of every head with dense identifiers in the order (sequence, head, query block, key block), the blocks
    they read and write, density and forward and backward cost.

    mask: a name, or rows (batch_id, seq_id, raw_len, q_pos, s0, e0, s1, e1) of any other mask. cost_of: density, plan -> the two costs as columns."""
    m = plan.model
    pairs = block_pairs(sequences, mask, plan) if isinstance(mask, str) else pairs_of_rows(mask, plan)
    pairs = joined(pairs, offsets(sequences, plan).select("batch_id", "seq_id", "n_blocks", "i_off", "o_off"), ["batch_id", "seq_id"])
    raw = F.col("raw_len").cast("bigint")
    q, k = block_tokens(raw, F.col("q_block"), plan.block), block_tokens(raw, F.col("kv_block"), plan.block)
    df = pairs.withColumns({"q_tokens": q, "kv_tokens": k}).withColumn("density", F.col("pairs") / (F.col("q_tokens") * F.col("kv_tokens")))
    forward, back = cost_of(F.col("density"), plan)
    df = df.withColumns({"cost_fw": forward, "cost_bw": back})
    df = df.withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(m.q_blocks - 1))))
    order = Window.partitionBy("batch_id").orderBy("seq_id", "head", "q_block", "kv_block")
    n, h = F.col("n_blocks"), F.col("head")
    kv_head = F.floor(h * m.head_block / m.heads_per_group).cast("bigint")
    return df.select(
        "batch_id", (F.row_number().over(order) - 1).cast("bigint").alias("work_id"), "seq_id", "head", "q_block", "kv_block", "q_tokens", "kv_tokens", "pairs", "density", "cost_fw", "cost_bw",
        (F.col("i_off") + h * n + F.col("q_block")).cast("bigint").alias("q_id"), (F.col("i_off") + m.q_blocks * n + kv_head * n + F.col("kv_block")).cast("bigint").alias("kv_id"),
        (F.col("o_off") + 2 * (h * n + F.col("q_block"))).cast("bigint").alias("out_id"), (F.col("o_off") + 2 * (h * n + F.col("q_block")) + 1).cast("bigint").alias("lse_id"),
    )


#: What a work reads (1) and writes (0), forward and backward, and the columns that name it.
FORWARD_IO = (("q", 1, "q_id"), ("kv", 1, "kv_id"), ("out", 0, "out_id"), ("lse", 0, "lse_id"))
BACKWARD_IO = (("q", 1, "q_id"), ("kv", 1, "kv_id"), ("o", 1, "o_id"), ("l", 1, "l_id"), ("do", 1, "do_id"), ("dq", 0, "dq_id"), ("dkv", 0, "dkv_id"))


def is_backward(works: DataFrame) -> bool:
    return "do_id" in works.columns


def io_columns(works: DataFrame) -> tuple:
    return BACKWARD_IO if is_backward(works) else FORWARD_IO


def work_io(works: DataFrame) -> DataFrame:
    """A row for each block that a work reads or writes: batch_id, work_id, io, is_input, data_id."""
    io = F.array(*(F.struct(F.lit(n).alias("io"), F.lit(i).alias("is_input"), F.col(c).alias("data_id")) for n, i, c in io_columns(works)))
    return works.select("batch_id", "work_id", F.explode(io).alias("x")).select("batch_id", "work_id", "x.*")


#: Columns of the data blocks.
DATA = ("batch_id", "data_id", "is_input", "kind", "seq_id", "head", "block", "n_tokens", "bytes")
#: Blocks of the backward pass: kind in the forward pass, is_input, kind, and the works' column that names it.
_BACK = (("Q", 1, "Q", "q_id"), ("KV", 1, "KV", "kv_id"), ("OUT", 1, "OUT", "o_id"), ("LSE", 1, "LSE", "l_id"), ("OUT", 1, "dOUT", "do_id"), ("Q", 0, "dQ", "dq_id"), ("KV", 0, "dKV", "dkv_id"))


def backward_blocks(data: DataFrame, data_device: DataFrame) -> DataFrame:
    """Blocks and homes of the backward pass, with the forward block that each is of (of, of_id) and the works' column that names
    it. Identifiers are dense among the inputs and among the outputs of a batch; a gradient's home is its block's."""
    rows = joined(data, data_device, ["batch_id", "is_input", "data_id"]).withColumnsRenamed({"kind": "of", "data_id": "of_id"}).drop("is_input")
    kinds = F.array(*(F.struct(F.lit(k).alias("rank"), F.lit(of).alias("of"), F.lit(i).alias("is_input"), F.lit(kind).alias("kind"), F.lit(c).alias("column")) for k, (of, i, kind, c) in enumerate(_BACK)))
    rows = rows.withColumn("x", F.explode(F.filter(kinds, lambda x: x["of"] == F.col("of")))).select("*", "x.rank", "x.is_input", "x.kind", "x.column").drop("x")
    order = Window.partitionBy("batch_id", "is_input").orderBy("rank", "of_id")
    return rows.withColumn("data_id", (F.row_number().over(order) - 1).cast("bigint")).select("batch_id", "data_id", "is_input", "kind", "seq_id", "head", "block", "n_tokens", "bytes", "device", "of", "of_id", "column")


def backward_works(works: DataFrame, rows: DataFrame) -> DataFrame:
    """Works of the backward pass over the blocks of `backward_blocks`. A work reads its forward work's blocks, outputs,
    log-sum-exp and the gradient of the outputs, and writes gradients of its queries and of its keys and values; costs are the
    forward pass's."""
    out = works.select("batch_id", "work_id", "seq_id", "head", "q_block", "kv_block", "cost_fw", *(F.col(c).alias(f"_{c}") for _, _, c in FORWARD_IO))
    source = {"Q": "_q_id", "KV": "_kv_id", "OUT": "_out_id", "LSE": "_lse_id"}
    for of, _, _, column in _BACK:
        named = rows.where(F.col("column") == column).select("batch_id", F.col("of_id").alias(source[of]), F.col("data_id").alias(column))
        out = joined(out, named, ["batch_id", source[of]])
    return out.drop(*source.values())


def backward_of(works: dict[str, np.ndarray], data: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """`backward_works` and `backward_blocks` of one batch, whose works and blocks are arrays by column."""
    source = {"Q": "q_id", "KV": "kv_id", "OUT": "out_id", "LSE": "lse_id"}
    out = {x: works[x] for x in ("work_id", "cost", "device")}
    parts, n = [], [0, 0]
    for of, is_input, kind, column in _BACK:
        own = np.flatnonzero(data["kind"] == of)
        own = own[np.argsort(data["data_id"][own], kind="stable")]
        ids = data["data_id"][own]
        at = np.searchsorted(ids, works[source[of]])
        if len(at) and (not len(ids) or (ids[np.minimum(at, len(ids) - 1)] != works[source[of]]).any()):
            raise ValueError(f"a work names a block of kind {of} that the data lack")
        out[column] = n[is_input] + at
        parts.append({x: v[own] for x, v in data.items()} | {"data_id": n[is_input] + np.arange(len(own)), "is_input": np.full(len(own), is_input), "kind": np.full(len(own), kind)})
        n[is_input] += len(own)
    return out, {x: np.concatenate([part[x] for part in parts]) for x in data}


def colocation(data: DataFrame, plan: Plan = DEFAULT) -> DataFrame:
    """Groups of blocks that must share a device: q, out and lse of every head and kv of every head, of one block of a sequence."""
    order = Window.partitionBy("batch_id").orderBy("seq_id", "block")
    return data.select("batch_id", "seq_id", "block", "is_input", "data_id", "bytes", (F.dense_rank().over(order) - 1).cast("bigint").alias("group_id"))


def consumers(works: DataFrame) -> DataFrame:
    """Which works use a block: batch_id, is_input, data_id, works."""
    return work_io(works).groupBy("batch_id", "is_input", "data_id").agg(F.sort_array(F.collect_set("work_id")).alias("works"))


def mask_spans(works: DataFrame, mask: str | DataFrame, plan: Plan = DEFAULT, sequences: DataFrame | None = None) -> DataFrame:
    """Per query position the span of its first range over the key blocks that its query block has, and whether the pieces are
    contiguous (each begins where the one before ends).

    mask: rows of any mask, one for each position; or a name and the sequences, whose positions are made after the join, so
    that none is shuffled. Runs of key blocks meet the range as a whole: no row for each position and key block."""
    b, key = plan.block, ["batch_id", "seq_id", "q_block"]
    before = F.row_number().over(Window.partitionBy(*key).orderBy("kv_block"))
    runs = works.where("head = 0").select(*key, "kv_block").withColumn("run", F.col("kv_block") - before).groupBy(*key, "run").agg((F.min("kv_block") * b).alias("lo"), ((F.max("kv_block") + 1) * b).alias("hi"))
    runs = runs.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    if isinstance(mask, str):
        if sequences is None:
            raise ValueError("a mask's name needs the sequences")
        n = F.col("raw_len").cast("bigint")
        at = F.sequence(F.col("q_block") * b, F.least((F.col("q_block") + 1) * b, n) - 1)
        per = joined(sequences.select("batch_id", "seq_id", "raw_len"), runs, ["batch_id", "seq_id"]).withColumn("q_pos", F.explode(at))
        s0, e0, _, _ = masks.MASKS[mask](F.col("q_pos"), n, plan)
        per = per.withColumns({"s0": s0, "e0": e0})
    else:
        per = joined(mask.withColumn("q_block", F.floor(F.col("q_pos") / b).cast("bigint")), runs, key)
    pieces = F.filter(F.transform("runs", lambda x: F.struct(F.greatest(F.col("s0"), x["lo"]).alias("lo"), F.least(F.col("e0"), x["hi"]).alias("hi"))), lambda x: x["lo"] < x["hi"])
    one, run = F.size("runs") == 1, F.get("runs", 0)
    start = F.when(one, F.greatest(F.col("s0"), run["lo"])).otherwise(F.get(pieces, 0)["lo"])
    end = F.when(one, F.least(F.col("e0"), run["hi"])).otherwise(F.get(pieces, F.size(pieces) - 1)["hi"])
    return per.select("batch_id", "seq_id", "q_pos", start.alias("start"), end.alias("end"), F.when(one, 0).otherwise((F.size(pieces) > 1).cast("int")).alias("gaps")).where("start < end")


def backward(works: DataFrame) -> DataFrame:
    """Backward works: reads q, kv, dout and out/lse of the forward, writes dq and dkv. New identifiers are dense by natural key."""
    dkv = F.dense_rank().over(Window.partitionBy("batch_id").orderBy("kv_id")) - 1
    dq = F.dense_rank().over(Window.partitionBy("batch_id").orderBy("q_id")) - 1
    return works.withColumns({"dq_id": dq.cast("bigint"), "dkv_id": dkv.cast("bigint"), "dout_id": F.col("out_id")}).withColumn("cost", F.col("cost_fw"))
