"""Token-budget batching and small greedy splits.

Next-fit packing depends on what came before, but only through the tokens of the open batch. A chunk of the ordered
sequences therefore summarises as: for each of its first rows at which a batch may begin, how full the open batch is at the
chunk's end. Chunks are summarised in parallel, the summaries are chained in order (a few hundred numbers a chunk,
streamed, never all rows), and chunks are then packed in parallel from their known entry: the exact sequential result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..tables import joined, written

#: Rows of an order-contiguous chunk, about.
CHUNK_ROWS = 200_000


def _starts(cum: np.ndarray, first: int, budget: int) -> np.ndarray:
    """Batch starts from row `first` on: a row begins a batch when the open one cannot take it."""
    out, i, n = [], first, len(cum) - 1
    while i < n:
        out.append(i)
        i = max(i + 1, int(np.searchsorted(cum, cum[i] + budget, "right")) - 1)
    return np.array(out, np.int64)


def _chunked(lengths: DataFrame, chunk_rows: int) -> DataFrame:
    """(place, id, n, chunk): chunks are runs of the order; place sorts within and across chunks."""
    n = lengths.count()
    chunks = max(1, -(-n // chunk_rows))
    df = lengths.select(F.col("place").cast("bigint"), F.col("id").cast("bigint"), F.col("n").cast("bigint"))
    if chunks == 1:
        return df.withColumn("chunk", F.lit(0))
    cuts = [int(x) for x in df.approxQuantile("place", [i / chunks for i in range(1, chunks)], 1 / (4 * chunks))]
    chunk = F.lit(0)
    for c in sorted(set(cuts)):
        chunk = chunk + (F.col("place") >= c).cast("int")
    return df.withColumn("chunk", chunk)


def pack(lengths: DataFrame, budget: int, at_least: float = 0.75, last: str = "if_full", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Batches of lengths (place, id, n) in the order of place: batch_id, seq_in_batch, id, n, reason.

    Samples are taken until the next would exceed the budget; a batch is emitted if it holds `at_least` of the budget, else
    its samples are left out (reason `underfull`). `last`: the final batch is emitted `if_full` too, or `never`. A sample
    over the budget alone is left out (reason `too_long`) and does not touch the open batch. batch_id counts emitted batches;
    it is null for samples left out.
    """
    lengths = written(lengths.select("place", "id", "n"), "lengths")  # two numbers a row; texts are read once
    too_long = lengths.where(F.col("n") > budget).select(F.lit(None).cast("bigint").alias("batch_id"), F.lit(None).cast("bigint").alias("seq_in_batch"), F.col("id").cast("bigint"), F.col("n").cast("bigint"), F.lit("too_long").alias("reason"))
    fine = _chunked(lengths.where(F.col("n").isNotNull() & (F.col("n") <= budget)), chunk_rows)

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "id"])
        cum = np.append(0, np.cumsum(pdf["n"].to_numpy()))
        heads = int(np.searchsorted(cum, budget, "right"))  # a batch open before the chunk ends at one of these rows
        ends = [int(cum[-1] - cum[_starts(cum, j, budget)[-1]]) if j < len(cum) - 1 else 0 for j in range(min(heads, len(cum) - 1))]
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "cum": [cum[: heads + 1].tolist()], "ends": [ends], "total": [int(cum[-1])]})

    entry, open_ = {}, 0
    for r in fine.groupBy("chunk").applyInPandas(summary, "chunk int, cum array<bigint>, ends array<bigint>, total bigint").orderBy("chunk").toLocalIterator():
        entry[r["chunk"]] = open_
        # the first row that the open batch cannot take
        j = next((i for i in range(len(r["ends"])) if open_ + r["cum"][i + 1] > budget), None)
        open_ = open_ + r["total"] if j is None else r["ends"][j]
    carried = fine.sparkSession.createDataFrame(sorted(entry.items()), "chunk int, entry bigint") if entry else None

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "id"])
        cum = np.append(0, np.cumsum(pdf["n"].to_numpy()))
        entry_ = int(pdf["entry"].iloc[0])
        first = 0
        if entry_:
            first = max(0, int(np.searchsorted(cum, budget - entry_, "right")) - 1)
        begin = np.zeros(len(pdf), bool)
        begin[_starts(cum, first, budget)] = True
        return pd.DataFrame({"place": pdf["place"], "id": pdf["id"], "n": pdf["n"], "chunk": pdf["chunk"], "begins": begin})

    if carried is None:
        return too_long
    rows = fine.join(F.broadcast(carried), "chunk").groupBy("chunk").applyInPandas(place, "place bigint, id bigint, n bigint, chunk int, begins boolean")
    rows = written(rows, "placed")
    # number the batches: starts inside each chunk, plus the starts of the chunks before
    own = Window.partitionBy("chunk").orderBy("place", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("k", F.sum(F.col("begins").cast("bigint")).over(own))
    before = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("chunk").agg(F.sum(F.col("begins").cast("bigint")).alias("starts")).withColumn("base", F.coalesce(F.sum("starts").over(before), F.lit(0))).select("chunk", "base")
    raw = rows.join(F.broadcast(base), "chunk").withColumn("raw", F.col("base") + F.col("k"))
    totals = raw.groupBy("raw").agg(F.sum("n").alias("total"), F.min("chunk").alias("chunk"))
    final = totals.agg(F.max("raw").alias("final"))
    ok = (F.col("total") >= at_least * budget) & (F.lit(last == "if_full") | (F.col("raw") < F.col("final")))
    kept = totals.crossJoin(F.broadcast(final)).withColumn("ok", ok)  # one row
    # number the emitted ones: by chunk first, so that no window runs over all batches
    within = Window.partitionBy("chunk").orderBy("raw").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.withColumn("rank", F.sum(F.col("ok").cast("bigint")).over(within))
    ahead = kept.groupBy("chunk").agg(F.sum(F.col("ok").cast("bigint")).alias("oks")).withColumn("ahead", F.coalesce(F.sum("oks").over(before), F.lit(0))).select("chunk", "ahead")
    kept = kept.join(F.broadcast(ahead), "chunk").select("raw", "ok", (F.col("ahead") + F.col("rank") - 1).alias("emitted"))
    placed = joined(raw.drop("chunk"), kept, "raw").withColumn("seq_in_batch", F.row_number().over(Window.partitionBy("raw").orderBy("place", "id")) - 1)
    placed = placed.select(F.when(F.col("ok"), F.col("emitted")).alias("batch_id"), F.when(F.col("ok"), F.col("seq_in_batch")).cast("bigint").alias("seq_in_batch"), "id", "n", F.when(~F.col("ok"), "underfull").alias("reason"))
    return placed.unionByName(too_long)


def batch_stats(batches: DataFrame) -> DataFrame:
    """Sequences per batch: mean, least, most; batches."""
    per = batches.groupBy("batch_id").agg(F.count("*").alias("k"))
    return per.agg(F.avg("k").alias("mean_seqs"), F.min("k").alias("min_seqs"), F.max("k").alias("max_seqs"), F.count("*").alias("n_batches"))


def shuffled_place(id_: Column, seed: int) -> Column:
    """A place in a shuffled order: the same for the same seed on any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(id_.cast("string"), F.lit(f"-{seed}")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def sample(df: DataFrame, k: int, seed: int, by: str) -> DataFrame:
    """k rows, drawn by hash without replacement: the same ones for the same seed."""
    return df.orderBy(shuffled_place(F.col(by), seed), by).limit(k)


def greedy_groups(lengths: list[int], groups: int, descending: bool) -> list[int]:
    """Group of each length: to the least loaded, lowest index on ties; longest first if `descending`, else as they come."""
    load, out = [0] * groups, [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i] if descending else 0, i)):
        g = min(range(groups), key=lambda d: (load[d], d))
        load[g] += lengths[i]
        out[i] = g
    return out


def block_size(lengths: list[int], devices: int, eps: float = 0.2, least: int = 256) -> int:
    """Largest power of two, from the one that holds the longest sequence down to `least`, whose blocks spread over the devices
    within max / mean <= 1 + eps."""
    size = 1 << max(0, (max(lengths) - 1).bit_length())
    while size > least:
        blocks = [b for n in lengths for b in [size] * (n // size) + ([n % size] if n % size else [])]
        load = [0] * devices
        for i, g in enumerate(greedy_groups(blocks, devices, True)):
            load[g] += blocks[i]
        if min(load) > 0 and max(load) / (sum(load) / devices) <= 1 + eps:
            return size
        size //= 2
    return max(size, least) if size else least


def dp_split(batches: DataFrame, groups: int, descending: bool = False) -> DataFrame:
    """dp_group of each sequence of a batch (batch_id, seq_in_batch, id, n): online greedy, or longest first."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq_in_batch")
        return pdf.assign(dp_group=greedy_groups(pdf["n"].tolist(), groups, descending))[["batch_id", "seq_in_batch", "id", "n", "dp_group"]]

    return batches.groupBy("batch_id").applyInPandas(run, "batch_id bigint, seq_in_batch bigint, id bigint, n bigint, dp_group int")


def block_sizes(batches: DataFrame, devices: int, eps: float = 0.2) -> DataFrame:
    """The block size of each batch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"batch_id": [pdf["batch_id"].iloc[0]], "block_size": [block_size(pdf["n"].tolist(), devices, eps)]})

    return batches.groupBy("batch_id").applyInPandas(run, "batch_id bigint, block_size int")
