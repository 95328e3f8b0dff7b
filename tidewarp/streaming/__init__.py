"""Streams: the packer with its open batch as state, the allocator's peaks, windowed counts. Extras beside the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def pack_stream(samples: DataFrame, key: str, budget: int, at_least: float = 0.75) -> DataFrame:
    """Batches of a stream of samples (key, id, n, place), per key in the order of place inside each trigger: key, batch, ids,
    total. The open batch is kept as state between triggers and is not emitted before it closes."""

    def run(k: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        batch, ids, total = state.get if state.exists else (0, [], 0)
        ids, out = list(ids), []
        rows = pd.concat(list(pdfs)).sort_values("place")
        for i, n in zip(rows["id"].tolist(), rows["n"].tolist(), strict=True):
            if n > budget:
                continue
            if total + n > budget:
                if total >= at_least * budget:
                    out.append((k[0], batch, ids, total))
                    batch += 1
                ids, total = [], 0
            ids.append(i)
            total += n
        state.update((batch, ids, total))
        yield pd.DataFrame(out, columns=[key, "batch", "ids", "total"])

    kind = samples.schema[key].dataType.simpleString()
    return samples.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, batch bigint, ids array<bigint>, total bigint", "batch bigint, ids array<bigint>, total bigint", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str, late: str, by: str = "event_type") -> DataFrame:
    """Events per tumbling window and type, late ones up to a limit."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str, user: str = "user_id") -> DataFrame:
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), user).agg(F.count("*").alias("n"))
    return s.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(events: DataFrame, key: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
