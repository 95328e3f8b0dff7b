"""Caching-allocator simulation over a stream of allocations and releases, in batch or as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

ROUND = 512


class Allocator:
    """Best fit over cached segments, split and merged with free neighbours; a request that does not fit under the capacity
    first gives back unused segments, then fails."""

    def __init__(self, capacity: int | None = None):
        self.capacity = capacity
        self.segments: list[list[list]] = []  # of [size, owner or None] pieces
        self.allocated = self.reserved = self.peak_allocated = self.peak_reserved = self.failures = 0

    def malloc(self, owner: int, size: int) -> bool:
        size = max(ROUND, -(-size // ROUND) * ROUND)
        fits = [(p[0], s, i) for s, seg in enumerate(self.segments) for i, p in enumerate(seg) if p[1] is None and p[0] >= size]
        if not fits:
            if self.capacity is not None and self.reserved + size > self.capacity:
                kept = [seg for seg in self.segments if len(seg) > 1 or seg[0][1] is not None]
                self.reserved = sum(p[0] for seg in kept for p in seg)
                self.segments = kept
            if self.capacity is not None and self.reserved + size > self.capacity:
                self.failures += 1
                return False
            self.segments.append([[size, None]])
            self.reserved += size
            fits = [(size, len(self.segments) - 1, 0)]
        have, s, i = min(fits)
        self.segments[s][i : i + 1] = [[size, owner]] + ([[have - size, None]] if have > size else [])
        self.allocated += size
        self.peak_allocated, self.peak_reserved = max(self.peak_allocated, self.allocated), max(self.peak_reserved, self.reserved)
        return True

    def free(self, owner: int) -> None:
        for seg in self.segments:
            for i, p in enumerate(seg):
                if p[1] == owner:
                    p[1] = None
                    self.allocated -= p[0]
                    if i + 1 < len(seg) and seg[i + 1][1] is None:
                        p[0] += seg.pop(i + 1)[0]
                    if i and seg[i - 1][1] is None:
                        seg[i - 1][0] += seg.pop(i)[0]
                    return

    def feed(self, rows: Iterator[tuple[str, int, int]]) -> Allocator:
        for kind, block, size in rows:
            self.malloc(block, size) if kind == "malloc" else self.free(block)
        return self


def peaks(events: DataFrame, key: str, capacity: int | None = None) -> DataFrame:
    """Peaks of each key's stream of events (key, seq_no, kind malloc / free, block, bytes)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq_no")
        a = Allocator(capacity).feed(zip(pdf["kind"], pdf["block"], pdf["bytes"], strict=True))
        return pd.DataFrame([(pdf[key].iloc[0], a.peak_allocated, a.peak_reserved, a.failures)], columns=[key, "peak_allocated", "peak_reserved", "failures"])

    return events.groupBy(key).applyInPandas(run, f"{key} {events.schema[key].dataType.simpleString()}, peak_allocated bigint, peak_reserved bigint, failures int")
