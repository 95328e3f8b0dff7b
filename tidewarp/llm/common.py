"""Helpers that the training-data operators share: tables, folds, samples, Arrow batches, byte-level words.

Texts are handled as the UTF-8 bytes that Arrow hands over, in numpy, so no Python object is made per word. A null text
is a text of no bytes; every operator says what that means for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..tables import written

__all__ = ["bounded_sample", "carried", "cut_of", "group_counts", "in_fold", "key_runs", "labelled_sample", "mix", "pieces", "prepare", "runs", "table", "text_bytes", "word_table", "words", "written"]

#: Rows of an Arrow batch handed to Python. Long texts are common, so that a batch stays at some MB.
BATCH_ROWS = 400
#: Groups, or ids of a sample, that are broadcast at most, and bytes of the texts of one label in a sample.
GROUPS, SAMPLE_BYTES = 100_000, 64 << 20
U64 = np.uint64


def prepare(spark: SparkSession) -> None:
    """Keep the Arrow batches that go to Python workers small, whatever the length of the texts. A plan reads these settings
    when it runs, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(mod: int, rest: int):
    """Column: crc32 of the doc_id as text leaves this rest. A null doc_id is in no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def group_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """by and `rows`, their count: a row for each group, written."""
    return written(rows.groupBy(*by).agg(F.count("*").alias("rows")), "counts")


def cut_of(bound: int, rows):
    """The share bound / rows of the 63-bit hashes, as the first hash that is left out; a Column or a number.

    The product stays exact enough at any size: a group of 1e11 rows still gives `bound` of them, within rounding.
    """
    if isinstance(rows, (int, float)):
        return min(2**63 - 1, int(bound / max(1, rows) * 2.0**63))
    return F.when(rows <= bound, F.lit(2**63 - 1)).otherwise((F.lit(float(bound)) / rows * F.lit(2.0**63)).cast("bigint"))


def bounded_sample(rows: DataFrame, by: list[str], bound: int, seed: int = 17, counts: DataFrame | None = None) -> DataFrame:
    """About `bound` rows of each group of `by`, by a hash of the whole row: a fit on a bounded sample, never a result.

    Groups under the bound stay whole. Rows that differ in any column are drawn apart, so that a null or repeated doc_id has
    no say. The counts are joined; they are sent to all tasks where they are `GROUPS` at most.
    """
    counts = group_counts(rows, by) if counts is None else counts
    few = counts.limit(GROUPS + 1).count() <= GROUPS
    c = counts.select(*(F.col(x).alias(f"_by_{x}") for x in by), F.col("rows").alias("_rows"))
    same = [F.col(x).eqNullSafe(F.col(f"_by_{x}")) for x in by]
    at = F.xxhash64(*(F.col(x) for x in rows.columns), F.lit(seed)).bitwiseAND(F.lit(2**63 - 1))
    drawn = rows.join(F.broadcast(c) if few else c, reduce(lambda a, b: a & b, same)).where(at <= cut_of(bound, F.col("_rows")))
    return drawn.select(*rows.columns)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label) of about `bound` documents of each label, written once: what a fit reads, however often.

    labels: doc_id, label. Rows with a null in either are left out, repeated ones count once; of documents that repeat a
    doc_id the smallest text is taken. Whole texts of each label are taken in order of a hash while they fit `most_bytes`, so
    that what may reach the driver is bounded in rows and in bytes. Only ids of the sample are broadcast, `GROUPS` at most.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("_label")).distinct()
    drawn = written(bounded_sample(marked, ["_label"], bound), "drawn")
    sent = F.broadcast(drawn) if drawn.limit(GROUPS + 1).count() <= GROUPS else drawn
    rows = docs.select("doc_id", "text").join(sent, "doc_id").groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    rows = written(rows, "sample").select("doc_id", "text", F.col("_label").alias(label))
    sizes = rows.select("doc_id", F.col(label).alias("label"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("doc_id").alias("at"))
    if sizes.groupBy("label").agg(F.sum("size").alias("size")).where(F.col("size") > most_bytes).isEmpty():
        return rows
    before = F.sum("size").over(Window.partitionBy("label").orderBy("at", "doc_id"))  # of a bounded sample
    fits = sizes.withColumn("size", before).where(F.col("size") <= most_bytes).select("doc_id", F.col("label").alias(label))
    return written(rows.join(F.broadcast(fits), ["doc_id", label]), "sample").select("doc_id", "text", label)


def carried(df: DataFrame, *more) -> DataFrame:
    """All columns of df as one struct `row`, whatever their names, with more columns beside it."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *more)


def key_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Cut batches that come sorted by their first columns, whole numbers without nulls, where those change: (key, whether it
    is a new one, rows). A group is never gathered; it may go on over many batches."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(i)) for i in range(n_keys)]
        new = reduce(lambda a, b: a | b, (k[1:] != k[:-1] for k in keys))
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            key = tuple(int(k[a]) for k in keys)
            yield key, key != last, batch.slice(a, b - a)
            last = key


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column, n+1 offsets into them, and whether each row is null (a null has no bytes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    null = np.asarray(column.is_null())
    if null.any():
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64), null
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0], null


def runs(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut the rows into runs of about `most` bytes; a longer row is a run of its own."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def pieces(off: np.ndarray, most: int, overlap: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (row, start, end) of about `most` bytes together. A long row is cut into pieces that share `overlap` bytes."""
    group: list[tuple[int, int, int]] = []
    have = 0
    for row in range(len(off) - 1):
        a, end = int(off[row]), int(off[row + 1])
        while a < end:
            b = min(end, a + most)
            group.append((row, a, b))
            have += b - a
            if have >= most:
                yield group
                group, have = [], 0
            if b == end:
                break
            a = b - overlap
    if group:
        yield group


#: A word's bytes count by their place: byte value + 1 times a power of this odd number, modulo 2^64.
_BASE = U64(0x9E3779B97F4A7C15)
_powers = np.ones(1, U64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.full(max(n, 1024), _BASE, U64)
        _powers[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def word_table(word: str) -> np.ndarray:
    """256 entries: 0 for a byte between words, else the byte, lower-cased if A-Z. word: `plain` splits on white space
    (space and \\t-\\r), `alnum` keeps 0-9, letters and all bytes of non-ASCII characters."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    if word == "plain":
        t[[32, 9, 10, 11, 12, 13]] = 0
        # byte 0 is a word byte here, so it needs another value than the gap's
        t[0] = 255  # never a byte of UTF-8
    else:
        gap = np.ones(256, bool)
        gap[48:58] = gap[65:91] = gap[97:123] = gap[128:256] = False
        t[gap] = 0
    return t


def words(raw: np.ndarray, off: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every row, in order, and n+1 offsets of the rows' words. Hashes are never 0."""
    n = len(off) - 1
    folded = lut[raw]
    inside = folded != 0
    starts_mask = inside.copy()
    starts_mask[1:] &= ~inside[:-1]
    bounds = off[:-1][off[:-1] < len(raw)]
    starts_mask[bounds] |= inside[bounds]
    starts = np.flatnonzero(starts_mask)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)  # word bytes before each word
    lens = np.diff(np.append(first, len(at)))
    place = at - np.repeat(starts, lens)
    value = (folded[at].astype(U64) + U64(1)) * _power(int(lens.max()))[place]
    h = mix(np.add.reduceat(value, first) + lens.astype(U64) * U64(0xA24BAED4963EE407))
    h[h == 0] = 1
    return h, np.searchsorted(starts, off).astype(np.int64)
