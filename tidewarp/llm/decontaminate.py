"""Benchmark decontamination with suffix arrays over the training documents.

Each Arrow run of documents is a shard. A shard's words are hashed; the suffixes that can begin a match (their first
words begin some benchmark suffix) are sorted into the shard's suffix array, every benchmark suffix that begins like one of
them is binary-searched in it, and hits on one diagonal (document word - item word) are joined into the longest verbatim
matches with their places. Shards are independent, so nothing is shuffled and a lost executor only repeats its own runs.

The benchmark is indexed in blocks of a checked size, by about 24 bytes a word: word hashes, and the suffixes in order of
their first words' hash. A block's index is made once, in the driver, and sent to the workers. A larger benchmark takes several
passes, one block after the other; what a pass has found is written to the shared folder, so that one index at a time is held.

Defined results: a null or wordless text has no matches; a null item or one without words has no windows; an item of
fewer words than the window is one window; repeated rows each get their own result; items that repeat an item_id are several
texts of one item; an empty benchmark hits nothing. A long text is one shard, at about forty bytes for each of its bytes.
Columns may have any name: `decontaminate` returns rows as they came, `matches` leaves out columns named as its results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import U64, prepare, runs, table, text_bytes, word_table, words, written

#: Bytes of benchmark text that are indexed as one block; the index takes about four times as many.
BLOCK_BYTES = 32 << 20
#: Bytes of documents in one shard's suffix array.
SHARD_BYTES = 1 << 20
#: Words of a suffix by which positions are admitted to the suffix array.
ADMIT = 4
#: (document word, item word) pairs that are joined at a time, about.
PAIRS = 2 << 20
_ADMIT_BITS = 22
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], U64)

MATCH = "array<struct<item_id:bigint,item_word:int,doc_word:int,n_words:int>>"


class Suffixes:
    """Every suffix of a block of benchmark items that can hold a window, in order of the hash of its first words."""

    def __init__(self, ids: list[int], texts: list[str | None], window: int = 13, word: str = "alnum"):
        self.window, self.word = window, word
        raw, off, _ = text_bytes(pa.array(texts, pa.string()))
        self.h, at = words(raw, off, word_table(word))
        n = np.diff(at)
        depth = np.minimum(window, n)
        count = np.where(n > 0, n - depth + 1, 0)
        self.ids, self.at, self.depth = np.array(ids, np.int64), at, depth.astype(np.int32)
        item = np.repeat(np.arange(len(n), dtype=np.int32), count)
        start = (np.repeat(at[:-1], count) + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32 if len(self.h) < 2**31 else np.int64)
        self.by_first: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        begins = np.minimum(self.depth, ADMIT)[item]
        for q in np.unique(begins).tolist():
            own = start[begins == q]
            first = _start_hash(self.h, own, q)
            order = np.argsort(first, kind="stable")
            bits = np.zeros(1 << _ADMIT_BITS, bool)
            bits[(first >> U64(64 - _ADMIT_BITS)).astype(np.int64)] = True
            self.by_first[q] = first[order], own[order], np.packbits(bits)

    @property
    def nbytes(self) -> int:
        return self.h.nbytes + self.at.nbytes + sum(x.nbytes for own in self.by_first.values() for x in own)

    def _admitted(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a shard that begin like a benchmark suffix, and those suffixes' starts, both ascending."""
        pos, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for q, (first, start, bits) in self.by_first.items():
            if len(h) < q:
                continue
            x = _start_hash(h, np.arange(len(h) - q + 1), q)
            slot = (x >> U64(64 - _ADMIT_BITS)).astype(np.int64)
            may = np.flatnonzero(bits[slot >> 3] & (np.uint8(128) >> (slot & 7).astype(np.uint8)))
            value, inverse = np.unique(x[may], return_inverse=True)
            lo, hi = np.searchsorted(first, value, "left"), np.searchsorted(first, value, "right")
            pos.append(may[(hi > lo)[inverse]])
            n = hi - lo
            starts.append(start[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64))
        return np.unique(np.concatenate(pos)), np.unique(np.concatenate(starts))

    def matches(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Longest matches in a shard: row, item_id, item word, document word and length, by row, item and place."""
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        if not len(h) or not len(self.h):
            return none
        pos, start = self._admitted(h)
        if not len(pos):
            return none
        end = at[np.searchsorted(at, pos, "right")]
        keys = _keys(h, pos, end, self.window)
        order = np.argsort(keys, kind="stable")  # the suffix array, to the window's depth
        keys = keys[order]
        item = np.searchsorted(self.at, start, "right") - 1
        lo, hi = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for a in range(0, len(start), 1 << 16):
            own = slice(a, a + (1 << 16))
            ends = start[own] + self.depth[item[own]]
            lo[own] = np.searchsorted(keys, _keys(self.h, start[own], ends, self.window), "left")
            hi[own] = np.searchsorted(keys, _keys(self.h, start[own], ends, self.window, True), "right")
        count = np.maximum(hi - lo, 0)
        some = np.flatnonzero(count)
        if not len(some):
            return none
        item, start, lo, count = item[some], start[some], lo[some], count[some]
        found = [none]
        for a, b in _item_runs(item, count, PAIRS):
            found.append(self._joined(item[a:b], start[a:b], lo[a:b], count[a:b], pos[order], at))
        row, of, item_word, doc_word, length = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.lexsort((doc_word, doc_word - item_word, of, row))
        return row[by], self.ids[of[by]], item_word[by], doc_word[by], length[by]

    def _joined(self, item: np.ndarray, start: np.ndarray, lo: np.ndarray, count: np.ndarray, places: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """The matches of some items' windows: windows on one diagonal, each a word after the last, are one match."""
        s = np.repeat(np.arange(len(count)), count)
        p = places[np.repeat(lo, count) + np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)]
        row = np.searchsorted(at, p, "right") - 1
        doc_word, item_word, item, depth = p - at[row], (start - self.at[item])[s], item[s], self.depth[item][s].astype(np.int64)
        by = np.lexsort((doc_word, doc_word - item_word, item, row))
        row, doc_word, item, item_word, depth = (x[by] for x in (row, doc_word, item, item_word, depth))
        fresh = np.ones(len(row), bool)
        fresh[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (doc_word[1:] != doc_word[:-1] + 1) | (item_word[1:] != item_word[:-1] + 1)
        begin = np.flatnonzero(fresh)
        last = np.append(begin[1:], len(row)) - 1
        return row[begin], item[begin], item_word[begin], doc_word[begin], doc_word[last] - doc_word[begin] + depth[last]


def _item_runs(item: np.ndarray, count: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole items with about `most` pairs together; an item of more is a run of its own."""
    edges = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
    total = np.append(0, np.cumsum(count))
    a = 0
    for e, f in zip(edges.tolist(), [*edges[1:].tolist(), len(item)], strict=True):
        if e > a and total[f] - total[a] > most:
            yield a, e
            a = e
    yield a, len(item)


def _keys(h: np.ndarray, pos: np.ndarray, end: np.ndarray, window: int, high: bool = False) -> np.ndarray:
    """The words from each position up to `end`, window at most, as a string that sorts like them; then zeros, or ones if high."""
    keys = np.full((len(pos), window), 0xFFFFFFFFFFFFFFFF if high else 0, U64)
    for j in range(window):
        on = pos + j < end
        keys[on, j] = h[pos[on] + j]
    return np.ascontiguousarray(keys.byteswap()).view(f"S{8 * window}").ravel()


def _start_hash(h: np.ndarray, pos: np.ndarray, q: int) -> np.ndarray:
    x = h[pos] * _FACTORS[0]
    for j in range(1, q):
        x = x + h[pos + j] * _FACTORS[j]
    x = x ^ (x >> U64(29))
    return x * _FACTORS[3]


def _blocks(benchmark: DataFrame, window: int, word: str, block_bytes: int) -> Iterator[Suffixes]:
    """The indexes of the benchmark, a block of items at a time; an item over the size is a block of its own."""
    items: list[tuple[int, str]] = []
    room = block_bytes
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        size = len(r["text"].encode())
        if size > room and items:
            yield Suffixes([i for i, _ in items], [t for _, t in items], window, word)
            items, room = [], block_bytes
        items.append((r["item_id"], r["text"]))
        room -= size
    yield Suffixes([i for i, _ in items], [t for _, t in items], window, word)


def _searcher(sent):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        lut = word_table(index.word)
        for batch in batches:
            names = batch.schema.names
            raw, off, _ = text_bytes(batch.column(names.index("text")))
            found: list[list[dict]] = [m or [] for m in batch.column(names.index("matches")).to_pylist()]
            n_words = np.zeros(batch.num_rows, np.int64)
            for a, b in runs(off, SHARD_BYTES):
                h, at = words(raw[off[a] : off[b]], off[a : b + 1] - off[a], lut)
                n_words[a:b] = np.diff(at)
                for r, i, q, p, n in zip(*(x.tolist() for x in index.matches(h, at)), strict=True):
                    found[a + r].append({"item_id": i, "item_word": q, "doc_word": p, "n_words": n})
            columns = {n: batch.column(n) for n in names}
            columns["matches"] = pa.array(found, batch.schema.field("matches").type)
            columns["n_words"] = pa.array(n_words)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return search


def _found(docs: DataFrame, benchmark: DataFrame, window: int, word: str, keep: list[str], text: str, block_bytes: int) -> DataFrame:
    """row (the columns to keep), text, matches and n_words of every document."""
    spark = docs.sparkSession
    prepare(spark)
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(0).alias("_"))
    out = docs.select(kept.alias("row"), F.col(text).alias("text"), F.lit(None).cast(MATCH).alias("matches"), F.lit(0).cast("bigint").alias("n_words"))
    before = None
    for index in _blocks(benchmark, window, word, block_bytes):
        if before is not None:  # another block: the one before is done with, and its index with it
            out = written(out, "matches")
            before.destroy()
        before = spark.sparkContext.broadcast(index)  # of a checked size: some block_bytes, or one longer item's
        out = out.mapInArrow(_searcher(before), out.schema)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, word: str = "alnum", keep: tuple[str, ...] = ("doc_id",), text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns `keep` of every document, its longest verbatim `matches` with the benchmark, and n_words.

    benchmark: item_id, text. Matches of under `window` words are left out (items of fewer words match whole).
    """
    keep = tuple(c for c in keep if c not in ("matches", "n_words"))
    out = _found(docs, benchmark, window, word, list(keep), text, block_bytes)
    return out.select(*(F.col(f"row.`{c}`") for c in keep), "matches", "n_words")


def n_hit(found: Column) -> Column:
    """Words of the document inside any of its matches: the length of the union of their spans."""
    spans = F.array_sort(F.transform(found, lambda m: F.struct(m["doc_word"].alias("a"), (m["doc_word"] + m["n_words"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("b"))
    return F.aggregate(
        spans, zero,
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["b"], x["a"]))).cast("bigint").alias("n"), F.greatest(s["b"], x["b"]).alias("b")),
        lambda s: s["n"],
    )


def judged(found: DataFrame, one_in: int = 20) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (hit words are a `one_in`-th of the words or more)."""
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    return (
        found.withColumn("n_hit", n_hit(F.col("matches")))
        .withColumn("n_items", F.size(items).cast("bigint"))
        .withColumn("items_sha256", F.sha2(F.array_join(items, ","), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words")))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    found = _found(docs, benchmark, window, "alnum", docs.columns, text, block_bytes)
    return judged(found.drop("text"), one_in).where(~F.col("contaminated")).select("row.*")


OP2_SQL = r"""
with low(doc_id, words) as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from documents),
items(item_id, words) as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark where text is not null),
windows as (
  select distinct item_id, least(13, len(words)) as d, array_to_string(words[q : q + least(13, len(words)) - 1], ' ') as win
  from (select item_id, words, unnest(generate_series(1, len(words) - least(13, len(words)) + 1)) as q from items where len(words) > 0)),
depths as (select distinct d from windows),
places as (
  select doc_id, d, p, array_to_string(words[p : p + d - 1], ' ') as win
  from (select doc_id, words, d, unnest(generate_series(1, len(words) - d + 1)) as p from low, depths where len(words) >= d)),
found as (select p.doc_id, p.p, w.d, w.item_id from places p join windows w on p.d = w.d and p.win = w.win),
hit as (select doc_id, count(*) as n from (select distinct doc_id, unnest(generate_series(p, p + d - 1)) as x from found) group by doc_id),
named as (select doc_id, count(*) as n, sha256(string_agg(item, ',' order by item)) as sha from (select distinct doc_id, item_id::varchar as item from found) group by doc_id)
select l.doc_id, len(l.words)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(n.n, 0)::bigint as n_items,
  coalesce(n.sha, sha256('')) as items_sha256, coalesce(h.n, 0) > 0 and 20 * coalesce(h.n, 0) >= len(l.words) as contaminated
from low l left join hit h using (doc_id) left join named n using (doc_id)
"""


def op2(spark, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
