"""Language identification by language-bitmask n-gram filters.

Byte 4-grams that are common in a language's training texts go into that language's Bloom filter. The filters are
bit-sliced: one array of slots, each slot a bitmask of the languages that set it, so one probe of `HASHES` slots, and-ed,
returns every language that holds the n-gram. A text's per-language popcounts are corrected for the share of false
positives that each filter's fill implies, divided by the hit rate that the language's own texts show, and the largest wins.

A bitmask has as many 64-bit words as the languages need. A long text is read in pieces that overlap by an n-gram less a
byte, with blanks only where the text itself begins and ends, so that its n-grams are those of the whole text.

Defined results: a null text or one without a letter is `und` with score 0; a text with a letter but no n-gram of any
language gets the commonest language with score 0; ties go to the smaller name; rows without lang only get predictions;
repeated rows are predicted alike, and learned from as one where all three columns are equal; without labelled rows all is
`und`. Columns to keep may have any name but those of the results, which are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded_sample, group_counts, in_fold, pieces, prepare, runs, table, text_bytes, written

#: Training texts of each language, n-grams kept of each language, and the share of its texts that an n-gram must be in.
SAMPLE, GRAMS, SHARE = 2000, 6000, 0.01
SLOT_BITS, HASHES, N = 17, 3, 4
#: Bytes of a piece of a text, and of the texts whose n-grams are counted together.
PIECE, RUN = 512 << 10, 512 << 10
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_SPACE = 0x20202020


def _fold() -> np.ndarray:
    """Letters of ASCII lower-cased, bytes of other characters as they are, all else a space."""
    t = np.full(256, 32, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


def grams(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of (n-gram, row), rows ascending. Every text counts with a space before and after it."""
    fold = _fold()
    for group in pieces(off, PIECE, N - 1):
        rows = np.array([r for r, _, _ in group])
        lens = np.array([b - a for _, a, b in group])
        flat = np.full(int(lens.sum()) + len(group) + 1, 32, np.uint8)
        at = np.cumsum(lens + 1) - lens
        for (_, a, b), x in zip(group, at.tolist(), strict=True):
            flat[x : x + b - a] = fold[raw[a:b]]
        if len(flat) < N:
            continue
        g = flat[: -N + 1].astype(np.uint32)
        for j in range(1, N):
            g |= flat[j : len(flat) - N + 1 + j].astype(np.uint32) << np.uint32(8 * j)
        # a gram starts at a text's leading space or byte and ends at its trailing space at the latest; a piece that goes on
        # has no such space on that side
        begins = np.array([a == off[r] for r, a, _ in group]).astype(np.int64)
        ends = np.array([b == off[r + 1] for r, _, b in group]).astype(np.int64)
        row = np.repeat(np.arange(len(group)), lens + 1)
        place = np.arange(len(row))
        inside = (place + N <= (at + lens + ends)[row]) & (place >= (at - begins)[row])
        n = min(len(g), len(row))
        ok = inside[:n] & (g[:n] != _SPACE)
        yield g[:n][ok], rows[row[:n][ok]]


def slots(g: np.ndarray) -> list[np.ndarray]:
    g = g ^ (g >> np.uint32(15))
    return [((g * k) >> np.uint32(32 - SLOT_BITS)).astype(np.int64) for k in _ODD[:HASHES]]


@dataclass
class Filters:
    langs: list[str]
    table: np.ndarray  # (words of a bitmask, 2^SLOT_BITS)
    false: np.ndarray  # false-positive share of each language's filter
    usual: np.ndarray  # corrected hit rate of each language's own texts
    common: int  # the language with the most training rows

    def counts(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each row, and of them those in each language's filter."""
        n, k = len(off) - 1, len(self.langs)
        total, hits = np.zeros(n), np.zeros((n, k))
        for g, row in grams(raw, off):
            if not len(g):
                continue
            s = slots(g)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            which = row[first]
            total[which] += np.diff(np.append(first, len(row)))
            for w, slices in enumerate(self.table):
                mask = slices[s[0]]
                for x in s[1:]:
                    mask = mask & slices[x]
                kind = mask.dtype.type
                for j in range(64 * w, min(k, 64 * w + 64)):
                    hits[which, j] += np.add.reduceat(((mask >> kind(j - 64 * w)) & kind(1)).astype(np.int32), first)
        return total, hits

    def corrected(self, total: np.ndarray, hits: np.ndarray) -> np.ndarray:
        return np.maximum(0, hits - total[:, None] * self.false) / np.maximum(1e-9, 1 - self.false)

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score of each row."""
        total, hits = self.counts(raw, off)
        share = self.corrected(total, hits) / np.maximum(total, 1)[:, None] / self.usual
        sum_ = share.sum(1)
        best = np.where(sum_ > 0, share.argmax(1), self.common)
        return best, np.where(sum_ > 0, share.max(1) / np.where(sum_ > 0, sum_, 1), 0.0)


def sliced(grams_of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bit-sliced filters that hold each language's n-grams, and the share of slots that each language sets."""
    k = len(grams_of)
    kind = np.uint8 if k <= 8 else np.uint16 if k <= 16 else np.uint32 if k <= 32 else np.uint64
    slices = np.zeros((-(-k // 64), 1 << SLOT_BITS), kind)
    for j, own in enumerate(grams_of):
        for s in slots(own.astype(np.uint32)):
            slices[j // 64, s] |= kind(1 << j % 64)
    return slices, np.array([((slices[j // 64] >> kind(j % 64)) & kind(1)).mean() for j in range(k)])


def fit(labelled: DataFrame, sample: int = SAMPLE, most: int = GRAMS, share: float = SHARE) -> Filters:
    """Build the filters from rows (doc_id, text, lang) with lang, from about `sample` rows of each language, read once."""
    prepare(labelled.sparkSession)
    labelled = labelled.where("lang is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = group_counts(labelled.select("lang"), ["lang"])
    rows = written(bounded_sample(labelled.where("text is not null"), ["lang"], sample, counts=counts), "sample")
    texts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(texts)
    if not langs:
        return Filters([], np.zeros((1, 1 << SLOT_BITS), np.uint8), np.zeros(0), np.ones(0), 0)
    index = {x: k for k, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off, _ = text_bytes(batch.column(0))
            lang = np.array([index[x] for x in batch.column(1).to_pylist()])
            for a, b in runs(off, RUN):
                seen = [np.unique((row.astype(np.uint64) << np.uint64(32)) | g) for g, row in grams(raw[off[a] : off[b]], off[a : b + 1] - off[a])]
                pairs = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
                of = lang[a:b][(pairs >> np.uint64(32)).astype(np.int64)] if len(pairs) else np.zeros(0, np.int64)
                both, n = np.unique((of.astype(np.uint64) << np.uint64(32)) | (pairs & np.uint64(0xFFFFFFFF)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((both >> np.uint64(32)).astype(np.int32)), pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    least = labelled.sparkSession.createDataFrame([(k, max(1, int(share * texts[x]))) for k, x in enumerate(langs)], "lang int, least bigint")
    found = rows.select("text", "lang").mapInArrow(count, "lang int, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))  # of a bounded sample's n-grams
    kept = found.join(F.broadcast(least), "lang").where("n >= least").withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "gram").collect()  # `most` of each language
    own: list[list[int]] = [[] for _ in langs]
    for r in kept:
        own[r["lang"]].append(r["gram"])
    slices, fill = sliced([np.array(x, np.int64) for x in own])
    sizes = {r["lang"]: r["rows"] for r in counts.collect()}
    common = max(range(len(langs)), key=lambda k: (sizes.get(langs[k], 0), -k))
    filters = Filters(langs, slices, fill**HASHES, np.ones(len(langs)), common)

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off, _ = text_bytes(batch.column(0))
            lang = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            total, hits = filters.counts(raw, off)
            own = filters.corrected(total, hits)[np.arange(len(lang)), lang]
            yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(own.astype(np.int64)), pa.array(total.astype(np.int64))], names=["lang", "own", "total"])

    for r in rows.select("text", "lang").mapInArrow(rates, "lang int, own bigint, total bigint").groupBy("lang").agg(F.sum("own").alias("own"), F.sum("total").alias("total")).collect():
        filters.usual[r["lang"]] = max(1e-3, r["own"] / max(1, r["total"]))
    return filters


def identify(docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, lang_pred and score of every row."""
    prepare(docs.sparkSession)
    keep = tuple(c for c in keep if c not in ("lang_pred", "score", text))
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*filters.langs, "und"], object)
        ascii_letter = np.zeros(256, bool)
        ascii_letter[65:91] = ascii_letter[97:123] = True
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            raw, off, null = text_bytes(column)
            before = np.append(0, np.cumsum(ascii_letter[raw]))
            letter = before[off[1:]] > before[off[:-1]]
            for i in np.flatnonzero(~letter & (off[1:] > off[:-1])).tolist():
                letter[i] = any(c.isalpha() for c in column[i].as_py())
            if filters.langs:
                best, score = filters.predict(raw, off)
            else:
                best, score = np.zeros(len(off) - 1, np.int64), np.zeros(len(off) - 1)
            best, score = np.where(letter, best, len(filters.langs)), np.where(letter, score, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best], pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    schema = rows.drop("_text").withColumn("lang_pred", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double")).schema
    return rows.mapInArrow(run, schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = in_fold(3, 1)
    filters = fit(docs.where(~held))
    return identify(docs.withColumn("held_out", held), filters, ("doc_id", "held_out"))
