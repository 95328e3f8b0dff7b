"""Mixing by soft membership: document rates under which the expected tokens of each domain match target weights.

A softmax classifier over hashed byte 3-grams, trained on a bounded sample of a labelled table (doc_id, domain), gives each
document a posterior over domains. Nonnegative rates r then minimise the squared distance between the expected tokens of
each domain, sum over documents of r * tokens * posterior, and target weight * total tokens, by projected gradient: each
pass adds up one vector of domain totals over all documents, and each document moves along its own posterior and stops at
0. Steps are scaled by the inverse of the free rows' second moments, so that few passes do. A document's rate follows
from its posterior and the list of steps alone; so only that list, a vector per pass, is ever on the driver, and any lost
partition is computed again from its rows. Texts are read once: posteriors and the columns to keep are written beside each
other, and passes and results read that table. `Rates.gap` says how far from the targets the totals have stayed.

Defined results: a null or empty text has no tokens, the classifier's prior as posterior, and gets a rate like any other;
an unlabelled domain without target gets weight 0; targets of domains that no document can reach stay unmet, the others
are matched in the least-squares sense; without labels there is one domain and every rate is the same; an empty table gives
no rows; repeated rows get equal rates. A doc_id with two domains teaches both; of documents that repeat a doc_id the smallest
text is learned from. Of columns named as the results are, the results' stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import labelled_sample, pieces, prepare, table, text_bytes, written

#: Labelled rows of each domain that the fit takes, hashed features, passes of the fit and of the projected gradient.
SAMPLE, BITS, EPOCHS, PASSES = 600, 11, 150, 40
#: Rows, of 8 KB each, and bytes of text that the fit takes over all domains.
MOST, SAMPLE_BYTES = 30_000, 256 << 20
#: The relative distance to the targets at which the passes end.
NEAR = 1e-7
PIECE = 512 << 10
#: Target weights of the query's domains, the languages.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
_ODD = np.uint32(0x9E3779B1)


def _grams(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of (hashed 3-gram, row), rows ascending."""
    fold = np.arange(256, dtype=np.uint32)
    fold[65:91] += 32
    for group in pieces(off, PIECE, 2):
        lens = np.array([b - a for _, a, b in group])
        flat = np.concatenate([raw[a:b] for _, a, b in group])
        if len(flat) < 3:
            continue
        x = fold[flat]
        g = ((x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * _ODD) >> np.uint32(32 - BITS)
        row = np.repeat(np.arange(len(group)), lens)
        ok = row[:-2] == row[2:]
        yield g[ok].astype(np.int64), np.array([r for r, _, _ in group])[row[:-2][ok]]


@dataclass
class Domains:
    """The domains' names and a softmax over the mean of their weights for a text's 3-grams."""

    names: list[str]
    weights: np.ndarray
    prior: np.ndarray

    def posterior(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        total, count = np.zeros((n, len(self.names))), np.zeros(n)
        for g, row in _grams(raw, off):
            if not len(g):
                continue
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            which = row[first]
            total[which] += np.add.reduceat(self.weights[g], first, 0)
            count[which] += np.diff(np.append(first, len(row)))
        z = total / np.maximum(count, 1)[:, None] + self.prior
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def fit_domains(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, seed: int = 3) -> Domains:
    """Train on about `sample` documents of each domain of labelled (doc_id, domain), drawn before any text is read; fewer of
    each where all domains together would give over `MOST`."""
    prepare(docs.sparkSession)
    labelled = labelled.select("doc_id", F.col("domain").cast("string").alias("domain"))
    k = labelled.select("domain").distinct().count()
    rows = labelled_sample(docs, labelled, "domain", max(1, min(sample, MOST // max(1, k))), SAMPLE_BYTES // max(1, k))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off, _ = text_bytes(batch.column(1))
            x = np.zeros((batch.num_rows, 1 << BITS), np.float32)
            for g, row in _grams(raw, off):
                np.add.at(x, (row, g), 1)
            x /= np.maximum(x.sum(1, keepdims=True), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "domain", "x"])

    got = sorted(rows.mapInArrow(features, "doc_id bigint, domain string, x binary").collect(), key=lambda r: (r["doc_id"], r["domain"], r["x"]))  # bounded by `sample`
    names = sorted({r["domain"] for r in got}) or [""]
    if len(names) == 1:
        return Domains(names, np.zeros((1 << BITS, 1)), np.zeros(1))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got]) * 100
    y = np.eye(len(names), dtype=np.float32)[[names.index(r["domain"]) for r in got]]
    y_share = y.mean(0)
    w, b = np.zeros((1 << BITS, len(names)), np.float32), np.log(y_share)
    m = v = 0.0
    for turn in range(1, EPOCHS + 1):
        z = x @ w + b
        z = np.exp(z - z.max(1, keepdims=True))
        grad = x.T @ (z / z.sum(1, keepdims=True) - y) / len(y) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.05 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Domains(names, w.astype(np.float64) * 100, b.astype(np.float64))


@dataclass
class Rates:
    """Rates as a function of the posterior: start, then the projected steps in turn."""

    start: np.ndarray
    steps: list[np.ndarray] = field(default_factory=list)
    #: sum over domains of the distance between totals and targets, over the sum of the targets
    gap: float = 0.0

    def of(self, p: np.ndarray) -> np.ndarray:
        r = np.maximum(0, p @ self.start)
        for s in self.steps:
            r = np.maximum(0, r - p @ s)
        return r


def _measured(docs: DataFrame, domains: Domains, text: str, keep: list[str]) -> DataFrame:
    """row (the columns to keep), n_tokens (white-space words) and the posterior p of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, p = measure(batch.column(1), domains)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), _doubles(p)], names=["row", "n_tokens", "p"])

    kept = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(0).alias("_"))
    rows = docs.select(kept.alias("row"), F.col(text).alias("text"))
    schema = rows.select("row", F.lit(None).cast("bigint").alias("n_tokens"), F.lit(None).cast("array<double>").alias("p")).schema
    return rows.mapInArrow(run, schema)


def measure(column: pa.Array, domains: Domains) -> tuple[np.ndarray, np.ndarray]:
    raw, off, _ = text_bytes(column)
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    inside = ~space[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = off[:-1][off[:-1] < len(raw)]
    begins[firsts] |= inside[firsts]
    before = np.append(0, np.cumsum(begins))
    return before[off[1:]] - before[off[:-1]], domains.posterior(raw, off)


def _doubles(p: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1]), pa.int32()), pa.array(p.ravel()))


def solve(measured: DataFrame, targets: np.ndarray, passes: int = PASSES, near: float = NEAR) -> Rates:
    """Projected-gradient least squares over (n_tokens, p); each pass is one aggregation, a row per task to the driver.

    A pass adds up the totals and the second moments of the posteriors of rows whose rate is above 0, whose inverse scales
    the gradient. A step that does not bring the totals nearer is halved; after some halvings all rows' moments scale it."""
    k = len(targets)

    def totals(rates: Rates | None) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(k + k * k)
            for batch in batches:
                if batch.num_rows:
                    t, p = np.asarray(batch.column(0)).astype(float), np.asarray(batch.column(1).flatten()).reshape(-1, k)
                    r = np.ones(len(p)) if rates is None else rates.of(p)
                    own += np.append((t * r) @ p, (p * (t * (r > 0))[:, None]).T @ p)
            yield pa.RecordBatch.from_arrays([pa.array([own.tolist()], pa.list_(pa.float64()))], names=["s"])

        got = measured.select("n_tokens", "p").mapInArrow(run, "s array<double>").select(F.posexplode("s")).groupBy("pos").agg(F.sort_array(F.collect_list("col")).alias("own"))
        parts = {r["pos"]: math.fsum(r["own"]) for r in got.collect()}  # as many rows as domains, squared; a number per task in each
        x = np.array([parts.get(i, 0.0) for i in range(k + k * k)])
        return x[:k], x[k:].reshape(k, k)

    have, all_moments = totals(None)
    want = targets * have.sum()
    if have.sum() <= 0:
        return Rates(np.ones(k), gap=1.0)
    rates = Rates(np.where(have > 0, want / np.where(have > 0, have, 1), 0.0))
    inverse = lambda m: np.linalg.pinv(m, rcond=1e-9, hermitian=True)
    total, moments = totals(rates)
    scale = 1.0
    for _ in range(passes):
        off = total - want
        gap = float(np.abs(off).sum() / want.sum())
        rates.gap = gap
        if gap < near or scale < 1e-4:
            break
        step = scale * inverse(moments if scale > 0.1 else all_moments) @ off
        ahead = Rates(rates.start, [*rates.steps, step])
        total_ahead, moments_ahead = totals(ahead)
        if np.square(total_ahead - want).sum() < np.square(off).sum() * (1 - 1e-6):
            rates, total, moments, scale = ahead, total_ahead, moments_ahead, min(1.0, 2 * scale)
        else:
            scale /= 2
    rates.gap = float(np.abs(total - want).sum() / want.sum())
    return rates


ADDED = ["n_tokens", "domain", "posterior", "rate"]


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, Domains, Rates]:
    """The columns `keep` (all) with n_tokens, domain (likeliest), posterior and rate; the domains and rates that gave them."""
    domains = fit_domains(docs, labelled)
    weights = np.array([max(0.0, targets.get(n, 0.0)) for n in domains.names])
    weights = weights / weights.sum() if weights.sum() > 0 else np.full(len(weights), 1 / len(weights))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    measured = written(_measured(docs, domains, text, keep), "measured")
    rates = solve(measured, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(domains.names, object)
        for batch in batches:
            p = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[p.argmax(1)], pa.string()), batch.column(2), pa.array(rates.of(p))], names=["row", *ADDED])

    added = measured.withColumns({"domain": F.lit(None).cast("string"), "posterior": F.col("p"), "rate": F.lit(None).cast("double")})
    out = measured.mapInArrow(run, added.select("row", *ADDED).schema)
    return out.select(*(F.col(f"row.`{c}`") for c in keep), *ADDED), domains, rates


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, docs.select("doc_id", F.col("lang").alias("domain")), TARGETS, keep=["doc_id"])[0]
