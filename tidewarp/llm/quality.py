"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, `FILTERS` learned filters of `WIDTH` bytes slide over the whole text `STRIDE` bytes at a time, and
each filter's response is max-pooled over overlapping chunks (`CHUNK` bytes, half of them shared with the next). The mean,
largest and smallest of the chunks' maxima, and the text's length, are combined into one probability. Trained by Adam on a
bounded sample of labelled rows; scoring covers every byte of every text.

Defined results: a null or empty text is one chunk of padding and gets that score; without labels the score is 0.5;
with labels of one class only it is that class's smoothed share. Ties at 0.5 predict 1. Repeated rows score alike, and a
null doc_id is scored like any other. Labels other than 0 and 1 teach nothing, nor do those of a null doc_id; of documents
that repeat a doc_id the smallest text is learned from. Columns to keep may have any name but those of the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_fold, labelled_sample, prepare, runs, table, text_bytes

#: Labelled rows of each class that the fit takes, at most (by hash of doc_id), and passes over them.
SAMPLE, EPOCHS = 1500, 5
EMBED, WIDTH, STRIDE, FILTERS, HOP = 6, 12, 4, 24, 128
PER_HOP = HOP // STRIDE
#: Texts are scored in runs of this many bytes.
RUN = 256 << 10


def lay_out(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each from a multiple of HOP and padded with 0, and n+1 offsets counted in hops."""
    hops = -(-(np.diff(off) + WIDTH) // HOP)  # so that windows over the text end in its own padding
    at = np.append(0, np.cumsum(hops))
    flat = np.zeros(int(at[-1]) * HOP + WIDTH, np.uint8)
    for i in range(len(hops)):
        flat[at[i] * HOP : at[i] * HOP + off[i + 1] - off[i]] = raw[off[i] : off[i + 1]]
    return flat, at


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    head: np.ndarray
    intercept: float
    moments: dict = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), rng.normal(0, 0.15, (WIDTH * EMBED, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(3 * FILTERS + 1, np.float32), 0.0)

    def windows(self, flat: np.ndarray) -> np.ndarray:
        e = self.embed[flat]
        n = (len(flat) - WIDTH) // STRIDE
        s = e.strides[0]
        return np.lib.stride_tricks.as_strided(e, (n, WIDTH * EMBED), (STRIDE * s, e.strides[1]))

    def features(self, flat: np.ndarray, at: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, dict]:
        """Of each text: mean, max and min over chunks of the filters' maxima, and log length; and what backward() needs."""
        response = np.ascontiguousarray(self.windows(flat)) @ self.filters
        for k in range(1, -(-WIDTH // STRIDE)):  # a text's last windows lie in its padding and reach into the next text
            response[at[1:] * PER_HOP - k] = -1e9
        by_hop = response.reshape(-1, PER_HOP, FILTERS)
        arg = by_hop.argmax(1)
        top = np.take_along_axis(by_hop, arg[:, None, :], 1)[:, 0] + self.bias
        np.maximum(top, 0, out=top)
        last = np.zeros(len(top), bool)
        last[at[1:] - 1] = True
        use_next = np.zeros(top.shape, bool)
        use_next[:-1] = (top[1:] > top[:-1]) & ~last[:-1, None]
        chunk = top.copy()
        chunk[:-1][use_next[:-1]] = top[1:][use_next[:-1]]
        n = np.diff(at).astype(np.float32)
        mean = np.add.reduceat(chunk, at[:-1], 0) / n[:, None]
        high, low = np.maximum.reduceat(chunk, at[:-1], 0), np.minimum.reduceat(chunk, at[:-1], 0)
        x = np.concatenate([mean, high, low, np.log1p(lens)[:, None].astype(np.float32) / 10], 1)
        return x, {"arg": arg, "top": top, "use_next": use_next, "chunk": chunk, "n": n}

    def score(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.zeros(len(off) - 1)
        for a, b in runs(off, RUN):
            x = self._long(raw[off[a] : off[b]]) if b == a + 1 and off[b] - off[a] > 2 * RUN else self.features(*lay_out(raw[off[a] : off[b]], off[a : b + 1] - off[a]), np.diff(off[a : b + 1]))[0]
            out[a:b] = 1 / (1 + np.exp(-np.clip(x @ self.head + self.intercept, -30, 30).astype(np.float64)))
        return out

    def _long(self, raw: np.ndarray) -> np.ndarray:
        """The features of one very long text, part by part; parts share a hop, so that every chunk is seen."""
        total, count, high, low = 0.0, 0, None, None
        for a in range(0, len(raw), RUN):
            ends = a + RUN >= len(raw)
            part = raw[a : a + RUN + (0 if ends else HOP + WIDTH)]
            flat, at = lay_out(part, np.array([0, len(part)]))
            chunk = self.features(flat, at, np.array([len(part)]))[1]["chunk"]
            chunk = chunk if ends else chunk[: RUN // HOP]
            total, count = total + chunk.sum(0, dtype=np.float64), count + len(chunk)
            high = chunk.max(0) if high is None else np.maximum(high, chunk.max(0))
            low = chunk.min(0) if low is None else np.minimum(low, chunk.min(0))
        return np.concatenate([total / count, high, low, [np.log1p(len(raw)) / 10]]).astype(np.float32)[None]

    def step(self, raw: np.ndarray, off: np.ndarray, y: np.ndarray, rate: float, turn: int) -> None:
        """One Adam step on a batch of texts."""
        flat, at = lay_out(raw, off)
        x, kept = self.features(flat, at, np.diff(off))
        p = 1 / (1 + np.exp(-np.clip(x @ self.head + self.intercept, -30, 30)))
        d = (p - y).astype(np.float32) / len(y)
        grads = {"head": x.T @ d, "intercept": float(d.sum())}
        dx = d[:, None] * self.head
        text = np.repeat(np.arange(len(y)), np.diff(at))
        chunk = kept["chunk"]
        g = (dx[:, :FILTERS] / kept["n"][:, None])[text]
        high, low = x[:, FILTERS : 2 * FILTERS][text], x[:, 2 * FILTERS : 3 * FILTERS][text]
        for extreme, part in ((high, dx[:, FILTERS : 2 * FILTERS]), (low, dx[:, 2 * FILTERS : 3 * FILTERS])):
            same = chunk == extreme
            ties = np.add.reduceat(same.astype(np.float32), at[:-1], 0)
            g = g + same * (part / np.maximum(ties, 1))[text]
        dtop = np.where(kept["use_next"], 0, g)
        dtop[1:] += np.where(kept["use_next"][:-1], g[:-1], 0)
        dtop = np.where(kept["top"] > 0, dtop, 0)
        grads["bias"] = dtop.sum(0)
        place = (np.arange(len(dtop))[:, None] * PER_HOP + kept["arg"]) * STRIDE
        gf, ge = np.zeros_like(self.filters), np.zeros_like(self.embed)
        for f in range(FILTERS):
            hot = np.flatnonzero(dtop[:, f])
            if not len(hot):
                continue
            codes = flat[place[hot, f][:, None] + np.arange(WIDTH)]
            gf[:, f] = dtop[hot, f] @ self.embed[codes].reshape(len(hot), -1)
            weight = self.filters[:, f].reshape(WIDTH, EMBED)
            for j in range(WIDTH):
                share = np.bincount(codes[:, j], dtop[hot, f], 256).astype(np.float32)
                ge += share[:, None] * weight[j]
        grads |= {"filters": gf, "embed": ge}
        for name, grad in grads.items():
            m, v = self.moments.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * np.square(grad)
            self.moments[name] = m, v
            setattr(self, name, getattr(self, name) - rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-7))


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, batch: int = 24, seed: int = 5) -> Network:
    """Fit a network to texts and their 0/1 labels; without both classes it answers with the smoothed share of ones."""
    net, y = Network.fresh(seed), np.array(labels, np.float32)
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    net.intercept = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return net
    raw, off, _ = text_bytes(pa.array(texts, pa.string()))
    rng, turn = np.random.default_rng(seed), 0
    steps = max(epochs * -(-len(y) // batch), 300)  # a small sample is gone through more often
    order = np.zeros(0, np.int64)
    while turn < steps:
        if len(order) < batch:
            order = np.append(order, rng.permutation(len(y)))
        own, order = order[:batch], order[batch:]
        sizes = off[own + 1] - off[own]
        turn += 1
        net.step(np.concatenate([raw[off[i] : off[i + 1]] for i in own]), np.append(0, np.cumsum(sizes)), y[own], 0.01 * (1 - turn / (steps + 1)) + 2e-4, turn)
    net.moments = {}
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, seed: int = 5) -> Network:
    """Train on about `sample` labelled rows of each class, drawn from labels (doc_id, label) before any text is read."""
    prepare(docs.sparkSession)
    rows = labelled_sample(docs, labels.where(F.col(label).isin(0, 1)), label, sample).orderBy("doc_id", label).toPandas()  # bounded in rows and bytes
    return train([t if isinstance(t, str) else None for t in rows["text"]], rows[label].astype(int).tolist(), seed=seed)


def score(docs: DataFrame, net: Network, keep: tuple[str, ...] = ("doc_id",), text: str = "text", cut: float = 0.5) -> DataFrame:
    """keep, score (0 to 1) and predicted (1 if score >= cut) of every row."""
    prepare(docs.sparkSession)
    keep = tuple(c for c in keep if c not in ("score", "predicted", "_text"))
    rows = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off, _ = text_bytes(batch.column(batch.num_columns - 1))
            p = net.score(raw, off)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= cut).astype(np.int32))], names=[*keep, "score", "predicted"])

    schema = rows.drop("_text").withColumn("score", F.lit(None).cast("double")).withColumn("predicted", F.lit(None).cast("int")).schema
    return rows.mapInArrow(run, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels").where(~in_fold(3, 1)))
    return score(docs.withColumn("held_out", in_fold(3, 1)), net, ("doc_id", "held_out"))
