"""Nearest neighbours by inner product with a vantage-point tree per shard.

Vectors are dealt to shards of bounded size. A shard's tree lies over the directions of its vectors, by their distance as
points of the unit sphere, after a first split by length: x is d = x / |x| and log2 |x|, both exact enough for any finite
components. At a node, the triangle inequality bounds from below how far a query's direction is from those of the subtree,
so from above the cosine, and with the subtree's lengths the inner product; a subtree whose bound is under the query's k-th
best product is left out. The distance's lower bound counts `factor` times: factor 1 restores exact search, a larger one
prunes more. Leaves are narrowed by approximate products with a margin for rounding; what may be among the k best is computed
on the original vectors, in double precision and in order of the components, and ranked by that.

A shard builds its tree once. Rows come sorted by shard, vectors before queries, and queries stream through the tree in
batches, so that a candidate is sent once, whatever the number of queries; a query goes to every shard. Equal vectors of a
shard are one node, and equal queries of a batch search once, so that copies cost no search.

Defined results: vectors that are null, zero, of another length than the commonest, or hold null or non-finite components
take no part as query or candidate; a query with fewer candidates than k gets all; ties go to the smaller vec_id; rows that
repeat a vec_id each count as candidates of other ids, and ask together under their id; a null vec_id takes no part; no usable
vectors give no rows. A product that overflows is infinite or NaN, which ranks first, as SQL sorts it. Columns other than
vec_id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import key_runs, prepare, table

#: Candidates of a shard and queries searched together, about; vectors of a leaf; how much pruning is relaxed.
SHARD, QUERIES, LEAF, FACTOR = 16_384, 2_048, 256, 1.0
K = 20
#: Relative error that products of directions, lengths and their powers stay under; lengths of a split by length, as log2.
ROUNDING, SPREAD = 1e-11, 2.0
_TINY = 1e-290


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the rows of x and log2 of their lengths, for any finite rows that are not zero."""
    _, e = np.frexp(np.abs(x).max(1))
    y = np.ldexp(x, -e[:, None])
    n = np.sqrt(np.einsum("ij,ij->i", y, y))
    return y / n[:, None], np.log2(n) + e


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added up in the order of the components."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        return np.add.accumulate(a * b, axis=1)[:, -1]


def _length(log: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", under="ignore"):
        return np.exp2(log)


class Tree:
    """A vantage-point tree over directions, in arrays: node, its centre, the span of distances of each child, its lengths."""

    def __init__(self, x: np.ndarray, first: np.ndarray, leaf: int = LEAF, seed: int = 1):
        self.x, self.first, rng = x, first, np.random.default_rng(seed)
        d, log = directions(x)
        order = np.arange(len(x))
        self.nodes: list[dict] = []
        stack = [(0, len(x), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own = order[a:b]
            node = {"a": a, "b": b, "low": log[own].min(), "high": log[own].max(), "children": None, "centre": None}
            if parent >= 0:
                self.nodes[parent]["children"][side] = len(self.nodes)
            if b - a > leaf:
                mid = (b - a) // 2
                if node["high"] - node["low"] > SPREAD:
                    by = np.argsort(log[own], kind="stable")
                    mid = min(max(int(np.searchsorted(log[own][by], (node["low"] + node["high"]) / 2)), 1), b - a - 1)
                else:
                    some = d[own[rng.integers(0, b - a, 16)]]
                    few = d[own[:: max(1, (b - a) // 512)]]
                    centre = some[int(np.argmax([np.var(few @ v) for v in some]))]
                    away = np.linalg.norm(d[own] - centre, axis=1)
                    by = np.argsort(away, kind="stable")
                    away = away[by]
                    node |= {"centre": centre, "spans": ((away[0], away[mid - 1]), (away[mid], away[-1]))}
                order[a:b] = own[by]
                node["children"] = [-1, -1]
                stack += [(a, a + mid, len(self.nodes), 0), (a + mid, b, len(self.nodes), 1)]
            self.nodes.append(node)
        self.order, self.d, self.log = order, d[order], log[order]

    def search(self, q: np.ndarray, k: int, factor: float = FACTOR, barred: np.ndarray | None = None, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the k rows of x with the largest products, ties to the smaller `first`, and their products.

        Row -1 stands for none. barred: an id for each query; rows whose `only` is that id are not found."""
        n = len(q)
        d, log = directions(q)
        best, score = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)

        def least(on: np.ndarray) -> np.ndarray:
            return np.where(best[on, k - 1] < 0, -np.inf, np.where(np.isnan(score[on, k - 1]), np.inf, score[on, k - 1]))

        def scan(node: dict, on: np.ndarray) -> None:
            a, b = node["a"], node["b"]
            rows = self.order[a:b]
            with np.errstate(over="ignore", invalid="ignore", under="ignore"):
                size = _length(log[on][:, None] + self.log[None, a:b])
                about = (d[on] @ self.d[a:b].T) * size
                slack = ROUNDING * size + _TINY
                over = np.isinf(size) | np.isnan(about)
                upper, lower = np.where(over, np.inf, about + slack), np.where(over, -np.inf, about - slack)
            if barred is not None:
                out = only[rows][None] == barred[on][:, None]
                upper[out], lower[out] = -np.inf, -np.inf
            if b - a > k:
                floor = np.partition(lower, b - a - k, 1)[:, b - a - k]
            else:
                floor = np.full(len(on), -np.inf)
            i, j = np.nonzero((upper >= np.maximum(floor, least(on))[:, None]) & (upper > -np.inf))
            if not len(i):
                return
            exact = np.concatenate([_dot(q[on[i[s : s + 65_536]]], self.x[rows[j[s : s + 65_536]]]) for s in range(0, len(i), 65_536)])
            hit = np.unique(i)
            have = np.nonzero(best[on[hit]] >= 0)
            at = np.concatenate([i, hit[have[0]]])
            row = np.concatenate([rows[j], best[on[hit]][have]])
            value = np.concatenate([exact, score[on[hit]][have]])
            by = np.lexsort((self.first[row], -value, ~np.isnan(value), at))
            at, row, value = at[by], row[by], value[by]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            keep = place < k
            at, row, value, place = on[at[keep]], row[keep], value[keep], place[keep]
            best[at, place], score[at, place] = row, value

        def bound(child: dict, on: np.ndarray, away: np.ndarray) -> np.ndarray:
            """The largest product that a query can have with the child's rows, given how far off their directions are."""
            cos = 1 - np.square(factor * np.maximum(away - ROUNDING, 0)) / 2
            with np.errstate(over="ignore", invalid="ignore", under="ignore"):
                size = _length(log[on] + np.where(cos >= 0, child["high"], child["low"]))
                out = cos * size + ROUNDING * _length(log[on] + child["high"]) + _TINY
            return np.where(np.isinf(_length(log[on] + child["high"])), np.inf, out)

        # first each query's own leaf, then the rest, the likelier child first
        seen = np.full(n, -1)
        todo = [(0, np.arange(n))]
        while todo:
            at, on = todo.pop()
            node = self.nodes[at]
            if node["children"] is None:
                scan(node, on)
                seen[on] = at
            elif node["centre"] is None:
                todo.append((node["children"][1], on))
            else:
                away = np.linalg.norm(d[on] - node["centre"], axis=1)
                far = away > (node["spans"][0][1] + node["spans"][1][0]) / 2
                todo += [(node["children"][side], own) for side, own in ((0, on[~far]), (1, on[far])) if len(own)]
        todo = [(0, np.arange(n), np.zeros(n))]
        while todo:
            at, on, away = todo.pop()
            node = self.nodes[at]
            go = bound(node, on, away) >= least(on)
            on, away = on[go], away[go]
            if not len(on):
                continue
            if node["children"] is None:
                on = on[seen[on] != at]
                if len(on):
                    scan(node, on)
                continue
            if node["centre"] is None:
                todo += [(node["children"][side], on, away) for side in (0, 1)]
                continue
            to = np.linalg.norm(d[on] - node["centre"], axis=1)
            aways = [np.maximum(away, np.maximum(lo - to, to - hi)) for lo, hi in node["spans"]]
            sides = np.argsort([np.mean(x) for x in aways])[::-1]
            todo += [(node["children"][side], on, aways[side]) for side in sides]
        return best, score


class Shard:
    """A shard's candidates: their distinct vectors as a tree, and the ids of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        x = x + 0.0  # no negative zeros
        flat = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
        _, first, group = np.unique(flat, return_index=True, return_inverse=True)
        by = np.lexsort((ids, group.ravel()))
        self.ids, group = ids[by], group.ravel()[by]
        self.starts = np.searchsorted(group, np.arange(len(first) + 1))
        low, high = self.ids[self.starts[:-1]], self.ids[self.starts[1:] - 1]
        self.only = np.where(low == high, low, -1)  # the one id that a vector has
        self.alone = low == high
        self.tree = Tree(x[first], low)
        per = np.unique(np.stack([self.ids, group], 1), axis=0)[:, 0]
        some, count = np.unique(per, return_counts=True)
        self.spread = some[count > 1]  # ids with several vectors

    def nearest(self, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query_id, vec_id and score of the k nearest for each query row."""
        # an id with one vector here bars one node at most: k + 1 nodes hold what it may get, whoever asks
        strange = np.isin(query_ids, self.spread)
        key = np.concatenate([np.where(strange, query_ids, 0)[:, None].astype(np.int64).view(np.float64), strange[:, None].astype(float), q + 0.0], 1)
        flat = np.ascontiguousarray(key).view(np.dtype((np.void, key.shape[1] * 8))).ravel()
        _, first, unit = np.unique(flat, return_index=True, return_inverse=True)
        found = np.full((len(first), k + 1), -1, np.int64)
        score = np.full((len(first), k + 1), -np.inf)
        for odd in (False, True):
            own = np.flatnonzero(strange[first] == odd)
            if len(own):
                barred = query_ids[first[own]] if odd else None
                found[own], score[own] = self.tree.search(q[first[own]], k + 1, factor, barred, np.where(self.alone, self.only, np.iinfo(np.int64).min) if odd else None)
        out: tuple[list, list, list] = ([], [], [])
        for i, u in zip(query_ids.tolist(), unit.ravel().tolist(), strict=True):
            rows: list[tuple[tuple[bool, float], int, float]] = []
            for g, s in zip(found[u].tolist(), score[u].tolist(), strict=True):
                if g < 0 or len(rows) >= k and _before(rows[k - 1][2], s):
                    break
                own = self.ids[self.starts[g] : self.starts[g + 1]]
                if own[0] <= i <= own[-1]:
                    lo, hi = np.searchsorted(own, [i, i + 1])
                    own = np.concatenate([own[:lo][:k], own[hi : hi + k]])
                rows += [((True, -s) if s == s else (False, 0.0), v, s) for v in own[:k].tolist()]
                rows.sort(key=lambda r: r[:2])
                del rows[k:]
            out[0].extend([i] * len(rows))
            out[1].extend(r[1] for r in rows)
            out[2].extend(r[2] for r in rows)
        return np.array(out[0], np.int64), np.array(out[1], np.int64), np.array(out[2], np.float64)


def _before(a: float, b: float) -> bool:
    """Whether a score ranks before another."""
    return (b == b) and (a != a or a > b)


def search_shard(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score) of the k nearest of one shard for each query."""
    if not len(ids) or not len(query_ids):
        return []
    return list(zip(*(c.tolist() for c in Shard(ids, x).nearest(query_ids, q, k, factor)), strict=True))


def nearest(vectors: DataFrame, k: int = K, one_in: int = 20, factor: float = FACTOR, shard: int = SHARD, block: int = QUERIES, vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `one_in` its k nearest other rows."""
    prepare(vectors.sparkSession)
    values = F.col(vec).cast("array<double>")
    fine = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(values, lambda v: v != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col(vec).isNotNull() & fine.eqNullSafe(F.lit(True))).select(F.col("vec_id").cast("bigint").alias("vec_id"), values.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("v") == sizes["d"])
    shards = max(1, -(-sizes["count"] // shard))
    # vectors are dealt by id and content, so that a vec_id or a vector that a third of the rows share is spread as well
    deal = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards))
    held = rows.select(deal.alias("s"), F.lit(0).cast("bigint").alias("asks"), "vec_id", "v")
    asks = rows.where(F.col("vec_id") % one_in == 0).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("s"), F.lit(1).cast("bigint").alias("asks"), "vec_id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        x: list[np.ndarray] = []
        own: Shard | None = None

        def asked(to: Shard) -> pa.RecordBatch:
            found = to.nearest(np.concatenate(ids), np.concatenate(x), k, factor)
            ids.clear()
            x.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

        for (_, ask), new, rows in key_runs(batches, 2):
            if new:
                if ask and ids:
                    own = Shard(np.concatenate(ids), np.concatenate(x))
                elif not ask and ids and own:
                    yield asked(own)
                if not ask:
                    own = None
                if ask or own is None:
                    ids.clear()
                    x.clear()
            if ask and own is None:  # queries of a shard without vectors
                continue
            ids.append(np.asarray(rows.column(2)))
            x.append(np.asarray(rows.column(3).flatten()).reshape(rows.num_rows, -1))
            if ask and sum(map(len, ids)) >= block:
                yield asked(own)
        if own and ids:
            yield asked(own)

    dealt = held.unionByName(asks).repartition("s").sortWithinPartitions("s", "asks")
    found = dealt.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OP4_SQL = """
with ok as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v) as score
  from ok q, ok c where q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20
"""


def op4(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
