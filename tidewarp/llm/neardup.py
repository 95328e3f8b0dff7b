"""Near-duplicate detection with SetSketch registers.

A document's set is its distinct shingles, of four words and for a threshold of 0.8 unless told otherwise. Each register keeps
the smallest of an exponential variate per shingle, exponentially spaced (base B) and truncated, so sketches of parts merge by
maximum and equal registers are likelier the more alike two sets are. Documents of one and the same set are one class; classes
have numbers of their own, and doc_ids come back at the end only. Bands of registers bring classes together; a pair's
similarity is estimated jointly from the counts of larger, smaller and equal registers by maximum likelihood, and pairs that
may reach the threshold are confirmed on their full sets.

No group is expanded into its pairs. Round one tests each class against the smallest of its buckets, round two each member
outside its bucket's largest component against one member of that component, drawn by hash; a bucket whose members all belong
to one component is done. What is left is searched exhaustively in blocks of bounded size: every member outside the bucket's
largest component meets every member of another component, once, in the first band that the two share. Sketches go first,
and say which members have a likely partner in the block; those get their sets, are confirmed inside the block, and only
links come out.

Sets, not texts, are compared: a class that shares a bucket gets its set as hashes once, and streams past the set that it is
tested against; that one is sent once for every `SPLIT` of its members.

Defined results: a null or wordless text has an empty set, is linked with nothing and keeps itself; so does a row with a
null doc_id, whose component is null. Rows that repeat a doc_id are one document: their sets are linked, whatever they hold,
and n_shingles is each row's own. Ties: the smallest doc_id. Columns other than doc_id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..tables import freed
from .common import U64, carried, key_runs, mix, prepare, runs, table, text_bytes, word_table, words, written

SHINGLE, SIMILAR = 4, 80
#: Registers, base of their spacing, rate of the exponential variates, largest register.
M, B, RATE, Q = 200, 1.001, 20.0, 65534
BANDS, ROWS = 40, 5
#: How far under the threshold an estimate may lie and still be confirmed: over four standard errors.
MARGIN = 0.12
#: Members of a block of a bucket, and shingles of all of them together, about; members that one copy of a set is sent for.
BLOCK, BLOCK_SHINGLES, SPLIT = 1024, 1 << 20, 1024
#: Rows of a few numbers each that may be broadcast; more are joined by shuffling.
FEW = 500_000
RUN = 1 << 20

_rng = np.random.default_rng(20240611)
_A = _rng.integers(1, 2**63, M, dtype=np.uint64) * U64(2) + U64(1)
_S = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * U64(2) + U64(1)
_BAND = _rng.integers(1, 2**63, (BANDS, ROWS + 1), dtype=np.uint64) * U64(2) + U64(1)


def _factors(width: int) -> np.ndarray:
    return _S if width == SHINGLE else np.random.default_rng(width).integers(1, 2**63, width, dtype=np.uint64) * U64(2) + U64(1)


def shingles(raw: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of so many words of every text, ascending in each, and n+1 offsets."""
    factors = _factors(width)
    h, at = words(raw, off, word_table("plain"))
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    x = np.zeros(len(h) + width, U64)
    padded = np.append(h, np.zeros(width, U64))
    for j in range(width):
        x[: len(h)] += padded[j : j + len(h)] * factors[j]
    out = []
    for k in range(len(n)):
        if n[k] >= width:
            s = mix(x[at[k] : at[k] + count[k]])
            s.sort()
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif n[k]:
            own = h[at[k] : at[k + 1]]
            out.append(mix(np.array([(own * factors[: len(own)]).sum() + U64(len(own))], U64)))
        else:
            out.append(np.zeros(0, U64))
    sizes = np.array([len(s) for s in out], np.int64)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.append(0, np.cumsum(sizes))


def sketch(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The registers of every set, uint16; those of an empty set are 0."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, M), np.uint16)
    if not len(full):
        return out
    low, v = np.empty((len(full), M), U64), np.empty_like(s)
    for i in range(M):
        np.multiply(s, _A[i], out=v)
        low[:, i] = np.minimum.reduceat(v, at[:-1][full])
    u = (low.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2**-53)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1)
    return out


def bands(k: np.ndarray) -> np.ndarray:
    """A 64-bit bucket of every band of every sketch."""
    k = k[:, : BANDS * ROWS].reshape(len(k), BANDS, ROWS).astype(U64)
    return mix((k * _BAND[:, :ROWS]).sum(2, dtype=U64) + _BAND[:, ROWS]).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches by joint maximum likelihood, given the sets' sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    j = np.minimum(u / v, v / u)[:, None] * np.linspace(0, 1, 257)[None]
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (B - 1) / B) / np.log(B)
    p_more, p_less = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    fit = more[:, None] * np.log(p_more) + less[:, None] * np.log(p_less) + same[:, None] * np.log(np.maximum(1 - p_more - p_less, 1e-12))
    return j[np.arange(len(j)), fit.argmax(1)]


def _keys(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits of every set, as two whole numbers; zeros for an empty one."""
    sums = np.zeros((len(at) - 1, 2), U64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        sums[full, 0] = np.add.reduceat(mix(s), at[:-1][full])
        sums[full, 1] = np.add.reduceat(mix(s ^ _A[0]), at[:-1][full])
    return sums.view(np.int64)


def _signed(docs: DataFrame, text: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, the set's key (k1, k2) and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off, _ = text_bytes(batch.column(1))
            n, keys, sketches = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)], []
            for a, b in runs(off, RUN):
                s, at = shingles(raw[off[a] : off[b]], off[a : b + 1] - off[a], width)
                n.append(np.diff(at))
                keys.append(_keys(s, at))
                sketches += [row.tobytes() for row in sketch(s, at)]
            k = np.concatenate(keys)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n)), pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "k1", "k2", "sketch"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text)).mapInArrow(run, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, sketch binary")


def _with_sets(rows: DataFrame, width: int) -> DataFrame:
    """rows (rep, k1, k2, text, …) whose text has the set of their key: the other columns, and the set as ascending hashes."""
    kept = [c for c in rows.columns if c not in ("rep", "k1", "k2", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off, _ = text_bytes(batch.column(3))
            k1, k2 = np.asarray(batch.column(1)), np.asarray(batch.column(2))
            good, sets = [], []
            for a, b in runs(off, RUN):
                s, at = shingles(raw[off[a] : off[b]], off[a : b + 1] - off[a], width)
                key = _keys(s, at)
                for i in np.flatnonzero((key[:, 0] == k1[a:b]) & (key[:, 1] == k2[a:b])).tolist():
                    good.append(a + i)
                    sets.append(s[at[i] : at[i + 1]].tobytes())
            own = batch.take(pa.array(good, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), *own.columns[4:], pa.array(sets, pa.binary())], names=["rep", *kept, "set"])

    rows = rows.select("rep", "k1", "k2", "text", *kept)
    return rows.mapInArrow(run, rows.drop("k1", "k2", "text").withColumn("set", F.lit(None).cast("binary")).schema)


def _registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, M)


def _few(rows: DataFrame) -> DataFrame:
    """rows, of a few numbers each, marked for broadcast if they are not more than `FEW`."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def _buckets(reps: DataFrame) -> DataFrame:
    """bucket, rep for every band of every sketch; the band is in the bucket's last six bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(BANDS)
        for batch in batches:
            if batch.num_rows:
                own = (bands(_registers(batch.column(1))) & ~np.int64(63)) | band
                yield pa.RecordBatch.from_arrays([pa.array(own.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), BANDS))], names=["bucket", "rep"])

    return reps.select("rep", "sketch").mapInArrow(run, "bucket bigint, rep bigint")


def _salted(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the share of a's members, of about `SPLIT`, that b is in."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPLIT).alias("n"))
    return pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("n")).cast("bigint").alias("salt"), "b")


def _verified(members: DataFrame, full: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(a, b, linked) for members (a, salt, rep, n_shingles, sketch, set): estimated by sketch, then confirmed on the sets.

    A share of a's members and a's own row, which is sorted before them, come to one task and stream through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple | None = None
        for (a, _), new, rows in key_runs(batches, 2):
            if new:
                head = None
            is_member = np.asarray(rows.column(2)) == 1
            k, n = _registers(rows.column(5)), np.asarray(rows.column(4)).astype(float)
            if head is None:
                if is_member[0]:
                    raise ValueError("a share of members came without its head")
                head = k[:1], n[:1], np.frombuffer(rows.column(6)[0].as_py(), U64)
            on = np.flatnonzero(is_member)
            if not len(on):
                continue
            linked = np.zeros(len(on), bool)
            about = estimate(np.repeat(head[0], len(on), 0), k[on], np.repeat(head[1], len(on)), n[on])
            for i in np.flatnonzero(about >= similar / 100 - MARGIN).tolist():
                linked[i] = _similar(head[2], np.frombuffer(rows.column(6)[int(on[i])].as_py(), U64), similar)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), a)), rows.column(3).take(pa.array(on)), pa.array(linked)], names=["a", "b", "linked"])

    own = ["n_shingles", "sketch", "set"]
    asked = _few(written(members.select("a", "salt").distinct(), "heads"))
    heads = asked.join(full.withColumnRenamed("rep", "a"), "a").select("a", "salt", F.lit(0).cast("bigint").alias("member"), F.col("a").alias("rep"), *own)
    rows = heads.unionByName(members.select("a", "salt", F.lit(1).cast("bigint").alias("member"), "rep", *own))
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "member").mapInArrow(run, "a bigint, b bigint, linked boolean")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (rep, comp) after the links (a, b): components take their smallest label."""
    while True:
        la, lb = labels.toDF("a", "ca"), labels.toDF("b", "cb")
        across = links.join(la, "a").join(lb, "b").where("ca <> cb").groupBy(F.greatest("ca", "cb").alias("hi")).agg(F.min(F.least("ca", "cb")).alias("to"))
        hooks = found = written(across, "hooks")
        if hooks.isEmpty():
            return labels
        while True:  # a hook's target may hook on: point to the end
            ahead = hooks.select(F.col("hi").alias("to"), F.col("to").alias("end"))
            before, found = found, written(hooks.join(ahead, "to", "left").select("hi", F.coalesce("end", "to").alias("to"), F.col("end").isNotNull().alias("moved")), "hooks")
            freed(before)
            hooks = found.select("hi", "to")
            if found.where("moved").isEmpty():
                break
        before, labels = labels, written(labels.join(hooks, labels["comp"] == hooks["hi"], "left").select("rep", F.coalesce("to", "comp").alias("comp")), "labels")
        freed(before, found)


def _crowded(members: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, rep, comp and main, the largest component, of the buckets with more than one component."""
    m = members.join(_few(labels), "rep")
    sizes = m.groupBy("bucket", "comp").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("comps"), F.max(F.struct("n", (-F.col("comp")).alias("c")))["c"].alias("c"))
    return m.join(sizes.where("comps > 1").select("bucket", (-F.col("c")).alias("main")), "bucket")


def _rest(crowded: DataFrame, full: DataFrame, similar: int = SIMILAR, sets: bool = True) -> DataFrame:
    """Links (a, b) between components of a bucket, one for each member outside the main component and component it meets.

    Without sets: the (bucket, rep) that have a likely partner of another component, by their sketches."""
    own = ["n_shingles", "sketch", *(["set"] if sets else [])]
    rows = crowded.withColumn("minor", F.col("comp") != F.col("main")).join(full.select("rep", *own), "rep")
    parts = lambda n, shingles: F.ceil(F.greatest(n / BLOCK, shingles / BLOCK_SHINGLES)).cast("int")
    mine = F.col("minor").cast("int")
    light = crowded.withColumn("minor", F.col("comp") != F.col("main")).join(full.select("rep", "n_shingles"), "rep")
    sizes = light.groupBy("bucket").agg(parts(F.count("*"), F.sum("n_shingles")).alias("xs"), parts(F.sum(mine), F.sum(mine * F.col("n_shingles"))).alias("ys"))
    rows = rows.join(_few(written(sizes, "sizes")), "bucket")
    place = lambda n, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), n).cast("int")
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # every member is in one row of blocks and every asking one in one column: a row for each block that it is in, sent once
    # to the block where it is both
    x, y, minor = place(F.col("xs"), 3), place(F.col("ys"), 5), F.col("minor")
    cells = F.concat(
        F.transform(spread("ys"), lambda v: F.struct(x.alias("x"), v.alias("y"), F.lit(True).alias("has"), (minor & (v == y)).alias("asks"))),
        F.when(minor, F.transform(F.filter(spread("xs"), lambda v: v != x), lambda v: F.struct(v.alias("x"), y.alias("y"), F.lit(False).alias("has"), F.lit(True).alias("asks")))).otherwise(F.array().cast("array<struct<x:int,y:int,has:boolean,asks:boolean>>")),
    )
    rows = rows.select("bucket", "rep", "comp", *own, F.explode(cells).alias("c")).select("bucket", "rep", "comp", *own, "c.*")

    def search(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        ask, has = (np.flatnonzero(np.asarray(group.column(c))) for c in ("asks", "has"))
        rep, comp, n, k = np.asarray(group.column("rep")), np.asarray(group.column("comp")), np.asarray(group.column("n_shingles")).astype(float), _registers(group.column("sketch"))
        buckets, own = bands(k) & ~np.int64(63), group.column("set") if sets else None
        set_of = lambda i: np.frombuffer(own[int(i)].as_py(), U64)
        found, likely = set(), np.zeros(len(rep), bool)
        for i in ask.tolist():
            other = has[comp[has] != comp[i]]
            other = other[(buckets[other] == buckets[i]).argmax(1) == bucket & 63]
            other = other[(k[other] == k[i]).sum(1) >= M * (similar / 100 - 2 * MARGIN)]
            if not len(other):
                continue
            e = estimate(np.repeat(k[i][None], len(other), 0), k[other], np.full(len(other), n[i]), n[other])
            other, e = other[e >= similar / 100 - MARGIN], e[e >= similar / 100 - MARGIN]
            if not sets:
                likely[other] = True
                likely[i] |= len(other) > 0
                continue
            done = set()
            for o in other[np.argsort(-e, kind="stable")].tolist():
                if comp[o] not in done and _similar(set_of(i), set_of(o), similar):
                    done.add(comp[o])
                    found.add((min(rep[i], rep[o]), max(rep[i], rep[o])))
        if not sets:
            return pa.table({"bucket": pa.array(np.full(int(likely.sum()), bucket)), "rep": pa.array(rep[likely])})
        pairs = sorted(found)
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return rows.groupBy("bucket", "x", "y").applyInArrow(search, "a bigint, b bigint" if sets else "bucket bigint, rep bigint").distinct()


def _similar(a: np.ndarray, b: np.ndarray, similar: int = SIMILAR) -> bool:
    """Whether two sets, as ascending hashes, reach the threshold."""
    if 100 * min(len(a), len(b)) < similar * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return both > 0 and 100 * both >= similar * (len(a) + len(b) - both)


def _linked(docs: DataFrame, text: str, width: int, similar: int) -> tuple[DataFrame, DataFrame]:
    """Two written tables: the signed rows, and (k1, k2, first: a doc_id, comp) of every class of sets."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    signed = written(_signed(docs, width=width), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    # doc_ids of several rows, whose sets are linked through them
    repeats = full.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("k1").alias("a1"), F.max("k1").alias("b1"), F.min("k2").alias("a2"), F.max("k2").alias("b2")).where("n > 1")
    repeats = written(repeats.select("doc_id", ((F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))).alias("several")), "repeats")
    by_id = None
    if not repeats.where("several").isEmpty():
        of = full.join(repeats.where("several"), "doc_id").select("doc_id", "k1", "k2").distinct().join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", "rep")
        by_id = written(of.join(of.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct(), "by-id")

    buckets = _buckets(classes)
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("first"), F.max("rep").alias("last")).where("first <> last").select("bucket", "first")
    members = written(buckets.join(shared, "bucket"), "members")  # bucket, rep, first
    # round one: the smallest member of all its buckets
    centre = written(members.groupBy("rep").agg(F.min(F.when(F.col("first") != F.col("rep"), F.col("first"))).alias("a")), "centres")
    salted = _salted(centre.where("a is not null").select("a", F.col("rep").alias("b"))).withColumnRenamed("b", "rep")
    wanted = written(classes.join(_few(centre.select("rep")), "rep").join(salted, "rep", "left").withColumnRenamed("first", "doc_id"), "wanted")
    texts = docs.join(_few(wanted.select("doc_id").distinct()), "doc_id", "left_semi")
    sets = _with_sets(texts.join(wanted, "doc_id").drop("doc_id"), width)
    sets = written(sets if repeats.isEmpty() else sets.dropDuplicates(["rep"]), "sets")  # rep, n_shingles, sketch, a, salt, set
    labels = centre.select("rep")
    if by_id is not None:
        labels = labels.unionByName(by_id.select(F.col("a").alias("rep"))).unionByName(by_id.select(F.col("b").alias("rep"))).distinct()
    labels = written(labels.select("rep", F.col("rep").alias("comp")), "labels")
    tested = written(_verified(sets.where("a is not null"), sets.drop("a", "salt"), similar), "tested")
    links = tested.where("linked").select("a", "b")
    labels = _merged(labels, links if by_id is None else links.unionByName(by_id))
    sets_of, members_of = sets, members
    sets, members = sets.drop("a", "salt"), members.select("bucket", "rep")
    # round two: one member of the largest component of each bucket that is still open
    crowded = written(_crowded(members, labels), "crowded")
    if not crowded.isEmpty():
        drawn = crowded.where("comp = main").groupBy("bucket").agg(F.min(F.struct(F.xxhash64("rep", "bucket").alias("h"), "rep"))["rep"].alias("one"))
        pairs = crowded.where("comp <> main").join(drawn, "bucket").select(F.least("one", "rep").alias("a"), F.greatest("one", "rep").alias("b")).distinct()
        pairs = _salted(pairs.join(tested, ["a", "b"], "left_anti")).withColumnRenamed("b", "rep")
        links = written(_verified(_few(written(pairs, "pairs")).join(sets, "rep"), sets, similar).where("linked").select("a", "b"), "links")
        labels = _merged(labels, links)
        freed(links)
        # the rest, exhaustively
        left = written(_crowded(members, labels), "crowded")
        likely = written(_rest(left, sets, similar, False), "likely")
        if not likely.isEmpty():
            links = written(_rest(left.join(likely, ["bucket", "rep"], "left_semi"), sets, similar), "links")
            labels = _merged(labels, links)
            freed(links)
        freed(left, likely)
    freed(crowded, tested, members_of, sets_of, centre, wanted, repeats, *([] if by_id is None else [by_id]))
    by_class = written(classes.select("k1", "k2", "first", "rep").join(labels, "rep", "left").select("k1", "k2", "first", F.coalesce("comp", "rep").alias("comp")), "by-class")
    freed(classes, labels)
    return signed, by_class


def components(docs: DataFrame, text: str = "text", width: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row, for shingles of `width` words and a threshold in percent."""
    return _judged(*_linked(docs, text, width, similar))


def _judged(signed: DataFrame, by_class: DataFrame) -> DataFrame:
    least = by_class.groupBy("comp").agg(F.min("first").alias("component"))
    by_class = by_class.join(least, "comp").select("k1", "k2", "component")
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("k1")).alias("k1"), "k2").join(by_class, ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = SHINGLE, similar: int = SIMILAR, text: str = "text") -> DataFrame:
    """The documents that stay, one row of each component, with the columns they came with.

    Of rows that repeat the doc_id that stays, the one of the smallest text, and then the smallest as JSON, is taken; rows
    without words or doc_id all stay."""
    tables = _linked(docs, text, width, similar)
    found = written(_judged(*tables), "components")
    freed(*tables)
    gone = written(found.where("not kept").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    twice = written(found.where("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "twice")
    freed(found)
    stay = carried(docs, F.col("doc_id").cast("bigint").alias("_id")).join(_few(gone), "_id", "left_anti")
    if not twice.isEmpty():
        stay = stay.withColumn("_text", F.col(f"row.`{text}`"))
        worded = F.col("_text").rlike(r"[^ \t-\r]")
        marked = stay.join(twice.withColumn("_twice", F.lit(True)), "_id", "left").withColumn("_twice", F.coalesce(F.col("_twice") & worded, F.lit(False)))
        one = marked.where("_twice").groupBy("_id").agg(F.min_by("row", F.struct("_text", F.to_json("row"))).alias("row"))
        stay = marked.where("not _twice").select("row").unionByName(one.select("row"))
    return stay.select("row.*")


OP10_SQL = r"""
with recursive low as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sh as (
  select distinct doc_id, array_to_string(w[i : i + 3], ' ') as s
  from (select doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) as i from low where len(w) > 0)),
n as (select doc_id, count(*) as n from sh group by doc_id),
inter as (select a.doc_id as x, b.doc_id as y, count(*) as k from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (select x, y from inter join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 80 * (p.n + q.n - k)),
both_ways as (select x, y from link union select y, x from link),
reach(d, c) as (
  select doc_id, doc_id from documents
  union
  select y, c from reach join both_ways on d = x),
comp as (select d, min(c) as c from reach group by d)
select l.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.c as component_id, l.doc_id = c.c as kept
from low l left join n using (doc_id) join comp c on c.d = l.doc_id
"""


def op10(spark, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))
