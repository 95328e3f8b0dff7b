"""URL filter: host and path rules as a sorted array of 64-bit digests, memory-mapped and probed by binary search.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's path; the longest fitting
rule (characters of host and path together; ties to the smaller rule) gives the verdict. A url's keys are its host
suffixes at label borders times its path prefixes of the lengths that rules have; every key's xxhash64 is looked up in
the sorted digests by one vectorised search per batch, and a hit counts only if the stored rule equals the key.

Rules are sent to the workers as digest files of a checked size, `MOST_BYTES`; a longer list takes several passes over the
urls, one file after the other, each of which keeps the best rule so far: the longest rule wins over all files as over one.

Defined results: a null url, or one without `://`, has an empty host and path and fits no rule; without a fitting rule
the verdict is the filter's default. Repeated rows each get a result; of rules that repeat a host and path the smaller verdict
counts; without rules all is the default. A very long url is looked up by as many keys as its host has labels times the
rules' path lengths. Of columns named as the results are, the results' stay; `filter_pages` returns rows as they came.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import prepare, table, written

#: Bytes of rules that one broadcast may hold.
MOST_BYTES = 64 << 20

#: Fixed rules of the contract: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

OUT = "host string, path string, rule string, verdict string"


def digest_file(rules: list[tuple[str, str, str]]) -> bytes:
    """The filter as bytes: count, then the sorted digests, the order of the rules' strings, their offsets, the strings."""
    keys = [f"{h}\0{p}".encode() for h, p, _ in rules]
    hashes = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
    order = np.argsort(hashes, kind="stable")
    stored = [keys[i] + b"\0" + rules[i][2].encode() for i in order]
    ends = np.cumsum([0, *map(len, stored)]).astype(np.int64)
    return np.int64(len(rules)).tobytes() + hashes[order].tobytes() + ends.tobytes() + b"".join(stored)


class DigestFilter:
    """Probes a memory-mapped digest file."""

    def __init__(self, path: str):
        flat = np.memmap(path, np.uint8, "r")
        n = int(flat[:8].view(np.int64)[0])
        self.digests = flat[8 : 8 + 8 * n].view(np.uint64)
        self.ends = flat[8 + 8 * n : 16 + 16 * n].view(np.int64)
        self.strings = flat[16 + 16 * n :]
        self.path_lengths = sorted({len(self.rule(k)[1]) for k in range(n)})

    def rule(self, k: int) -> list[str]:
        return bytes(self.strings[self.ends[k] : self.ends[k + 1]]).decode().split("\0")

    @classmethod
    def mapped(cls, data: bytes) -> DigestFilter:
        """Map the bytes from a file of the worker's own, which has no name any more once it is mapped."""
        fd, path = tempfile.mkstemp(prefix="urlfilter-")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(data)
            return cls(path)
        finally:
            os.unlink(path)

    def probe(self, keys: list[tuple[str, str]]) -> list[list[str] | None]:
        """The rule stored under each (host, path) key, if any: digests narrow, full strings confirm."""
        if not keys or not len(self.digests):
            return [None] * len(keys)
        hashes = np.array([xxhash.xxh64_intdigest(f"{h}\0{p}") for h, p in keys], np.uint64)
        lo, hi = np.searchsorted(self.digests, hashes, "left"), np.searchsorted(self.digests, hashes, "right")
        found: list[list[str] | None] = [None] * len(keys)
        for i in np.flatnonzero(hi > lo).tolist():
            for k in range(int(lo[i]), int(hi[i])):
                rule = self.rule(k)
                if (rule[0], rule[1]) == keys[i]:
                    found[i] = rule
        return found


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    stop = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:stop]
    slash = rest.find("/")
    return (rest.translate(_LOWER), "") if slash < 0 else (rest[:slash].translate(_LOWER), rest[slash:])


def keys_of(host: str, path: str, lengths: list[int]) -> list[tuple[str, str]]:
    labels = host.split(".") if host else []
    return [(".".join(labels[i:]), path[:n]) for i in range(len(labels)) for n in lengths if n <= len(path)]


def _files(rules, most: int) -> Iterator[bytes]:
    """The rules (host, path, verdict), of a list or a DataFrame, as digest files of about `most` bytes each."""
    own: list[tuple[str, str, str]] = []
    size, made = 0, False
    for h, p, v in rules.select("host", "path", "verdict").toLocalIterator() if isinstance(rules, DataFrame) else rules:
        if own and size + len(h) + len(p) + len(v) + 40 > most:
            yield digest_file(own)
            own, size, made = [], 0, True
        own.append((h, p, v))
        size += len(h.encode()) + len(p.encode()) + len(v.encode()) + 40
    if own or not made:
        yield digest_file(own)


def _best(parts: list[tuple[str, str]], index: DigestFilter, best: list[tuple | None]) -> list[tuple | None]:
    """The best rule of each (host, path), of the index and of the ones known before: (-length, name, verdict)."""
    keys, owner = [], []
    for i, (h, p) in enumerate(parts):
        own = keys_of(h, p, index.path_lengths)
        keys += own
        owner += [i] * len(own)
    for i, rule in zip(owner, index.probe(keys), strict=True):
        if rule is not None:
            name = rule[0] + rule[1]
            rank = (-len(name), name, rule[2])
            if best[i] is None or rank < best[i]:
                best[i] = rank
    return best


def _judged(pages: DataFrame, rules, default: str, keep: list[str], url: str, most: int) -> DataFrame:
    """row (the columns to keep), url, host, path, rule, verdict of every page."""
    spark = pages.sparkSession
    prepare(spark)
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(0).alias("_"))
    none = F.lit(None).cast("string")
    out = pages.select(kept.alias("row"), F.col(url).cast("string").alias("url"), none.alias("host"), none.alias("path"), none.alias("rule"), none.alias("verdict"))

    def searcher(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = DigestFilter.mapped(sent.value)
            for batch in batches:
                parts = [host_path(u) for u in batch.column(1).to_pylist()]
                known = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
                best = _best(parts, index, [None if r is None else (-len(r), r, v) for r, v in known])
                columns = [[h for h, _ in parts], [p for _, p in parts], [b and b[1] for b in best], [b[2] if b else default for b in best]]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.string()) for c in columns)], names=["row", "url", "host", "path", "rule", "verdict"])

        return run

    before = None
    for data in _files(rules, most):
        if before is not None:  # another file: the one before is done with
            out = written(out, "judged")
            before.destroy()
        before = spark.sparkContext.broadcast(data)
        out = out.mapInArrow(searcher(before), out.schema)
    return out


def judge(pages: DataFrame, rules=RULES, default: str = "allow", keep: tuple[str, ...] = ("page_id",), url: str = "url", most: int = MOST_BYTES) -> DataFrame:
    """keep, host, path, rule (host + path of the winning rule, else null) and verdict of every row.

    rules: (host, path, verdict) as a list or a DataFrame."""
    keep = tuple(c for c in keep if c not in ("host", "path", "rule", "verdict"))
    return _judged(pages, rules, default, list(keep), url, most).select(*(F.col(f"row.`{c}`") for c in keep), "host", "path", "rule", "verdict")


def filter_pages(pages: DataFrame, rules=RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """The pages whose url is allowed, with the columns they came with."""
    return _judged(pages, rules, default, pages.columns, url, MOST_BYTES).where("verdict = 'allow'").select("row.*")


OP9_SQL = r"""
with rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
parts as (
  select page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
best as (
  select page_id, arg_max(struct_pack(r := h || p, v := v), len(h) + len(p)) as b
  from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
select page_id, host, path, b.r as rule, coalesce(b.v, 'allow') as verdict from parts left join best using (page_id)
"""


def op9(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
