"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding lower-cases, strips accents and width, maps look-alike letters of other scripts to Latin, and reads digits and
signs as the letters they stand for; `l`, `i` and `1` are one letter. A term counts where it stands as a word of its own
(a stem, written `stem*`, where it begins a word) and not inside an exception phrase. The weights of the terms found, alone and per length of text, give a probability.
Terms, weights, exceptions and the last step are learned from labelled rows, or given by the caller.

Defined results: a null, empty or term-free text has no matches and gets the share of toxic texts among such; with no
labels at all the score is 0. Repeated rows score alike; a term with the same skeleton as another counts once. Terms of equal
weight at one place: the later in alphabetical order counts. Columns to keep may have any name but those of the results.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import in_fold, labelled_sample, prepare, table

#: Labelled rows of each class that the fit takes, at most; terms kept; rows of a toxic term, as a share and at least.
SAMPLE, TERMS, SHARE, LEAST = 2000, 400, 0.015, 3
#: A term is, as surely as CERTAIN standard errors, at least so many times as frequent in toxic rows as in others.
TIMES, CERTAIN = 2.0, 1.64
#: Letters that a stem has; forms of a word from which it is taken for a stem with any ending; and the share of a
#: stem's rows that one more letter may keep, up to which the longer stem is the same.
STEM, FORMS, SAME = (4, 10), 3, 0.97

# Characters that look like, or are written for, a Latin letter.
LOOKALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "l": "i",
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "i", "ґ": "r", "п": "n", "ш": "w",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "i", "ø": "o", "đ": "d", "ħ": "h", "ß": "s", "æ": "a", "œ": "o", "ſ": "s",
}


class _Fold(dict):
    """Code point to its folded character; None for marks and zero-width characters. Filled as characters come up."""

    def __missing__(self, code: int) -> int | None:
        c = unicodedata.normalize("NFKD", chr(code)).lower()
        c = next((x for x in c if not unicodedata.combining(x)), "")
        kind = unicodedata.category(chr(code))
        if not c or kind in ("Mn", "Cf"):
            out = None
        else:
            c = unicodedata.normalize("NFKD", c)[0]
            out = ord(LOOKALIKES.get(c, c))
        self[code] = out
        return out


_FOLD = _Fold()
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    return text.translate(_FOLD)


def _places(text: str) -> list[int] | None:
    """Where each folded character stands in the text, or None if the folding left none out."""
    kept = [i for i, c in enumerate(text) if _FOLD[ord(c)] is not None]
    return None if len(kept) == len(text) else kept


@dataclass
class Lexicon:
    terms: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    last: tuple[float, float, float, float] = (-4.0, 4.0, 1.0, 0.5)  # intercept; any term; log weight; log weight per length

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for phrase, weight, term in [(x, 0.0, "") for x in self.exceptions] + [(x.rstrip("*"), w, x) for x, w in sorted(self.terms.items(), reverse=True)]:
            if folded := fold(phrase):
                own = found.get(folded, ()) + ((len(folded), weight, term),)
                found.add_word(folded, own)
        if not len(found):
            return None
        found.make_automaton()
        return found

    def matches(self, text: str, machine: ahocorasick.Automaton | None) -> list[tuple[int, int, str, float]]:
        """(start, end, term, weight) of each term that counts, places in the text as given."""
        if machine is None or not text:
            return []
        folded = fold(text)
        hits = [(end - n + 1, end + 1, term, weight) for end, own in machine.iter(folded) for n, weight, term in own]
        if not hits:
            return []
        at = _places(text)
        place = (lambda i: i) if at is None else (lambda i: at[i] if i < len(at) else len(text))
        own = []
        for a, b, term, weight in hits:
            x, y = place(a), place(b - 1) + 1
            # signs that stand for letters end a word as any other sign does
            if (x == 0 or not text[x - 1].isalnum()) and (y == len(text) or term.endswith("*") or not text[y].isalnum()):
                own.append((x, y, term, weight))
        spared = [(a, b) for a, b, term, _ in own if not term]
        best: dict[int, tuple[int, int, str, float]] = {}  # one term for each place, the weightiest
        for a, b, t, w in own:
            if t and (a not in best or (w, t) > (best[a][3], best[a][2])) and not any(x <= a and b <= y for x, y in spared):
                best[a] = (a, b, t, w)
        return [best[a] for a in sorted(best)]

    def features(self, weight: float, n_chars: int) -> tuple[float, float, float]:
        return (1.0, math.log1p(weight), math.log1p(1000 * weight / max(1, n_chars))) if weight > 0 else (0.0, 0.0, 0.0)

    def probability(self, weight: float, n_chars: int) -> float:
        z = self.last[0] + sum(c * x for c, x in zip(self.last[1:], self.features(weight, n_chars), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _tokens(text: str | None) -> list[str]:
    return _WORD.findall(fold(text or ""))


def _candidates(token: str) -> list[str]:
    return [token, *(token[:n] + "*" for n in range(STEM[0], min(STEM[1], len(token)) + 1))]


def _chosen(rows: dict[str, set], forms: Counter) -> list[str]:
    """Leaves out a stem of few forms (the words say it) and one that a letter more keeps nearly all rows of."""
    longer: dict[str, int] = {}
    for c, own in rows.items():
        if c.endswith("*"):
            longer[c[:-2]] = max(longer.get(c[:-2], 0), len(own))
    return [c for c, own in rows.items() if not c.endswith("*") or forms[c] >= FORMS and longer.get(c[:-1], 0) < SAME * len(own)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Lexicon:
    """Learn a lexicon from about `sample` labelled rows of each class, drawn from labels (doc_id, label)."""
    prepare(docs.sparkSession)
    labels = labels.where(F.col(label).isin(0, 1))
    rows = labelled_sample(docs, labels, label, sample).select("text", label)
    sizes = {r[label]: r["count"] for r in labels.groupBy(label).count().collect()}
    drawn = [min(sample, sizes.get(y, 0)) for y in (0, 1)]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            n = [0, 0]
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[y] += 1
                for w in {x for t in set(_tokens(text)) for x in _candidates(t)}:
                    seen.setdefault(w, [0, 0])[y] += 1
            seen[""] = n
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array([x[1] for x in seen.values()], pa.int64()), pa.array([x[0] for x in seen.values()], pa.int64())], names=["word", "bad", "good"])

    counts = rows.mapInArrow(words, "word string, bad bigint, good bigint").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    got = counts.where((F.col("bad") >= LEAST) & (F.col("bad") > F.col("good") * (TIMES / 2 * drawn[1] / max(1, drawn[0]))) | (F.col("word") == "")).collect()  # of a bounded sample
    n_bad, n_good = next(((r["bad"], r["good"]) for r in got if r["word"] == ""), (0, 0))
    if not n_bad:
        return Lexicon({}, last=(-30.0, 0.0, 0.0, 0.0))
    odds = lambda bad, good: (bad + 0.5) / (n_bad + 1) / ((good + 0.5) / (n_good + 1))
    likely = {r["word"] for r in got if r["word"] and r["bad"] >= SHARE * n_bad and odds(r["bad"], r["good"]) >= TIMES}

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = ["", *_tokens(text)]
                group = min((xxhash.xxh64_intdigest(" ".join(own[i : i + 3])) >> 1 for i in range(len(own))), default=0)
                seen |= {(c, p, y, group) for p, w in zip(own, own[1:], strict=False) for c in _candidates(w) if c in likely} | {("", "", y, group)}
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in seen], pa.string()) for k in range(2)), *(pa.array([x[k] for x in seen], pa.int64()) for k in (2, 3))], names=["word", "before", "y", "copies"])

    # Copies of a text share the smallest hash of its word triples, mostly: a term is in rows of many such groups.
    groups: dict[str, tuple[set, set]] = {w: (set(), set()) for w in ["", *likely]}
    before: dict[str, tuple[set, set]] = {w: (set(), set()) for w in ["", *likely]}
    for r in rows.mapInArrow(contexts, "word string, before string, y bigint, copies bigint").distinct().collect():  # of a bounded sample
        groups[r["word"]][r["y"]].add(r["copies"])
        before[r["word"]][r["y"]].add(r["before"])
    n_good, n_bad = (len(x) for x in groups.pop(""))
    def surely(bad: int, good: int) -> float:
        return math.log(odds(bad, good)) - CERTAIN * math.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))

    weights = {w: surely(len(bad), len(good)) for w, (good, bad) in groups.items() if len(bad) >= max(LEAST, SHARE * n_bad)}
    telling = {w: groups[w][1] for w, x in weights.items() if x >= math.log(TIMES)}
    forms = Counter(c for r in got if not r["word"].endswith("*") for c in _candidates(r["word"]) if c in telling)
    terms: dict[str, float] = {}
    for w in sorted(_chosen(telling, forms), key=lambda w: (len(w.rstrip("*")), not w.endswith("*"))):
        stems = [terms[w[:n] + "*"] for n in range(STEM[0], len(w.rstrip("*")) + 1) if w[:n] + "*" in terms and w[:n] + "*" != w]
        if weights[w] > max(stems, default=0.0):  # says more than the stem that covers it
            terms[w] = round(weights[w], 6)
    terms = dict(sorted(terms.items(), key=lambda x: (-x[1] * len(telling[x[0]]), x[0]))[:TERMS])
    spared = sorted(f"{p} {w.rstrip('*')}" for w in terms for p in before[w][0] - before[w][1] if p)
    lexicon = Lexicon(terms, spared)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            x = [lexicon.features(sum(m[3] for m in lexicon.matches(t or "", machine)), len(t or "")) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in x], pa.float64()) for k in range(3)), batch.column(1)], names=["a", "b", "c", "y"])

    x = rows.select("text", F.col(label).cast("int").alias("y")).mapInArrow(measured, "a double, b double, c double, y int").toPandas().sort_values(["a", "b", "c", "y"])
    y = x["y"].to_numpy(float)
    n_bad, n_good = int(y.sum()), int((1 - y).sum())
    weigh = np.where(y == 1, sizes.get(1, 0) / max(1, n_bad), sizes.get(0, 0) / max(1, n_good))
    lexicon.last = tuple(_logistic(x[["a", "b", "c"]].to_numpy(), y, weigh))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5, steps: int = 30) -> list[float]:
    """Newton's method, coefficients held by a ridge and never below 0 (more terms never make a text milder)."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    b = np.zeros(x.shape[1])
    hold = np.full(len(b), ridge)
    hold[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + hold * b
        b = b - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(hold), grad)
        b[1:] = np.maximum(b[1:], 0)
    return b.tolist()


def score(docs: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ("doc_id",), text: str = "text", cut: float = 0.3) -> DataFrame:
    """keep, the matches, score (0 to 1) and predicted (1 if score >= cut) of every row."""
    prepare(docs.sparkSession)
    keep = tuple(c for c in keep if c not in ("matches", "score", "predicted", "_text"))
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = (
        rows.drop("_text").withColumn("matches", F.lit(None).cast("array<struct<start:int,end:int,term:string,weight:double>>"))
        .withColumn("score", F.lit(None).cast("double")).withColumn("predicted", F.lit(None).cast("int")).schema
    )
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [lexicon.matches(t or "", machine) for t in texts]
            p = np.array([lexicon.probability(sum(m[3] for m in f), len(t or "")) for t, f in zip(texts, found, strict=True)], float)
            spans = pa.array([[{"start": a, "end": b, "term": t, "weight": w} for a, b, t, w in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], spans, pa.array(p), pa.array((p >= cut).astype(np.int32))], names=[*keep, "matches", "score", "predicted"])

    return rows.mapInArrow(run, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = fit(docs, table(spark, sf_dir, "labels").where(~in_fold(4, 2)))
    return score(docs.withColumn("held_out", in_fold(4, 2)), lexicon, ("doc_id", "held_out")).drop("matches")
