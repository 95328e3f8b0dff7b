"""The quality network and the toxic lexicon against loops that say the same the long way."""

import random

import numpy as np
import pyarrow as pa

from tidewarp.llm import quality, toxicity
from tidewarp.llm.common import text_bytes


def _score(net, text):
    """One text: every window by itself, the largest response of each hop, of each two neighbouring hops, and over the text."""
    raw = list((text or "").encode())
    hops = -(-(len(raw) + quality.WIDTH) // quality.HOP)
    padded = raw + [0] * (hops * quality.HOP + quality.WIDTH - len(raw))
    beyond = -(-quality.WIDTH // quality.STRIDE) - 1  # windows of the last hop that reach over the padding's end
    tops = []
    for h in range(hops):
        best = np.full(quality.FILTERS, -np.inf)
        for k in range(quality.PER_HOP - (beyond if h == hops - 1 else 0)):
            at = h * quality.HOP + k * quality.STRIDE
            best = np.maximum(best, np.concatenate([net.embed[c] for c in padded[at : at + quality.WIDTH]]) @ net.filters)
        tops.append(np.maximum(best + net.bias, 0))
    chunks = [np.maximum(tops[h], tops[h + 1]) if h + 1 < hops else tops[h] for h in range(hops)]
    x = np.concatenate([np.mean(chunks, 0), np.max(chunks, 0), np.min(chunks, 0), [np.log1p(len(raw)) / 10]])
    return 1 / (1 + np.exp(-(x @ net.head + net.intercept)))


def test_quality_against_a_loop_over_windows():
    rng = random.Random(1)
    net = quality.train(["plain good words in a row"] * 10 + ["BUY!!! NOW $$$"] * 10, [1] * 10 + [0] * 10)
    texts = ["", None, "a", "x" * 115, "y" * 116, "z" * 117, "é" * 300, *("".join(rng.choice("abc XYZ!ß$ \n") for _ in range(rng.choice([5, 100, 127, 128, 129, 500, 2000]))) for _ in range(25))]
    got = net.score(*text_bytes(pa.array(texts, pa.string()))[:2])
    assert np.allclose(got, [_score(net, t) for t in texts], atol=1e-5)


def _found(lexicon, text):
    """Every place of every term by str.find on the folded text, one term for each place."""
    kept = [i for i, c in enumerate(text) if toxicity._FOLD[ord(c)] is not None]
    folded = "".join(chr(toxicity._FOLD[ord(text[i])]) for i in kept)

    def places(phrase, stem):
        term = toxicity.fold(phrase.rstrip("*"))
        at = folded.find(term)
        while at >= 0 and term:
            a, b = kept[at], kept[at + len(term) - 1] + 1
            if (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or stem or not text[b].isalnum()):
                yield a, b
            at = folded.find(term, at + 1)

    spared = [p for x in lexicon.exceptions for p in places(x, False)]
    best = {}
    for term, weight in lexicon.terms.items():
        for a, b in places(term, term.endswith("*")):
            if not any(x <= a and b <= y for x, y in spared) and (a not in best or (weight, term) > (best[a][3], best[a][2])):
                best[a] = (a, b, term, weight)
    return [best[a] for a in sorted(best)]


def test_lexicon_against_find():
    rng = random.Random(2)
    lexicon = toxicity.Lexicon({"idiot": 3.0, "scum*": 2.0, "scumbag": 5.0, "bad dog": 1.5, "dog": 1.5, "ass": 1.0}, ["village idiot", "hot dog"])
    machine = lexicon.automaton()
    words = ["idiot", "1d10t", "іdіоt", "ＩＤＩＯＴ", "id​iot", "ídiöt", "idiotic", "village", "scum", "scummy", "scumbag", "$cumbag", "bad", "dog", "d0g", "hot", "a55", "class", "ass", "́", "x"]
    seen = 0
    for _ in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", ", ", "!", "-", "", "\n"]) for _ in range(rng.randrange(12)))
        assert lexicon.matches(text, machine) == _found(lexicon, text)
        seen += len(_found(lexicon, text))
    assert seen > 300
    long = "fine words " * 200_000 + "scumbag " + "dog " * 1000
    assert lexicon.matches(long, machine) == _found(lexicon, long) and len(lexicon.matches(long, machine)) == 1001
