"""Quotation linking against a loop over the messages, and its behaviour on long texts."""

import random
import re
import time

import pytest

from tidewarp.llm import quotes

MARKS = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
INTRO = re.compile(r"(?i)\b(wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t]*$")


def _norm(t):
    return " ".join(t.lower().split())


def _parts(text):
    """Own text, and passages as (level, text)."""
    lines = []
    for x in (text or "").split("\n"):
        m = MARKS.match(x)
        lines.append((len(re.sub(r"[ \t]", "", m[1])) if m else 0, MARKS.sub("", x) if m else x))
    intro = [lv == 0 and bool(INTRO.search(t)) and i + 1 < len(lines) and lines[i + 1][0] > 0 for i, (lv, t) in enumerate(lines)]
    runs = []
    for (lv, t), skip in zip(lines, intro):
        if skip:
            continue
        if runs and runs[-1][0] == lv:
            runs[-1][1].append(t)
        else:
            runs.append((lv, [t]))
    passages = [(lv, "\n".join(t)) for lv, t in runs if lv > 0 and "\n".join(t).strip(" ")]
    if not any(lv for lv, _ in lines):
        return text, []
    own = "\n".join(t for (lv, t), skip in zip(lines, intro) if lv == 0 and not skip)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"^\n+|\n+$", "", own)), passages


def _brute(rows):
    parsed = [(c, t, *_parts(x)) for c, t, x in rows]
    where = {}
    for c, t, own, _ in parsed:
        if own is not None and c is not None and t is not None:
            for part in {own, *re.split(r"\n\s*\n", own), *own.split("\n")}:
                if part.strip(" "):
                    where.setdefault(_norm(part), set()).add((c, t))
    parents, inner = [], []
    for c, t, _, passages in parsed:
        best = None
        found = {}
        for place, (level, text) in enumerate(passages):
            own = []
            for line, key in [(0, _norm(text))] + [(1, _norm(x)) for x in text.split("\n") if x.strip(" ") and _norm(x) != _norm(text)]:
                have = where.get(key, set())
                near = [k for d, k in have if c is not None and t is not None and d == c and k < t]
                if near:
                    own.append((line, 0, -max(near), c, max(near)))
                elif have and not (t is not None and min(have)[0] == c and min(have)[1] >= t):
                    own.append((line, 1, 0, *min(have)))
            if own:
                line, far, _, pc, pt = min(own)
                found[place] = (level, far, pt)
                best = min(x for x in (best, (level, far, line, place, pc, pt)) if x is not None)
        parents.append(best[4:] if best else (None, None))
        inner.append((c, found))
    up = {}
    for (c, t, *_), (pc, pt) in zip(parsed, parents):
        if pc is not None and pc == c and t is not None and pt < t:
            up[c, t] = min(pt, up.get((c, t), pt))
    more = {}
    for c, found in inner:
        for place, (level, far, turn) in found.items():
            for beside in (place - 1, place + 1):
                if far == 0 and beside in found and found[beside][0] == level + 1 and found[beside][1] == 0 and found[beside][2] < turn:
                    more[c, turn] = max(found[beside][2], more.get((c, turn), found[beside][2]))
    up = {**more, **up}

    def root(c, t):
        while (c, t) in up:
            t = up[c, t]
        return t

    return sorted(((c, t, own, len(p), max([lv for lv, _ in p], default=0), *parent, root(c, t) if t is not None else t) for (c, t, own, p), parent in zip(parsed, parents)), key=repr)


def _mail(seed, n):
    rng = random.Random(seed)
    say = lambda: " ".join(rng.choice("alpha beta gamma delta thanks ok yes no".split()) + str(rng.randrange(60)) for _ in range(rng.randrange(1, 4)))
    rows, texts = [], {}
    for _ in range(n):
        c = rng.choice([1, 1, 1, 2, 3, 4])
        t = len(texts.setdefault(c, []))
        lines = []
        for _ in range(rng.choice([0, 1, 1, 2])):
            source = rng.choice(texts[rng.choice(list(texts))] or [""])
            if rng.random() < 0.5:
                lines.append("Bob wrote:")
            depth = rng.choice([1, 1, 2, 3])
            lines += [">" * depth + " " + x for x in source.split("\n")[: rng.choice([1, 2, 9])]]
            lines += [say()] if rng.random() < 0.7 else []
        lines += ["Thanks,"] * (rng.random() < 0.4) + [say() for _ in range(rng.randrange(3))]
        text = "\n".join(lines)
        texts[c].append(text)
        rows.append((c, t, text))
    return rows + [(1, 2, "> ok1\nagain"), (2, 0, None), (None, 3, "> thanks1"), (4, None, "Thanks,"), (1, 9, "> \n>\n")]


@pytest.mark.parametrize("seed, run", [(1, 4096), (2, 4), (3, 1)])
def test_links_against_a_loop(spark, monkeypatch, seed, run):
    monkeypatch.setattr(quotes, "TURNS", run)
    rows = _mail(seed, 160)
    df = spark.createDataFrame([(c, t, "u", x, "m", 1) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string, thread string, depth int").repartition(3)
    got = [(r["conv_id"], r["turn"], r["text"], r["n_quotes"], r["depth"], r["parent_conv"], r["parent_turn"], r["thread"]) for r in quotes.link(df).collect()]
    want = _brute(rows)
    assert sorted(got, key=repr) == want and sum(r[5] is not None for r in want) > 40


def test_lines_are_gone_through_once(spark):
    took = []
    for n in (4_000, 32_000):
        text = "\n".join(("> " * (i % 3) + f"line {i}") for i in range(n))
        df = spark.createDataFrame([(1, 0, "u", text)], "conv_id bigint, turn bigint, role string, text string")
        began = time.time()
        r = quotes._with_passages(df).select("passages").first()
        took.append(time.time() - began)
        assert len(r["passages"]) == sum(i % 3 > 0 for i in range(n))
    assert took[1] < 8 * 8 * took[0] + 5
