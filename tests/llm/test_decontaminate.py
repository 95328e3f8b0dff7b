"""Suffix arrays against a word-by-word search, with nulls, empty texts, repeats and clashing columns."""

import hashlib
import random
import re

from tidewarp.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def _words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def _brute(text, items, window):
    doc, hit, ids = _words(text), set(), set()
    for i, t in items:
        item = _words(t)
        d = min(window, len(item))
        for q in range(len(item) - d + 1 if item else 0):
            for p in range(len(doc) - d + 1):
                if doc[p : p + d] == item[q : q + d]:
                    hit |= set(range(p, p + d))
                    ids.add(str(i))
    return len(doc), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(doc)


def _case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "bb", "CC", "é", "d1", "x"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 2, 3, 5, 8, 20]))) for i in range(8)] + [(99, None), (100, "..."), (101, "solo")]
    docs = [say(rng.choice([0, 1, 4, 30, 90])) for _ in range(25)] + [None, "", "!!!", "solo", items[6][1] + " tail"]
    return items, docs


def test_against_brute_force(spark):
    for seed, window in ((1, 5), (2, 13), (3, 3)):
        items, texts = _case(seed)
        docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)] + [(0, texts[0], "m")], "doc_id bigint, text string, matches string")
        bench = spark.createDataFrame(items, "item_id bigint, text string")
        for block in (1 << 20, 16):  # the benchmark in one block, and in many
            got = decontaminate.judged(decontaminate.matches(docs.select("doc_id", "text"), bench, window, block_bytes=block)).collect()
            assert len(got) == len(texts) + 1
            for r in got:
                assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == _brute(texts[r["doc_id"]], items, window)


def test_longest_match(spark):
    bench = spark.createDataFrame([(7, "one two three four five six")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x One two, three four y five six")], "doc_id bigint, text string")
    found = decontaminate.matches(docs, bench, 3).first()["matches"]
    assert [tuple(m) for m in found] == [(7, 0, 1, 4)]


def test_keeps_columns_that_clash(spark):
    own = "doc_id bigint, text string, n_hit int, n_words string, matches string, row int, contaminated boolean, items_sha256 string, n_items int"
    rows = [(1, "clean text", 5, "q", "m", 1, True, "z", 3), (2, "only this passage here", 6, "r", "n", 2, False, "y", 4), (None, None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, own)
    bench = spark.createDataFrame([(1, "only this passage here")], "item_id bigint, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.schema == docs.schema and {tuple(r) for r in kept.collect()} == {rows[0], rows[2]}
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 3
    got = decontaminate.matches(docs, bench, keep=("doc_id", "n_hit", "matches")).where("doc_id = 2").first()
    assert got["n_hit"] == 6 and len(got["matches"]) == 1


def test_long_texts_and_shared_windows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PAIRS", 50)
    rng = random.Random(5)
    say = lambda n: " ".join(f"w{rng.randrange(30_000)}" for _ in range(n))
    passage = say(40)
    items = [(i, f"{say(i % 5)} {passage} {say(3)}") for i in range(60)] + [(100, "the " * 30), (101, "the " * 40)] + [(7, say(20))]
    long = f"{say(120_000)} {passage} {say(100)} {passage} {'the ' * 50} {say(80_000)}"
    docs = [(1, long), (2, passage), (3, "the " * 45), (4, say(50)), (4, say(60))]
    got = decontaminate.judged(decontaminate.matches(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), block_bytes=4000)).collect()
    one = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and one[1]["n_words"] == len(_words(long)) and one[1]["n_items"] == 62 and one[1]["n_hit"] == 40 + 40 + 50
    assert (one[2]["n_hit"], one[2]["n_items"], one[2]["contaminated"]) == (40, 60, True) and one[3]["n_hit"] == 45
    assert max(m["n_words"] for m in one[3]["matches"]) == 40 and {m["n_words"] for m in one[2]["matches"]} == {40}


def test_index_stays_near_the_text_s_size():
    rng = random.Random(6)
    texts = [" ".join(f"word{rng.randrange(10**6)}" for _ in range(1000)) for _ in range(200)]
    size = sum(map(len, texts))
    index = decontaminate.Suffixes(list(range(200)), texts)
    assert index.nbytes < 4 * size + (1 << 20)
