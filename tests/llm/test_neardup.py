"""SetSketch near-duplicates against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidewarp.llm import neardup


def _set(text):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def _brute(rows):
    ids = [i for i, _ in rows]
    sets, up = [_set(t) for _, t in rows], {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(ids[a]), top(ids[b])))
                up[y] = x
    return {i: (len(s), top(i)) for i, s in zip(ids, sets)}


def _texts(seed):
    rng = random.Random(seed)
    say = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    out = []
    for size, length, edits in ((40, 120, 8), (12, 60, 3), (6, 200, 25), (3, 10, 1)):
        base = say(length)
        for _ in range(size):  # chains of edits, some within the threshold of the base, some of one another only
            t = list(base)
            for _ in range(rng.randrange(edits + 1)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(400)}"
            out.append(" ".join(t))
    out += [" ".join(say(50)) for _ in range(20)] + ["a b c", "A b  c", "a b", "", None, "x", "x y z w", "X y z w"]
    rng.shuffle(out)
    return out


def test_components(spark):
    for seed in (1, 2):
        rows = [(i * 3 + 1, t) for i, t in enumerate(_texts(seed))]
        want = _brute(rows)
        got = neardup.components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_rest_alone_finds_links(spark, monkeypatch):
    """The exhaustive pass on its own, in many small blocks, finds what the rounds before it would."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "_verified", lambda members, full, similar=80: members.select("a", F.col("rep").alias("b"), F.lit(False).alias("linked")))
    rows = list(enumerate(_texts(3)[:60]))
    got = neardup.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == _brute(rows)


def test_small_shares_of_members(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SPLIT", 3)
    rows = list(enumerate(_texts(5)))
    got = neardup.components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == _brute(rows)


def test_repeated_ids_with_other_texts(spark):
    one, two = [f"a{i}" for i in range(13)], [f"b{i}" for i in range(13)]
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join([*one[:12], "z"])), (3, " ".join([*two[:12], "y"])), (4, "another text of its own here"), (4, ""), (5, "another text of its own here")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, row int")
    got = {(r["doc_id"], r["component_id"]) for r in neardup.components(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)} and got == {(i, c) for i, (_, c) in _brute(rows).items()}
    # one row of each component, the smallest text of the id that stays; rows without words stay
    assert sorted(r["row"] for r in neardup.deduplicate(df).collect()) == [0, 4, 5]


def test_deduplicate_keeps_one_of_equal_rows(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([(5, t, {"a": 1}), (5, t, {"a": 1}), (5, t.upper(), None), (9, t, None), (None, t, None), (None, t, None), (2, None, None), (2, None, None)], "doc_id bigint, text string, meta map<string,int>")
    out = neardup.deduplicate(df)
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["2", "2", "5", "None", "None"]
    assert [r["text"] for r in out.where("doc_id = 5").collect()] == [t.upper()]
    assert neardup.deduplicate(df.limit(0)).count() == 0


def test_very_long_text(spark):
    long = [f"w{i % 50_000}x{i // 3}" for i in range(300_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-2000], "end"])), (3, "w " * 200_000), (4, "w w w w")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: (len(_set(t)), {1: 1, 2: 1, 3: 3, 4: 3}[i]) for i, t in rows}


def test_nulls_and_repeats(spark):
    t = "one two three four five six seven"
    rows = [(5, t), (5, t), (None, t), (9, t.upper()), (2, None)]
    got = sorted(map(tuple, neardup.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == sorted([(5, 4, 5, True), (5, 4, 5, True), (None, 4, None, True), (9, 4, 5, False), (2, 0, 2, True)], key=str)
    assert neardup.components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_deduplicate_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", 7), (2, "a b c d e", 8)], "doc_id bigint, text string, kept int")
    out = neardup.deduplicate(df)
    assert out.columns == df.columns and [r["doc_id"] for r in out.collect()] == [1]


def test_estimate_and_merge():
    rng = np.random.default_rng(0)
    for true in (0.5, 0.8, 0.95):
        n = 2000
        both = int(2 * n * true / (1 + true))
        x = rng.integers(1, 2**63, 2 * n - both, dtype=np.uint64)
        a, b = x[:n], x[n - both :]
        k = neardup.sketch(np.concatenate([a, b]), np.array([0, n, 2 * n]))
        assert abs(neardup.estimate(k[:1], k[1:], np.array([float(n)]), np.array([float(n)]))[0] - true) < neardup.MARGIN
        parts = neardup.sketch(a, np.array([0, n // 2, n]))
        assert (np.maximum(parts[0], parts[1]) == k[0]).all()  # sketches of parts merge


def test_pipeline_stage_takes_five_words(spark):
    import corpus_pipeline

    # a changed word in the middle of 42: similarity 35 / 43 of four words, 33 / 43 of five
    one = [f"w{i}" for i in range(42)]
    two = [*one[:20], "other", *one[21:]]
    df = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(one))], "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in neardup.deduplicate(df).collect()) == [1]
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == [1, 2]
