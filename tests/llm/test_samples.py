"""Bounded samples, language filters against Python sets, and what the classifiers do with odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewarp.llm import common, language_id, mixing, quality, toxicity


def test_share_holds_at_any_size(spark):
    for rows, bound in ((10**11, 600), (3 * 10**9, 2000), (5000, 2000), (10, 2000)):
        assert abs(common.cut_of(bound, rows) / 2**63 * rows - min(bound, rows)) < 1e-3 * bound
        got = spark.range(1).select(common.cut_of(bound, F.lit(rows))).first()[0]
        assert abs(got / 2**63 * rows - min(bound, rows)) < 1e-3 * bound


def test_bounded_sample(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 4 < 3, F.lit("a")).alias("lang"), F.col("id").cast("string").alias("text"))
    got = {r["lang"]: r["count"] for r in common.bounded_sample(df, ["lang"], 500).groupBy("lang").count().collect()}
    assert all(400 < got[x] < 600 for x in ("a", None))
    nulls = common.bounded_sample(df, ["lang"], 500).where("doc_id is null").count()  # not all or none of them
    assert 300 < nulls < 700
    assert common.bounded_sample(df.limit(0), ["lang"], 5).count() == 0


def test_labelled_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 50, f"{i:04d} " + "x" * 1000) for i in range(400)] + [(None, "n"), (60, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i % 60, i % 2) for i in range(300)] + [(None, 1), (60, 1), (61, 1), (3, None)], "doc_id bigint, y int")
    rows = common.labelled_sample(docs, labels, "y", 1000).collect()
    assert len(rows) == 51 and {r["doc_id"]: r["text"] for r in rows}[7] == "0007 " + "x" * 1000
    few = common.labelled_sample(docs, labels, "y", 1000, most_bytes=5000).collect()
    assert 0 < len(few) <= 10 and {r["doc_id"] for r in few} <= {r["doc_id"] for r in rows}


LANGS = [f"l{k:02d}" for k in range(70)]


def _say(rng, k, n):
    of_language = np.random.default_rng(1000 + k)
    own = ["".join(chr(97 + c) for c in of_language.integers(0, 26, 5)) + "éßяλ"[j % 4] for j in range(12)]
    return " ".join(rng.choice(own) for _ in range(n))


def test_more_languages_than_a_word_has_bits(spark):
    rng = np.random.default_rng(0)
    rows = [(i, _say(rng, k, 30), x) for k, x in enumerate(LANGS) for i in range(k * 6, k * 6 + 6)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    f = language_id.fit(train)
    assert f.table.shape[0] == 2 and f.langs == LANGS
    asked = [(k, _say(rng, k, 40), "x", 1.0) for k in range(70)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(spark.createDataFrame(asked, "doc_id bigint, text string, lang_pred string, score double"), f, ("doc_id", "score", "lang_pred")).collect()}
    assert np.mean([got[k] == LANGS[k] for k in range(70)]) > 0.9


def _sets(text):
    fold = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
    padded = b" " + fold + b" "
    return [padded[i : i + 4] for i in range(len(padded) - 3) if padded[i : i + 4] != b"    "] if text else []


def test_counts_equal_python_sets(monkeypatch):
    rng = np.random.default_rng(1)
    texts = ["", "a", "ab", "abc", "A b", "  x  ", "12 !? 34", "Straße", *[_say(rng, k, 20) for k in range(6)], "word " * 30]
    own = [{int.from_bytes(g, "little") for t in texts[8 + k :: 3] for g in _sets(t)} for k in range(3)]
    table, fill = language_id.sliced([np.array(sorted(x)) for x in own])
    f = language_id.Filters(["a", "b", "c"], table, fill**3, np.ones(3), 0)
    raw, off, _ = common.text_bytes(pa.array(texts))
    for piece in (1 << 20, 7, 5):
        monkeypatch.setattr(language_id, "PIECE", piece)
        total, hits = f.counts(raw, off)
        for i, t in enumerate(texts):
            g = _sets(t)
            assert total[i] == len(g)
            for k in range(3):  # a Bloom filter holds all of its set; what it holds beside is the share that is corrected
                real = sum(int.from_bytes(x, "little") in own[k] for x in g)
                assert real <= hits[i, k] <= real + max(2, 0.05 * len(g))


def test_long_text_is_read_whole(spark):
    rng = np.random.default_rng(2)
    long = _say(rng, 3, 400_000)
    assert len(long.encode()) > 2 << 20
    raw, off, _ = common.text_bytes(pa.array([long, long[: len(long) // 2]]))
    count = np.zeros(2)
    for g, row in language_id.grams(raw, off):
        np.add.at(count, row, 1)
    assert count.tolist() == [len(_sets(long)), len(_sets(long[: len(long) // 2]))]
    f = language_id.fit(spark.createDataFrame([(i, _say(rng, k, 60), LANGS[k]) for k in (3, 4) for i in range(k * 10, k * 10 + 10)], "doc_id bigint, text string, lang string"))
    both = f.predict(*common.text_bytes(pa.array([long, _say(rng, 3, 4000)]))[:2])
    assert both[0].tolist() == [0, 0] and abs(both[1][0] - both[1][1]) < 0.02


def test_classifiers_keep_clashing_columns(spark):
    df = spark.createDataFrame([(None, "good words", 1, "q"), (1, None, 2, "r"), (1, "", 3, "s"), (2, "good words", 4, "t")], "doc_id bigint, text string, row int, size string")
    labels = spark.createDataFrame([(None, 1), (1, 0), (2, 1), (2, 1), (7, 5)], "doc_id bigint, quality int")
    net = quality.fit(df, labels)
    got = quality.score(df, net, ("doc_id", "row", "size")).collect()
    assert len(got) == 4 and len({r["score"] for r in got if r["row"] in (1, 4)}) == 1 and len({r["score"] for r in got if r["row"] in (2, 3)}) == 1
    lexicon = toxicity.fit(df, labels.withColumnRenamed("quality", "toxic"))
    assert toxicity.score(df, lexicon, ("doc_id", "row", "size")).count() == 4
    out, domains, rates = mixing.mix(df, df.select("doc_id", F.col("size").alias("domain")), {"t": 1.0})
    assert out.columns == ["doc_id", "text", "row", "size", *mixing.ADDED] and sorted(r["row"] for r in out.collect()) == [1, 2, 3, 4] and rates.gap >= 0


def test_unreachable_targets_show_a_gap(spark):
    m = spark.createDataFrame([(10, [0.9, 0.1]), (10, [0.6, 0.4])], "n_tokens bigint, p array<double>")
    assert mixing.solve(m, np.array([0.0, 1.0])).gap > 0.1 and mixing.solve(m, np.array([0.8, 0.2])).gap < 1e-6


@pytest.mark.parametrize("targets", [[0.8, 0.2], [0.65, 0.35], [0.05, 0.95]])
def test_rates_against_dense_least_squares(spark, targets):
    rng = np.random.default_rng(7)
    p = rng.dirichlet([0.6, 0.6], 40)
    t = rng.integers(1, 50, 40)
    m = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p)], "n_tokens bigint, p array<double>").repartition(3)
    rates = mixing.solve(m, np.array(targets)).of(p)
    got = (t * rates) @ p
    r = np.ones(40)  # plain projected gradient over the rates themselves
    want = np.array(targets) * t.sum()
    a = p * t[:, None]
    for _ in range(60_000):
        r = np.maximum(0, r - a @ (r @ a - want) / (np.linalg.norm(a, 2) ** 2))
    assert (rates >= 0).all() and abs(np.square(got - want).sum() - np.square(r @ a - want).sum()) <= 1e-4 * np.square(want).sum()


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in all columns, repeated rows, no n_chars, columns named as the stages name theirs; and no rows at all."""
    import corpus_pipeline

    rng = np.random.default_rng(8)
    words = np.array("the plain words of some good text that goes on and on with more of it".split())
    rows = [(i, " ".join(rng.choice(words, 60)) + f" n{i}", "en" if i % 2 else "de", "m", i, "r", 0.5) for i in range(40)]
    rows += [(3, rows[3][1], "de", "m", 3, "r", 0.5), (100, None, None, None, None, None, None), (None, "alone here", None, None, None, None, None), (101, "", "en", "", 0, "", 0.0)]
    kinds = "doc_id bigint, text string, lang string, matches string, kept bigint, row string, score double"
    spark.createDataFrame([(i, "x", "y") for i in range(2)], "item_id bigint, text string, other string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(0, 40, 2)] + [(None, 0, None), (500, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for own, empty in ((rows, False), ([], True)):
        spark.createDataFrame(own, kinds).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path))
        assert out.columns == [c.split(" ")[0] for c in kinds.split(", ")] + mixing.ADDED
        got = out.collect()
        assert empty == (not got)
        ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
        assert len(ids) == len(set(ids)) and (empty or {r["kept"] for r in got if r["doc_id"] == 3} == {3})
