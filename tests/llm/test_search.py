"""Vantage-point search, url rules and language filters."""

import numpy as np

from tidewarp.llm import language_id, urlfilter, vptree


def _brute(rows, k, one_in):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 6]
    out = []
    for i, q in fine:
        if i % one_in == 0:
            best = sorted((-float(np.add.accumulate(q * v)[-1]), j) for j, v in fine if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_vptree_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 6)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[3].tolist()) for i in range(70)]
    rows += [(2000, None), (2001, [0.0] * 6), (2002, [None] * 6), (2003, [float("nan")] * 6), (2004, [float("inf")] * 6), (None, x[0].tolist()), (2005, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for shard, block in ((100_000, 100_000), (128, 16)):
        got = sorted(tuple(r) for r in vptree.nearest(df, 20, 20, 1.0, shard, block).select("query_id", "rank", "vec_id", "score").collect())
        assert got == _brute(rows, 20, 20)
    few = [(0, [1.0] * 6), (20, [2.0] * 6), (3, [1.0] * 6)]
    assert sorted(tuple(r) for r in vptree.nearest(spark.createDataFrame(few, "vec_id bigint, embedding array<double>")).select("query_id", "rank", "vec_id", "score").collect()) == _brute(few, 20, 20)
    assert vptree.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0


def _pairs(rows, k, one_in):
    """Every row against every query row, as the operator's SQL has it."""
    fine = [(i, np.array(v, float)) for i, v in rows]
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        for q in sorted({i for i, _ in fine if i % one_in == 0}):
            best = [(float(np.add.accumulate(v * w)[-1]), j) for i, v in fine if i == q for j, w in fine if j != q]
            best.sort(key=lambda r: (r[0] == r[0], -r[0] if r[0] == r[0] else 0, r[1]))
            out += [(q, r + 1, j, repr(s)) for r, (s, j) in enumerate(best[:k])]
    return out


def test_vptree_lengths_far_apart(spark):
    rng = np.random.default_rng(4)
    for low, high in ((-8, 150), (150, 160), (-160, -140), (0, 0)):
        x = rng.normal(size=(400, 5))
        x *= 10.0 ** rng.uniform(low, high, (400, 1))
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        got = vptree.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 7, 20, 1.0, 150, 8)
        assert sorted((r["query_id"], r["rank"], r["vec_id"], repr(r["score"])) for r in got.collect()) == _pairs(rows, 7, 20)


def test_vptree_one_long_vector(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for size in (1e6, 1e10, 1e160):
        x[77] *= size / np.linalg.norm(x[77])
        rows = [(i, v.tolist()) for i, v in enumerate(x)]
        got = vptree.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 10, 20)
        assert sorted((r["query_id"], r["rank"], r["vec_id"], repr(r["score"])) for r in got.collect()) == _pairs(rows, 10, 20)


def test_vptree_repeats_and_other_columns(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (300, 3)).astype(float)
    x[(x == 0).all(1)] = 1.0
    # ids with several vectors, vectors with several ids, rows twice, and ties of whole numbers
    rows = [(i % 130, v.tolist()) for i, v in enumerate(x)] + [(20, [1.0, 2.0, 2.0])] * 40 + [(i, [2.0, 2.0, 2.0]) for i in range(500, 560)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, score string, s int")
    for shard in (64, 100_000):
        got = vptree.nearest(df, 9, 20, 1.0, shard, 5)
        assert sorted((r["query_id"], r["rank"], r["vec_id"], repr(r["score"])) for r in got.collect()) == _pairs(rows, 9, 20)


def test_vptree_sends_candidates_once(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 11)]) for i in range(400)]
    plan = vptree.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 3, 2, 1.0, 50, 4)
    # 400 candidates, and 200 queries to each of 8 shards
    assert plan.count() == 600 and "MapInArrow" in plan._jdf.queryExecution().toString()


def test_relaxed_pruning_recall():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 6))
    x = centres[rng.integers(0, 12, 3000)] + 0.05 * rng.normal(size=(3000, 6))
    exact, near = (vptree.search_shard(np.arange(3000), x, np.arange(0, 3000, 60), x[::60], 10, f) for f in (1.0, 1.02))
    assert len({r[:2] for r in exact} & {r[:2] for r in near}) >= 0.9 * len(exact)


def test_urls(spark):
    cases = {
        "http://a.EXAMPLE.net/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"), "http://example.net/de/": ("example.net", "/de/", "net/", "block"), "https://net": ("net", "", None, "allow"),
        "x://notexample.com/de/": ("notexample.com", "/de/", None, "allow"), "x://b.example.com/de/1": ("b.example.com", "/de/1", "example.com/de/", "block"), "ftp://w.org/fr/": ("w.org", "/fr/", "org/fr/", "allow"),
        "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://?a": ("", "", None, "allow"), "a://b.net#/c": ("b.net", "", None, "allow"), "h://É.net/": ("É.net", "/", "net/", "block"),
    }
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id bigint, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urlfilter.filter_pages(df).columns == df.columns
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_urls_over_several_files(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x/", "block"), ("org", "", "block"), ("org", "/ok", "allow"), ("b.org", "", "allow"), ("net", "/", "allow"), ("net", "/de", "allow")]
    urls = ["http://x.net/", "http://a.example.net/en/x/1", "http://a.example.net/en/y", "h://b.org", "h://b.org/ok" + "/x" * 100_000, "h://c.org/q", "h://net/de", None, "q", "h://" + "l." * 3000 + "net/"]
    df = spark.createDataFrame([(i, u, "r", "h") for i, u in enumerate(urls)], "page_id bigint, url string, row string, host string")
    want = []
    for i, u in enumerate(urls):
        h, p = urlfilter.host_path(u)
        own = [(-len(a + b), a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        want.append((i, min(own)[1:] if own else (None, "allow")))
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    for given, most in ((rules, 1 << 20), (rules, 60), (table, 120)):
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(df, given, most=most).collect()}
        assert sorted(got.items()) == want
    assert {r["verdict"] for r in urlfilter.judge(df, []).collect()} == {"allow"}
    kept = urlfilter.filter_pages(df, rules)
    assert kept.schema == df.schema and {r["page_id"] for r in kept.collect()} == {i for i, (_, v) in want if v == "allow"}


def test_url_collisions_are_confirmed():
    f = urlfilter.DigestFilter.mapped(urlfilter.digest_file([("a.com", "/x", "block")]))
    f.digests = np.array([urlfilter.xxhash.xxh64_intdigest("b.com\0/y")], np.uint64)  # another key under the digest
    assert f.probe([("b.com", "/y")]) == [None]


def test_languages(spark):
    texts = {"en": "the quick brown fox jumps over the lazy dog and then the other one", "de": "der schnelle braune fuchs springt über den faulen hund und dann noch weiter", "ru": "быстрая лиса прыгает через ленивую собаку и потом ещё дальше"}
    rows = [(i * 3 + j, t + f" {i}", lang) for i in range(20) for j, (lang, t) in enumerate(texts.items())]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    f = language_id.fit(train)
    asked = [(1, "the lazy fox"), (2, "über den hund"), (3, "ленивую собаку"), (4, None), (5, ""), (6, "12 !? 34"), (7, "漢字"), (8, "the fox " * 200_000)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(spark.createDataFrame(asked, "doc_id bigint, text string"), f).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4, 5, 6, 8)] == ["en", "de", "ru", "und", "und", "und", "en"]
    assert got[7][0] in texts and got[7][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    none = language_id.fit(train.limit(0))
    assert language_id.identify(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), none).first()["lang_pred"] == "und"
