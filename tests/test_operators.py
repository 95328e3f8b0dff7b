"""Fixed values and invariants of the planning operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidewarp.config import Cluster, Model, Plan
from tidewarp.functions import cost, padding, tokens
from tidewarp.operators import allocation, attention, batching, blocks, experiments, masks, placement, schedule
from tidewarp.plans.catalogue import P, QUERIES
from tidewarp.plans.planner import Planned
from tidewarp.sources import from_lengths, mock_multimodal, mock_sequences

# attended pairs: length -> causal, lambda, shared question, causal blockwise, lambda with a window of 512
PAIRS = {1: (1, 1, 1, 1, 1), 63: (2016, 2016, 1044, 2016, 2016), 65: (2145, 2145, 1131, 2145, 2145), 500: (125250, 125250, 65250, 125250, 125250), 1000: (500500, 500500, 260500, 500500, 410400), 1643: (1350546, 1350546, 702090, 1056018, 780768), 5000: (12502500, 12149280, 6502500, 4115940, 2714400)}
# work blocks per head: (length, block) -> causal, lambda with a window of 512, shared question, causal blockwise
KEPT = {(1000, 256): (10, 10, 9, 10), (1643, 256): (28, 22, 23, 25), (1643, 1024): (3, 3, 3, 3), (5000, 256): (210, 74, 126, 90), (9419, 1024): (55, 27, 37, 34)}


@pytest.mark.parametrize("mask, at, window", [("causal", 0, 4096), ("lambda", 1, 4096), ("shared_question", 2, 4096), ("causal_blockwise", 3, 4096), ("lambda", 4, 512)])
def test_attended_pairs(spark, mask, at, window):
    lengths = list(PAIRS)
    got = {lengths[r["seq_id"]]: r["pairs"] for r in masks.counts(masks.ranges(from_lengths(spark, lengths), mask, Plan(l_pretrain=window))).collect()}
    assert got == {n: PAIRS[n][at] for n in lengths}


@pytest.mark.parametrize("mask, at", [("causal", 0), ("lambda", 1), ("shared_question", 2), ("causal_blockwise", 3)])
def test_kept_blocks(spark, mask, at):
    for block in (256, 1024):
        own = [n for n, b in KEPT if b == block]
        seqs = from_lengths(spark, own).withColumn("batch_id", F.lit(0).cast("bigint"))
        got = {own[r["seq_id"]]: r["count"] for r in blocks.block_pairs(seqs, mask, Plan(block=block, l_pretrain=512)).groupBy("seq_id").count().collect()}
        assert got == {n: KEPT[n, block][at] for n in own}


@pytest.mark.parametrize("devices, lengths, size", [(8, [11610, 12200, 16384, 16384], 8192), (8, [45613, 9419], 8192), (4, [128, 128, 512, 512, 1024, 2048], 1024), (4, [1050, 1643, 1050, 1643], 512)])
def test_block_size(devices, lengths, size):
    assert batching.block_size(lengths, devices) == size


def _packed(spark, lengths, budget, **kw):
    df = spark.createDataFrame([(i, i, n) for i, n in enumerate(lengths)] or [], "place bigint, id bigint, n bigint")
    out: dict = {}
    for r in batching.pack(df, budget, **kw).where("batch_id is not null").orderBy("batch_id", "seq_in_batch").collect():
        out.setdefault(r["batch_id"], []).append(r["n"])
    return list(out.values())


def _next_fit(lengths, budget, last):
    batches, own = [], []
    for n in lengths:
        if n > budget:
            continue
        if sum(own) + n > budget:
            batches.append(own)
            own = []
        own.append(n)
    if own and last == "if_full":
        batches.append(own)
    return [b for b in batches if sum(b) >= 0.75 * budget]


def test_pack_fixed(spark):
    lengths = [400, 300, 250, 900, 100, 700, 350, 50, 800, 150]
    assert _packed(spark, lengths, 1000, last="never") == [[400, 300, 250], [900, 100]]
    assert _packed(spark, lengths, 1000) == [[400, 300, 250], [900, 100], [800, 150]]
    assert _packed(spark, [5000, 10], 1000) == []


@pytest.mark.parametrize("chunk_rows", [3, 11, 40])
def test_pack_in_chunks_is_sequential(spark, chunk_rows):
    lengths = [(i * 7919) % 900 + 1 for i in range(120)] + [2000, 5]
    for last in ("if_full", "never"):
        assert _packed(spark, lengths, 1000, last=last, chunk_rows=chunk_rows) == _next_fit(lengths, 1000, last)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(1, 5))
def test_greedy_groups(lengths, groups):
    out = batching.greedy_groups(lengths, groups, True)
    load = [sum(n for n, g in zip(lengths, out) if g == d) for d in range(groups)]
    assert sum(load) == sum(lengths) and max(load) <= sum(lengths) / groups + max(lengths)


def test_roofline(spark):
    m, c = Model(head_block=1), Cluster()
    row = spark.range(1).select(
        cost.compute_ms(cost.flops(F.lit(1024 * 1024), m, F.lit(1.0)), c).alias("a"), cost.memory_ms(cost.bytes_forward(F.lit(1024), F.lit(1024), m, F.lit(1.0)), c).alias("b"),
        cost.compute_ms(cost.flops(F.lit(1024 * 1024), m, F.lit(0.50048828125)), c).alias("x"), cost.memory_ms(cost.bytes_forward(F.lit(1024), F.lit(1024), m, F.lit(0.50048828125)), c).alias("y"),
    ).first()
    assert [round(v, 10) for v in row] == [0.0153391689, 0.0055924053, 0.0076770743, 0.0027989333]


def test_merge_fixed(spark):
    rows = [(0, 0.5, [1.0]), (0, 2.0, [-1.0]), (0, 1.0, [3.0]), (0, float("-inf"), [9.0]), (1, float("nan"), [2.0]), (1, None, [2.0])]
    got = {r["op"]: r for r in attention.merge(spark.createDataFrame(rows, "op int, lse double, out array<double>"), ["op"], 1).collect()}
    assert abs(got[0]["lse"] - 2.464368784107945) < 1e-12 and abs(got[0]["out"][0] - 0.20538435682077316) < 1e-12
    assert got[1]["lse"] == attention.EMPTY_LSE and got[1]["out"] == [0.0]


def _alternate(n, devices):
    left, out = list(range(n)), {}
    for d in range(devices):
        take, front = -(-n // devices), True
        while take and left:
            out[left.pop(0) if front else left.pop()] = d
            take, front = take - 1, not front
    return out


def test_alternating_closed_form(spark):
    cases = [(n, p) for n in (1, 2, 3, 5, 8, 13, 31, 64) for p in (1, 2, 3, 4, 8, 16)]
    for p in {p for _, p in cases}:
        rows = [(n, b) for n, q in cases if q == p for b in range(n)]
        df = spark.createDataFrame(rows, "n bigint, b bigint")
        for r in df.select("n", "b", placement.alternating(F.col("b"), F.col("n"), p).alias("d")).collect():
            assert r["d"] == _alternate(r["n"], p)[r["b"]]


@pytest.fixture(scope="module")
def small(spark):
    seqs = spark.createDataFrame([(0, i, i, n) for i, n in enumerate([128, 128, 512, 512, 1024, 2048])] + [(1, 0, 9, 700), (1, 1, 10, 65)], "batch_id bigint, seq_id bigint, doc_id bigint, raw_len bigint")
    return Planned(seqs, "causal", Plan(block=128), refine=True)


def test_partition(small):
    parts = small.parts.collect()
    assert len(parts) == small.works.count() + small.groups.select("batch_id", "group_id").distinct().count()
    assert all(0 <= r["device"] < 8 for r in parts)


def test_partition_is_not_worse_than_its_seed(small):
    weights = small.data.drop("bytes").join(placement.nets(small.data).withColumnRenamed("weight", "bytes"), ["batch_id", "is_input", "data_id"])
    one = small.groups.join(small.heuristic[1], ["batch_id", "is_input", "data_id"]).groupBy("batch_id", "group_id").agg(F.min("device").alias("device"))
    seed = small.groups.join(one, ["batch_id", "group_id"]).select("batch_id", "is_input", "data_id", "device")
    km1 = lambda w, d: {r["batch_id"]: r["km1_bytes"] for r in placement.connectivity(w, small.works, d, weights).collect()}
    before, after = km1(small.heuristic[0], seed), km1(*placement.split_placement(small.parts, small.groups))
    assert before and all(after[b] <= before[b] for b in before)


def test_stages_and_transfers(spark, small):
    st_, moves = small.staged
    assert st_.count() == small.works.count() == st_.select("batch_id", "work_id").distinct().count()
    assert moves.where("stage = 0 or src = dst").isEmpty()
    # every input that a work reads is at home there or has arrived by its stage
    home = small.placed[1].where("is_input = 1").select("batch_id", "data_id", "device", F.lit(-1).alias("since"))
    have = home.unionByName(moves.select("batch_id", "data_id", F.col("dst").alias("device"), F.col("stage").alias("since"))).groupBy("batch_id", "data_id", "device").agg(F.min("since").alias("since"))
    need = blocks.work_io(small.works).where("is_input = 1").join(st_, ["batch_id", "work_id"])
    assert need.join(have, ["batch_id", "data_id", "device"], "left").where("since is null or since > stage").isEmpty()


def test_both_ends_keep_to_their_share(spark):
    # two devices on two nodes; each work of device 4 needs two blocks of device 0, which go together
    plan = Plan()
    works = [(0, w, 10.0 - w, 100 + 2 * w, 101 + 2 * w) for w in range(6)]
    w = spark.createDataFrame([(b, i, c, q, k, 500 + i, 600 + i) for b, i, c, q, k in works], "batch_id bigint, work_id bigint, cost_fw double, q_id bigint, kv_id bigint, out_id bigint, lse_id bigint")
    at = spark.createDataFrame([(0, i, 4) for i in range(6)], "batch_id bigint, work_id bigint, device int")
    data = spark.createDataFrame([(0, 1, d, 20) for d in range(100, 112)], "batch_id bigint, is_input int, data_id bigint, bytes bigint")
    home = data.select("batch_id", "is_input", "data_id", F.lit(0).alias("device"))
    for slack in (1.2, 8.0):
        st_, moves = schedule.stages(w, at, home, data, plan, 4, slack)
        share = slack * 240 / 8 / 4
        got: dict = {}
        for r in moves.collect():
            got[r["stage"]] = got.get(r["stage"], 0) + 20
        assert all(v <= share for s, v in got.items() if s < 4) and sum(got.values()) == 240
        assert st_.count() == 6 and (slack > 2) == (1 in got)


@pytest.mark.parametrize("mask", sorted(masks.SEGMENTS))
def test_segments_say_what_rows_say(spark, mask):
    for plan in (Plan(block=7, n_starting=3, l_pretrain=11, blockwise=5, k_local=2, n_answers=3), Plan(block=16, n_starting=40, l_pretrain=2, blockwise=16, k_local=0, n_answers=5), Plan(block=4, n_starting=1, l_pretrain=1, blockwise=3, k_local=1, question_proportion=0.9)):
        seqs = spark.createDataFrame([(0, i, n) for i, n in enumerate([0, 1, 2, 3, 5, 7, 8, 15, 16, 17, 33, 64, 101])], "batch_id bigint, seq_id bigint, raw_len bigint")
        rows = lambda df: sorted(map(tuple, df.select("seq_id", "q_block", "kv_block", "pairs").collect()))
        assert rows(blocks.block_pairs(seqs, mask, plan)) == rows(blocks.pairs_of_rows(masks.ranges(seqs, mask, plan), plan))


def test_instructions(small):
    rows = small.instructions.orderBy("batch_id", "device", "seq_no").collect()
    by: dict = {}
    for r in rows:
        by.setdefault((r["batch_id"], r["device"]), []).append(r)
    for own in by.values():
        assert [r["seq_no"] for r in own] == list(range(len(own))) and own[0]["kind"] in ("memcpy", "launch", "attention")
    assert sum(r["n_items"] for r in rows if r["kind"] == "attention") == small.works.count()


def test_operations_carry_their_operands(small):
    ops = schedule.operations(small.instructions).cache()
    rows = ops.collect()
    works = {(r["batch_id"], r["work_id"]): r for r in small.works.collect()}
    attend = [r for r in rows if r["op"] == "attend"]
    assert {(r["batch_id"], r["work_id"]) for r in attend} == set(works) and len(attend) == len(works)
    assert all((r["data_id"], r["kv_id"], r["out_id"]) == tuple(works[r["batch_id"], r["work_id"]][c] for c in ("q_id", "kv_id", "out_id")) and None not in (r["slot"], r["kv_slot"], r["out_slot"]) for r in attend)
    moves = {(r["batch_id"], r["data_id"], r["src"], r["dst"], r["stage"] - 1) for r in small.staged[1].collect()}
    assert moves and moves == {(r["batch_id"], r["data_id"], r["device"], r["peer"], r["stage"]) for r in rows if r["kind"] == "launch" and r["op"] == "send"} == {(r["batch_id"], r["data_id"], r["peer"], r["device"], r["stage"]) for r in rows if r["kind"] == "launch" and r["op"] == "recv"}
    assert all(r["slot"] is not None for r in rows) and all(r["to_slot"] is not None for r in rows if r["op"] == "copy")
    # a block that a device attends with is copied or received there first, into the slot that the work names
    there = {(r["batch_id"], r["device"], r["data_id"], r["to_slot"] if r["op"] == "copy" else r["slot"]) for r in rows if r["is_input"] == 1 and r["op"] in ("copy", "recv")}
    assert all({(r["batch_id"], r["device"], r["data_id"], r["slot"]), (r["batch_id"], r["device"], r["kv_id"], r["kv_slot"])} <= there for r in attend)
    # a lost receive, and a lost send, show
    assert schedule.unmatched(ops).isEmpty()
    for op in ("recv", "send"):
        one = next(r for r in rows if r["op"] == op and r["kind"] == "launch")
        assert schedule.unmatched(ops.where(~((F.col("op") == op) & (F.col("kind") == "launch") & (F.col("batch_id") == one["batch_id"]) & (F.col("device") == one["device"]) & (F.col("data_id") == one["data_id"])))).count() >= 1


@pytest.mark.parametrize("back", [False, True])
def test_instructions_are_those_of_the_operators(small, back):
    p = small.backward if back else small
    ops = schedule.operations(p.instructions).cache()
    rows = lambda df, *c: sorted(map(tuple, df.select(*c).collect()))
    st_, moves = p.staged
    key = ["batch_id", "device", "is_input", "data_id"]
    assert rows(st_, "batch_id", "work_id", "device", "stage") == rows(ops.where("op = 'attend'"), "batch_id", "work_id", "device", "stage")
    assert rows(moves, "batch_id", "data_id", "src", "dst", "stage") == rows(ops.where("kind = 'wait'"), "batch_id", "data_id", "peer", "device", "stage")
    out = ops.where("kind = 'wait_out'")
    assert rows(p.out_moves, "batch_id", "data_id", "src", "dst") == rows(out, "batch_id", "data_id", "peer", "device") and not out.isEmpty()
    at_home, at_work = schedule.local_slots(p.data, p.placed[1]), schedule.temporary_slots(schedule.live_ranges(st_, p.works), p.data, p.placed[1])
    copies = at_home.where("is_input = 1").select(*key, "slot").join(at_work.select(*key, F.col("slot").alias("to_slot")), key)
    assert rows(copies, *key, "slot", "to_slot") == rows(ops.where("op = 'copy'"), *key, "slot", "to_slot")
    used = ops.where("buffer = 'work' and op <> 'attend'").select(*key, "slot").distinct()
    assert used.join(at_work, [*key, "slot"], "left_anti").isEmpty()


def test_slots_do_not_clash(small):
    live = schedule.live_ranges(small.staged[0], small.works)
    seen: dict = {}
    for r in schedule.temporary_slots(live, small.data, small.placed[1]).collect():
        seen.setdefault((r["batch_id"], r["device"], r["kind"], r["slot"]), []).append((r["first_stage"], r["last_stage"]))
    for spans in seen.values():
        spans.sort()
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_multicast():
    sets = [(0, [1, 2]), (1, [2, 3]), (3, [0])]
    trees = schedule.multicast(sets, 4, 3)
    for (source, targets), tree in zip(sets, trees):
        have = {source: -1}
        for a, b, s in sorted(tree, key=lambda e: e[2]):
            assert a in have and have[a] < s
            have[b] = s
        assert set(targets) <= set(have)


def test_two_phase(spark):
    t = spark.createDataFrame([(0, 1, 7, 0, d) for d in (1, 4, 5, 6)], "batch_id bigint, is_input int, data_id bigint, src int, dst int")
    assert sorted((r["src"], r["dst"], r["phase"]) for r in schedule.two_phase(t, 4).collect()) == [(0, 1, 1), (0, 4, 1), (4, 5, 2), (4, 6, 2)]


def test_allocator():
    a = allocation.Allocator(4096).feed([("malloc", 1, 1000), ("malloc", 2, 500), ("free", 1, 0), ("malloc", 3, 400), ("malloc", 4, 100)])
    assert (a.peak_allocated, a.peak_reserved, a.failures) == (1536, 1536, 0)
    assert allocation.Allocator(1024).feed([("malloc", 1, 600), ("malloc", 2, 600)]).failures == 1
    b = allocation.Allocator(1024).feed([("malloc", 1, 1024), ("free", 1, 0), ("malloc", 2, 300), ("free", 2, 0), ("malloc", 3, 1024)])
    assert (b.failures, b.peak_reserved) == (0, 1024)


def test_tokens_and_loss(spark):
    r = spark.sql("select array(5L, 0L, 7L) as t").select(tokens.labels(F.col("t")).alias("l")).select("l", tokens.loss_mask(F.col("l")).alias("m")).first()
    assert r["l"] == [0, 7, 0] and r["m"] == [0.0, 1.0, 0.0]


def test_padding(spark):
    r = spark.sql("select 8L as a, 9L as b").select(padding.pad_2cp(F.col("a"), 4), padding.pad_2cp_exact(F.col("a"), 4), padding.pad_block(F.col("b"), 8), padding.power_up(F.col("b")), padding.power_down(F.col("b")), padding.is_power(F.col("a"))).first()
    assert tuple(r) == (16, 8, 16, 16, 8, True)


def test_two_level_ranks_cover(spark):
    outer, inner = padding.two_level_rank(F.col("id"), F.lit(64), 4, 2)
    got = spark.range(64).groupBy(outer, inner).count().collect()
    assert len(got) == 8 and all(r["count"] == 8 for r in got)


def test_step_clip_covers_all_keys(spark):
    rows = masks.ranges(from_lengths(spark, [61]).withColumn("padded_len", F.lit(64)), "lambda", Plan(n_starting=4, l_pretrain=9))
    whole = rows.select(F.sum(F.greatest(F.lit(0), F.col("e0") - F.col("s0")) + F.col("e1") - F.col("s1"))).first()[0]
    parts = 0
    for step in range(4):
        c = masks.step_clip(rows, 4, 1, step)
        parts += c.select(F.sum(F.greatest(F.lit(0), F.col("e0") - F.col("s0")) + F.greatest(F.lit(0), F.col("e1") - F.col("s1")))).first()[0]
    assert parts == whole


def test_modality(spark):
    df = mock_multimodal(spark, [[2, 1]], [3])
    got = {r["q_pos"]: (r["s0"], r["e0"]) for r in masks.modality(df, True).collect()}
    assert got == {0: (0, 1), 1: (0, 2), 2: (2, 5), 3: (2, 5), 4: (2, 5), 5: (0, 6)}


def test_udtf(spark):
    masks.register_udtf(spark, "prefix_mask", lambda n, p: [(0, min(n, int(p)), 0, 0)] * n)
    assert [tuple(r) for r in spark.sql("select * from prefix_mask(2, '1')").collect()] == [(0, 0, 1, 0, 0), (1, 0, 1, 0, 0)]


def test_best_in_turn_ties(spark):
    df = spark.createDataFrame([("a", 1, 1, 2.0), ("a", 2, 1, 2.0), ("a", 1, 2, 2.0)], "k string, w int, b int, ms double")
    assert [tuple(r[c] for c in ("k", "w", "b")) for r in experiments.best_in_turn(df, ["w", "b"], "ms", ["k"]).collect()] == [("a", 1, 1)]


def test_attention_matches_direct(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(13, 3))
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "seq_id bigint, pos bigint, q array<double>")
    rows = masks.ranges(from_lengths(spark, [13]), "causal").select("seq_id", "q_pos", "s0", "e0", "s1", "e1")
    pairs = attention.scores(df, df.select("seq_id", "pos", F.col("q").alias("k"), F.col("q").alias("v")), rows, 4, 0.5)
    got = {r["q_pos"]: r for r in attention.merge(attention.partial(pairs, 3), ["seq_id", "q_pos"], 3).collect()}
    for i in range(13):
        s = x[: i + 1] @ x[i] * 0.5
        p = np.exp(s - s.max())
        assert np.allclose(got[i]["out"], p @ x[: i + 1] / p.sum()) and math.isclose(got[i]["lse"], s.max() + math.log(p.sum()))


def test_mock_sequences(spark):
    rows = mock_sequences(spark, 5, 4, 9, 1).collect()
    assert len(rows) == 5 and all(r["tokens"] == [*range(1, len(r["tokens"])), 0] for r in rows)


def test_dominated_without_pairs(spark, sf):
    rows = [("x", 1, 1.0, 5), ("x", 2, 1.0, 5), ("x", 3, 1.0, 6), ("x", 4, 2.0, 5), ("x", 5, 2.0, 4), ("x", 6, 3.0, None), ("x", 7, 0.5, 9), ("y", 8, 9.0, 9), (None, 9, 0.0, 0)]
    rows += [("z", 10 + i, float(i * 37 % 101), i * 53 % 97) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k bigint, a double, b bigint")
    got = sorted(r["k"] for r in experiments.dominated(df, "g", ["a", "b"], chunks=5).collect())
    known = [r for r in rows if None not in r]
    assert got == [k for g, k, a, b in known if any(h == g and c <= a and d <= b and (c < a or d < b) for h, _, c, d in known)]
    assert QUERIES["dominated_configs"](spark, sf).where("k % 50 <> 0").count() > 0


def test_attention_takes_whole_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 9)) / 2
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    x, sf = x.astype(np.float32).astype(float), str(tmp_path)
    out, lse, dv = np.zeros_like(x), np.zeros(40), np.zeros_like(x)
    for a, b in ((0, 32), (32, 40)):  # sequences
        s = np.where(np.tril(np.ones((b - a, b - a), bool)), x[a:b] @ x[a:b].T / 3, -np.inf)
        lse[a:b] = np.log(np.exp(s).sum(1))
        p = np.exp(s - lse[a:b, None])
        out[a:b] = p @ x[a:b]
        dv[a:b] = p.T @ out[a:b]
    for name in ("attn_direct", "attn_blockwise_merge"):
        got = {r["seq_id"] * 32 + r["q_pos"]: r for r in QUERIES[name](spark, sf).collect()}
        assert len(got) == 40 and np.allclose([[got[i][f"o{k}"] for k in range(9)] for i in range(40)], out, atol=2e-6) and np.allclose([got[i]["lse"] for i in range(40)], lse, atol=2e-6)
    grads = {r["seq_id"] * 32 + r["k_pos"]: [r[f"g{i}"] for i in range(9)] for r in QUERIES["attn_gradients"](spark, sf).collect()}
    assert np.allclose([grads[i] for i in range(40)], dv, atol=1e-6)


def test_pack_reasons_add_up(spark, tmp_path):
    n = [0, 3, P.max_len, P.max_len + 1, P.budget, P.budget + 1, *[700] * 30]
    spark.createDataFrame([(i, "w " * k) for i, k in enumerate(n)] + [(99, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["reason"]: (r["n_samples"], r["n_tokens"]) for r in QUERIES["pack_reasons"](spark, str(tmp_path)).collect()}
    assert got["empty"] == (2, 0) and got["over_max_len"] == (3, P.max_len + 2 * P.budget + 2)
    assert sum(k for k, _ in got.values()) == len(n) + 1 and sum(t for _, t in got.values()) == sum(n)


def test_small_functions(spark):
    from pyspark.errors import PySparkException

    from tidewarp.functions import parsing
    from tidewarp.operators import local

    r = spark.sql("select array(5L, 6L, 7L) as t").select(tokens.triangular(F.col("t")).alias("a"), tokens.triangular(F.col("t"), True).alias("b")).first()
    assert r["a"] == [[True, False, False], [True, True, False], [True, True, True]] and r["b"] == [[not x for x in row] for row in r["a"]]
    df = spark.createDataFrame([("Benchmark: a 3/5",), ("Benchmark: total time 3",), ("Benchmarking x",), ("Broken Pipe",), ("fine",)], "x string")
    got = [tuple(r) for r in df.select(parsing.is_progress(F.col("x")), parsing.has_failed(F.col("x"))).collect()]
    assert got == [(True, False), (False, False), (False, False), (False, True), (False, False)]
    assert spark.range(1).select(padding.divided(F.lit(24), 8)).first()[0] == 3
    with pytest.raises(PySparkException, match="does not divide by 8: 25"):
        spark.range(1).select(padding.divided(F.col("id") + 25, 8)).collect()
    rows = spark.createDataFrame([(s, p, p % 3 != 1, 10 * p) for s in (0, 1) for p in range(7)], "seq_id bigint, pos bigint, own boolean, x bigint")
    back = local.scattered(local.gathered(rows, "own").select("seq_id", "dense", "x"), rows, "own", ["x"])
    assert sorted((r["seq_id"], r["pos"], r["x"]) for r in back.collect()) == [(s, p, 10 * p if p % 3 != 1 else None) for s in (0, 1) for p in range(7)]
    runs = spark.createDataFrame([(r, i) for r in ("a", "b") for i in range(5)], "run string, i int")
    assert experiments.iterations(runs, ["run"], "i", 2).count() == 6


def test_multimodal_samples(spark):
    from tidewarp.sources import multimodal_samples

    rows = multimodal_samples(spark, 20, 3, image_size=4, longest=9).collect()
    assert len(rows) == 20 and rows == multimodal_samples(spark, 20, 3, image_size=4, longest=9).collect()
    assert all(r["total_len"] == len(r["tokens"]) == sum(r["text_lengths"]) + 4 * (len(r["text_lengths"]) - 1) and all(0 <= t < 50_000 for t in r["tokens"]) for r in rows)
    assert len({len(r["text_lengths"]) for r in rows}) > 2


def test_dump_and_load(spark, small, tmp_path):
    from tidewarp.plans import planner

    planner.dump(small, str(tmp_path))
    got = planner.load(spark, str(tmp_path))
    assert got["works"].count() == small.works.count() and got["work_device"].count() == small.placed[0].count()
    assert schedule.unmatched(schedule.operations(got["instructions"])).isEmpty()


def test_lengths_come_back(spark, tmp_path):
    from tidewarp.sources import read_lengths, write_lengths

    write_lengths(from_lengths(spark, [5, 9, 1]), str(tmp_path / "l"))
    assert sorted(map(tuple, read_lengths(spark, str(tmp_path / "l")).collect())) == [(0, 5), (1, 9), (2, 1)]


@pytest.mark.parametrize("refine, mask", [(False, "causal"), (True, "lambda")])
def test_instructions_give_attention(spark, refine, mask):
    """The devices' instructions, run on vectors, give what attention over whole sequences gives."""
    from tidewarp.operators import runner

    plan = Plan(block=32, n_starting=8, l_pretrain=70)
    lengths = [(0, 0, 130), (0, 1, 31), (0, 2, 300), (1, 0, 64), (1, 1, 1)]
    seqs = spark.createDataFrame([(b, i, 10 * b + i, n) for b, i, n in lengths], "batch_id bigint, seq_id bigint, doc_id bigint, raw_len bigint")
    p = Planned(seqs, mask, plan, refine)
    dim, m = 3, plan.model
    rng = np.random.default_rng(1)
    q = {(b, i): rng.normal(size=(m.q_blocks, n, m.head_block, dim)) for b, i, n in lengths}
    kv = {(b, i): rng.normal(size=(m.kv_blocks, n, 2 * dim)) for b, i, n in lengths}
    inputs = []
    for r in p.data.where("is_input = 1").collect():
        own = (q if r["kind"] == "Q" else kv)[r["batch_id"], r["seq_id"]][r["head"]][r["block"] * 32 : r["block"] * 32 + r["n_tokens"]]
        inputs.append((r["batch_id"], r["data_id"], own.reshape(len(own), -1).tolist()))
    inputs = spark.createDataFrame(inputs, "batch_id bigint, data_id bigint, value array<array<double>>")
    rows = masks.ranges(seqs, mask, plan).select("batch_id", "seq_id", "q_pos", "s0", "e0", "s1", "e1")
    got = {(r["batch_id"], r["data_id"]): np.array(r["value"]) for r in runner.execute(p.instructions, p.data, schedule.local_slots(p.data, p.placed[1]), inputs, rows, 0.5, plan).collect()}
    out_blocks = p.data.where("kind in ('OUT', 'LSE')").collect()
    assert set(got) == {(r["batch_id"], r["data_id"]) for r in out_blocks}
    ranges = {}
    for r in rows.collect():
        ranges.setdefault((r["batch_id"], r["seq_id"]), {})[r["q_pos"]] = r
    for r in out_blocks:
        key = r["batch_id"], r["seq_id"]
        n = len(q[key][0])
        k = np.arange(n)
        group = kv[key][r["head"] * m.head_block // m.heads_per_group]
        for t in range(r["n_tokens"]):
            i = r["block"] * 32 + t
            own = ranges[key][i]
            seen = (k >= own["s0"]) & (k < own["e0"]) | (k >= own["s1"]) & (k < own["e1"])
            for h in range(m.head_block):
                s = group[seen, :dim] @ q[key][r["head"], i, h] * 0.5
                lse = s.max() + np.log(np.exp(s - s.max()).sum())
                value = got[r["batch_id"], r["data_id"]][t]
                if r["kind"] == "LSE":
                    assert abs(value[h] - lse) < 1e-9
                else:
                    assert np.allclose(value[h * dim : (h + 1) * dim], np.exp(s - lse) @ group[seen, dim:], atol=1e-9)
    if refine:
        return
    # backward: from these outputs and some gradient of them, the gradients that whole sequences give
    back = p.backward
    d_out = {key: rng.normal(size=x.shape) for key, x in q.items()}
    of = {(r["batch_id"], r["kind"], r["seq_id"], r["head"], r["block"]): got[r["batch_id"], r["data_id"]] for r in out_blocks}
    inputs = []
    for r in back.data.where("is_input = 1").collect():
        key, part = (r["batch_id"], r["seq_id"]), slice(r["block"] * 32, r["block"] * 32 + r["n_tokens"])
        if r["kind"] in ("OUT", "LSE"):
            own = of[r["batch_id"], r["kind"], r["seq_id"], r["head"], r["block"]]
        else:
            own = {"Q": q, "KV": kv, "dOUT": d_out}[r["kind"]][key][r["head"]][part]
        inputs.append((r["batch_id"], r["data_id"], own.reshape(len(own), -1).tolist()))
    inputs = spark.createDataFrame(inputs, "batch_id bigint, data_id bigint, value array<array<double>>")
    grads = {(r["batch_id"], r["data_id"]): np.array(r["value"]) for r in runner.execute(back.instructions, back.data, schedule.local_slots(back.data, back.placed[1]), inputs, rows, 0.5, plan).collect()}
    assert schedule.unmatched(schedule.operations(back.instructions)).isEmpty()
    d_q, d_kv = {key: np.zeros_like(x) for key, x in q.items()}, {key: np.zeros_like(x) for key, x in kv.items()}
    for key, x in q.items():
        n = x.shape[1]
        k = np.arange(n)
        own = np.array([[ranges[key][i][c] for c in ("s0", "e0", "s1", "e1")] for i in range(n)])
        seen = (k >= own[:, :1]) & (k < own[:, 1:2]) | (k >= own[:, 2:3]) & (k < own[:, 3:])
        for head in range(m.q_blocks):
            g = head * m.head_block // m.heads_per_group
            kk, vv = kv[key][g][:, :dim], kv[key][g][:, dim:]
            for h in range(m.head_block):
                s = np.where(seen, x[head, :, h] @ kk.T * 0.5, -np.inf)
                w = np.exp(s - s.max(1, keepdims=True))
                w /= w.sum(1, keepdims=True)
                do = d_out[key][head, :, h]
                ds = w * (do @ vv.T - (do * (w @ vv)).sum(1, keepdims=True)) * 0.5
                d_q[key][head, :, h] += ds @ kk
                d_kv[key][g][:, :dim] += ds.T @ x[head, :, h]
                d_kv[key][g][:, dim:] += w.T @ do
    for r in back.data.where("is_input = 0").collect():
        part = slice(r["block"] * 32, r["block"] * 32 + r["n_tokens"])
        want = (d_q if r["kind"] == "dQ" else d_kv)[r["batch_id"], r["seq_id"]][r["head"]][part]
        assert np.allclose(grads[r["batch_id"], r["data_id"]], want.reshape(len(want), -1), atol=1e-9)


def test_runner_names_a_lost_block():
    from tidewarp.operators.runner import Devices

    devices = Devices({(1, 7): "Q"})
    with pytest.raises(KeyError, match="device 2 has nothing in slot 3 of work for block 7"):
        devices.read(2, "work", 1, 7, 3)
    with pytest.raises(KeyError, match="waits for block 7"):
        devices.receive({"device": 2, "peer": 1, "is_input": 1, "data_id": 7, "buffer": "work", "slot": 0}, 0)


def test_hooks(spark, sf):
    """A tokenizer, a mask, a cost model and a solver of one's own."""
    from tidewarp.plans.planner import sequences

    n = {r["doc_id"]: r["raw_len"] for r in sequences(spark, sf, count=lambda text: F.floor(F.length(text) / 4)).limit(5).collect()}
    assert n and all(v is None or v >= 0 for v in n.values())
    seqs = spark.createDataFrame([(0, 0, 0, 300), (0, 1, 1, 64)], "batch_id bigint, seq_id bigint, doc_id bigint, raw_len bigint")
    plan = Plan(block=64)
    rows = masks.full(seqs.select("batch_id", "seq_id", "raw_len").withColumnRenamed("raw_len", "n").withColumn("raw_len", F.col("n")))
    seen = []

    def solver(works, data, groups, seed_work, seed_data, plan):
        seen.append(works.count())
        w = works.select("batch_id", F.lit("work").alias("kind"), F.col("work_id").alias("id"), F.lit(3).alias("device"))
        return w.unionByName(groups.select("batch_id", F.lit("data").alias("kind"), F.col("group_id").alias("id"), F.lit(3).alias("device")).distinct())

    p = Planned(seqs, rows, plan, True, lambda density, plan: (density * 7, density * 9), solver)
    got = p.works.collect()
    assert len(got) == (25 + 1) * plan.model.q_blocks and all(r["density"] == 1 and r["cost_fw"] == 7 and r["cost_bw"] == 9 for r in got)
    assert {r["device"] for r in p.placed[0].collect()} == {3} and seen == [len(got)]
