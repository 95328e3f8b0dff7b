"""Tables that grow with the corpus are joined by sorting and merging, not collected in the driver for a broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from tidewarp.operators import blocks, local, masks
from tidewarp.plans.catalogue import QUERIES
from tidewarp.plans.planner import plan_corpus

#: Queries that sent tables of any size through the driver.
NAMES = ["local_rows", "mask_spans", "backward_transfers", "device_load", "compute_imbalance", "device_report", "km1_volume", "partition_check", "partition_quality", "slot_layout", "block_table", "stage_volumes", "pipeline_time", "pipeline_trace", "partial_gradients", "buffer_sizes", "slot_check", "instr_counts", "instructions", "send_recv_match", "backward_blocks", "backward_instr_counts"]


def plans(spark) -> dict[int, str]:
    """The plan of every execution so far."""
    seen = spark._jsparkSession.sharedState().statusStore().executionsList()
    return {seen.apply(i).executionId(): seen.apply(i).physicalPlanDescription() for i in range(seen.size())}


@pytest.mark.parametrize("name", NAMES)
def test_no_table_through_the_driver(spark, sf, tmp_path, name):
    before = max(plans(spark), default=-1)
    QUERIES[name](spark, sf).write.parquet(str(tmp_path / "out"))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    own = [text for k, text in plans(spark).items() if k > before]
    # what may be broadcast are the packing's numbers for each chunk of its order, and the number of its last batch
    assert own and not [x for text in own for x in re.findall(r"Broadcast\w*Join[^\n]*\n(Left keys \[\d+\]: \[(?!chunk#).*)", text)]


@pytest.mark.parametrize("name", ["instr_counts", "instructions", "backward_instr_counts"])
def test_instructions_join_no_works_or_blocks(spark, sf, tmp_path, name):
    before = max(plans(spark), default=-1)
    QUERIES[name](spark, sf).write.parquet(str(tmp_path / "out"))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    own = [text for k, text in plans(spark).items() if k > before]
    assert sum("FlatMapCoGroupsIn" in text for text in own) == 1
    assert not [x for text in own for x in re.findall(r"Left keys \[\d+\]: \[[^\]]*(?:work_id|data_id)#[^\n]*", text)]


def test_stages_are_made_once(spark, sf):
    p = plan_corpus(spark, sf)
    assert p.works.count()  # written before
    before = max(plans(spark))
    work_stages, moves = p.staged
    assert work_stages.count() and moves.count()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sum(bool(re.search(r"FlatMap(Co)?GroupsIn", text)) for k, text in plans(spark).items() if k > before) == 1


def test_backward_blocks_need_no_works(spark, sf):
    p = plan_corpus(spark, sf)
    assert p.backward.data.count() and "works" not in p.__dict__


def test_spans_over_missing_key_blocks(spark):
    works = spark.createDataFrame([(0, 0, 0, 0, k) for k in (0, 1, 3)], "batch_id bigint, seq_id bigint, head int, q_block bigint, kv_block bigint")
    ranges = [(0, 1024), (300, 400), (512, 700), (100, 600), (5, 5), (600, 800)]
    rows = spark.createDataFrame([(0, 0, i, s, e) for i, (s, e) in enumerate(ranges)], "batch_id bigint, seq_id bigint, q_pos bigint, s0 bigint, e0 bigint")
    got = {r["q_pos"]: (r["start"], r["end"], r["gaps"]) for r in blocks.mask_spans(works, rows).collect()}
    assert got == {0: (0, 1024, 1), 1: (300, 400, 0), 3: (100, 512, 0), 5: (768, 800, 0)}


def test_rows_and_whole_sequences_agree(spark, sf):
    p = plan_corpus(spark, sf)
    seqs = p.seqs.where("batch_id = 0").select("batch_id", "seq_id", "raw_len")
    tokens = seqs.select("batch_id", "seq_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("raw_len") - 1)).alias("pos"))
    key = ["batch_id", "seq_id", "block", "device", "pos"]
    a, b = (sorted(map(tuple, local.local_rows(x, p.data, p.placed[1]).select(*key).collect())) for x in (tokens, seqs))
    assert a == b and a
    spans = lambda *x, **y: sorted(map(tuple, blocks.mask_spans(p.works.where("batch_id = 0"), *x, **y).select("seq_id", "q_pos", "start", "end", "gaps").collect()))
    for mask in ("causal", "lambda"):
        assert spans(mask, sequences=seqs) == spans(masks.ranges(seqs, mask))
