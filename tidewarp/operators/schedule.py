"""From a placement to stages, transfers, slots and instructions. One batch is one group of bounded size."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..config import DEFAULT, Plan
from ..functions import cost
from ..tables import joined, written
from .blocks import BACKWARD_IO, FORWARD_IO, backward_of, io_columns, work_io


def required(works: DataFrame, work_device: DataFrame, data_device: DataFrame, inputs: bool = True) -> DataFrame:
    """Transfers that a placement needs: batch_id, is_input, data_id, src, dst — needed (device, block) without the held ones.
    Inputs go from their home to each user; outputs from each producer to their home."""
    io = joined(work_io(works).where(F.col("is_input") == (1 if inputs else 0)), work_device, ["batch_id", "work_id"]).select("batch_id", "is_input", "data_id", "device").distinct()
    home = data_device.withColumnRenamed("device", "home")
    missing = joined(joined(io, data_device, ["batch_id", "is_input", "data_id", "device"], "left_anti"), home, ["batch_id", "is_input", "data_id"])
    src, dst = ("home", "device") if inputs else ("device", "home")
    return missing.select("batch_id", "is_input", "data_id", F.col(src).cast("int").alias("src"), F.col(dst).cast("int").alias("dst"))


def two_phase(transfers: DataFrame, per_node: int) -> DataFrame:
    """Where several devices of a node pull one remote block, the lowest receives it (phase 1) and the others copy from it
    (phase 2). Adds phase."""
    node = lambda c: F.floor(F.col(c) / per_node)
    w = Window.partitionBy("batch_id", "is_input", "data_id", "src", "dst_node").orderBy("dst")
    t = transfers.withColumns({"src_node": node("src"), "dst_node": node("dst")})
    t = t.withColumns({"k": F.row_number().over(w), "first": F.first("dst").over(w)})
    local = (F.col("src_node") == F.col("dst_node")) | (F.col("k") == 1)
    return t.select("batch_id", "is_input", "data_id", F.when(local, F.col("src")).otherwise(F.col("first")).alias("src"), "dst", F.when(local, 1).otherwise(2).alias("phase"))


def sources(transfers: DataFrame, holders: DataFrame, per_node: int) -> DataFrame:
    """For each needed (batch_id, is_input, data_id, dst) the holder to take it from: one of the own node first, then the lowest."""
    h = holders.withColumnRenamed("device", "holder")
    j = joined(transfers.select("batch_id", "is_input", "data_id", "dst").distinct(), h, ["batch_id", "is_input", "data_id"])
    remote = (F.floor(F.col("holder") / per_node) != F.floor(F.col("dst") / per_node)).cast("int")
    return j.groupBy("batch_id", "is_input", "data_id", "dst").agg(F.min(F.struct(remote.alias("remote"), F.col("holder"))).alias("x")).select("batch_id", "is_input", "data_id", "dst", F.col("x.holder").alias("src"), "x.remote")


def volumes(transfers: DataFrame, data: DataFrame, per_node: int) -> DataFrame:
    """Inter-node bytes sent and received by each device."""
    across = joined(transfers.where(F.floor(F.col("src") / per_node) != F.floor(F.col("dst") / per_node)), data.select("batch_id", "is_input", "data_id", "bytes"), ["batch_id", "is_input", "data_id"])
    ends = across.select("batch_id", F.explode(F.array(F.struct(F.col("src").alias("device"), F.col("bytes").alias("sent"), F.lit(0).cast("bigint").alias("received")), F.struct(F.col("dst").alias("device"), F.lit(0).cast("bigint").alias("sent"), F.col("bytes").alias("received")))).alias("x"))
    return ends.select("batch_id", "x.*").groupBy("batch_id", "device").agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"))


def link_costs(transfers: DataFrame, data: DataFrame, plan: Plan = DEFAULT) -> DataFrame:
    """Milliseconds of every transfer."""
    per = plan.cluster.devices_per_node
    t = joined(transfers, data.select("batch_id", "is_input", "data_id", "bytes"), ["batch_id", "is_input", "data_id"])
    return t.withColumn("ms", cost.link_ms(F.col("bytes"), F.col("src") == F.col("dst"), F.floor(F.col("src") / per) == F.floor(F.col("dst") / per), plan.cluster))


def staged(works: Iterable[tuple], homes: Iterable[tuple], plan: Plan, n_stages: int, slack: float) -> tuple[list, list]:
    """`stages` of one batch: of works (work, cost, device, its input blocks ...) in the order of their numbers and of (block, home, bytes),
    the works' (work, device, stage) and the transfers' (block, home, device, stage)."""
    c = plan.cluster
    at: dict[int, list] = defaultdict(list)  # a block's home and bytes
    for x in sorted(set(homes)):
        at[x[0]].append(x)
    pending: dict[int, list] = defaultdict(list)
    total = 0
    seen = set()
    for w, ms, dev, *ids in works:
        own = [x for d in sorted(set(ids)) for x in at.get(d, ())]
        if not own:
            continue
        pending[dev].append((ms, w, [x for x in own if x[1] != dev]))  # what is at home needs no transfer
        for d, home, size in own:
            if home // c.devices_per_node != dev // c.devices_per_node and (d, dev) not in seen:
                seen.add((d, dev))
                total += size
    share = slack * total / c.n_devices / n_stages
    has: dict[int, set[int]] = defaultdict(set)
    out, moves = [], []
    waiting = {dev: [(-ms, w, own) for ms, w, own in mine] for dev, mine in pending.items()}
    for stage in range(n_stages + 1):
        sent, ready = defaultdict(int), {d: 0.0 for d in waiting}
        heaps, parked = {}, {}
        for dev, mine in waiting.items():
            heaps[dev], parked[dev] = mine, defaultdict(list)  # parked: by a block that the work still lacks
            heapq.heapify(mine)
        left: dict[int, dict[int, tuple]] = {dev: {} for dev in waiting}
        open_ = [(0.0, dev) for dev in sorted(waiting)]
        while open_:
            _, dev = heapq.heappop(open_)
            while heaps[dev]:
                cost_, w, own = work = heapq.heappop(heaps[dev])
                fetch = [(d, home, size) for d, home, size in own if d not in has[dev]]
                far: dict[int, int] = defaultdict(int)  # the bytes that each end would send
                for _, home, size in fetch:
                    if home // c.devices_per_node != dev // c.devices_per_node:
                        far[home] += size
                over = any(sent[home] + size > share for home, size in far.items()) or sum(far.values()) + sent[-1 - dev] > share
                if not (stage == 0 and fetch) and (stage == n_stages or not far or not over):
                    break
                left[dev][w] = work  # what is sent only grows: it fits again once a block of it has come, or in the next stage
                for d, _, _ in fetch:
                    parked[dev][d].append(w)
            else:
                continue  # no work of this device fits: it is done with the stage
            ready[dev] -= cost_
            for d, home, _ in fetch:
                has[dev].add(d)
                moves.append((d, home, dev, stage))
                for again in parked[dev].pop(d, []):
                    if again in left[dev]:
                        heapq.heappush(heaps[dev], left[dev].pop(again))
            for home, size in far.items():
                sent[home] += size
                sent[-1 - dev] += size
            out.append((w, dev, stage))
            heapq.heappush(open_, (ready[dev], dev))
        waiting = {dev: list(own.values()) for dev, own in left.items() if own}
    return out, moves


def stages(works: DataFrame, work_device: DataFrame, data_device: DataFrame, data: DataFrame, plan: Plan = DEFAULT, n_stages: int = 4, slack: float = 1.2) -> tuple[DataFrame, DataFrame]:
    """Greedy stage pipeline: (batch_id, work_id, device, stage) and input transfers (batch_id, data_id, src, dst, stage).

    Stage 0 is what needs no transfer. In each later stage every device in turn — the one ready first, lowest index on ties —
    takes its costliest pending work whose transfers, all blocks from one home together, keep both ends within the stage's
    share of the inter-node bytes; the last stage takes the rest. A transfer arrives in the stage of the first work that needs
    it. A work that does not fit is looked at again only when a block that it lacks has come.
    """
    at_home = joined(data_device.where("is_input = 1").withColumnRenamed("device", "home"), data.select("batch_id", "is_input", "data_id", "bytes"), ["batch_id", "is_input", "data_id"])
    at_home = at_home.select(*(F.col(x).cast("bigint") for x in ("batch_id", "data_id", "home", "bytes")))
    inputs = [x for _, is_input, x in io_columns(works) if is_input]
    rows = joined(works.select("batch_id", "work_id", F.col("cost_fw").alias("cost"), *inputs), work_device, ["batch_id", "work_id"])
    rows = rows.select("batch_id", "work_id", F.col("cost").cast("double"), "device", *inputs)
    schema = pa.schema([("batch_id", pa.int64()), ("row", pa.string()), ("id", pa.int64()), ("src", pa.int32()), ("dst", pa.int32()), ("stage", pa.int32())])

    def run(of: pa.Table, homes: pa.Table) -> pa.Table:
        if not of.num_rows:
            return schema.empty_table()
        batch = of["batch_id"][0].as_py()
        rows = sorted(zip(*(of[x].to_pylist() for x in ("work_id", "cost", "device", *inputs)), strict=True))
        done, moved = staged(rows, zip(*(homes[x].to_pylist() for x in ("data_id", "home", "bytes")), strict=True), plan, n_stages, slack)
        out = [(batch, "work", w, dev, dev, stage) for w, dev, stage in done] + [(batch, "move", *x) for x in moved]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else schema.empty_table()

    # works and transfers come of one run: written once, not made for each
    got = written(rows.groupBy("batch_id").cogroup(at_home.groupBy("batch_id")).applyInArrow(run, "batch_id bigint, row string, id bigint, src int, dst int, stage int"), "stages")
    return got.where("row = 'work'").select("batch_id", F.col("id").alias("work_id"), F.col("dst").alias("device"), "stage"), got.where("row = 'move'").select("batch_id", F.lit(1).alias("is_input"), F.col("id").alias("data_id"), "src", "dst", "stage")


def stage_volumes(moves: DataFrame, data: DataFrame, per_node: int) -> DataFrame:
    """Per batch the sum over stages of the largest inter-node volume that a node sends or receives."""
    across = joined(moves.where(F.floor(F.col("src") / per_node) != F.floor(F.col("dst") / per_node)), data.select("batch_id", "is_input", "data_id", "bytes"), ["batch_id", "is_input", "data_id"])
    ends = across.select("batch_id", "stage", "bytes", F.explode(F.array(F.struct(F.lit("s").alias("way"), F.floor(F.col("src") / per_node).alias("node")), F.struct(F.lit("r").alias("way"), F.floor(F.col("dst") / per_node).alias("node")))).alias("x"))
    top = ends.groupBy("batch_id", "stage", "x.way", "x.node").agg(F.sum("bytes").alias("bytes")).groupBy("batch_id", "stage").agg(F.max("bytes").alias("bytes"))
    return top.groupBy("batch_id").agg(F.sum("bytes").alias("bytes"))


def stage_times(work_stages: DataFrame, works: DataFrame, moves: DataFrame, data: DataFrame, plan: Plan = DEFAULT) -> DataFrame:
    """Simulated time: a stage lasts as long as its slowest device computes or the next stage's transfers take."""
    comp = joined(work_stages, works.select("batch_id", "work_id", "cost_fw"), ["batch_id", "work_id"]).groupBy("batch_id", "stage", "device").agg(F.sum("cost_fw").alias("ms")).groupBy("batch_id", "stage").agg(F.max("ms").alias("compute_ms"))
    comm = link_costs(moves, data, plan).groupBy("batch_id", "stage", "dst").agg(F.sum("ms").alias("ms")).groupBy("batch_id", F.col("stage").alias("for_stage")).agg(F.max("ms").alias("comm_ms"))
    t = joined(comp, comm.withColumn("stage", F.col("for_stage") - 1), ["batch_id", "stage"], "full")
    ms = F.greatest(F.coalesce("compute_ms", F.lit(0.0)), F.coalesce("comm_ms", F.lit(0.0)))
    w = Window.partitionBy("batch_id").orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("batch_id", "stage", F.coalesce("compute_ms", F.lit(0.0)).alias("compute_ms"), F.coalesce("comm_ms", F.lit(0.0)).alias("comm_ms"), ms.alias("stage_ms")).withColumn("end_ms", F.sum("stage_ms").over(w))


def live_ranges(work_stages: DataFrame, works: DataFrame) -> DataFrame:
    """First and last stage in which a device uses a block."""
    return joined(work_io(works), work_stages, ["batch_id", "work_id"]).groupBy("batch_id", "device", "is_input", "data_id").agg(F.min("stage").alias("first_stage"), F.max("stage").alias("last_stage"))


def local_slots(data: DataFrame, data_device: DataFrame) -> DataFrame:
    """Slot of each local block on its device and kind, in the order (head, sequence, block), with its start in tokens."""
    w = Window.partitionBy("batch_id", "device", "kind").orderBy("head", "seq_id", "block")
    d = joined(data, data_device, ["batch_id", "is_input", "data_id"])
    start = F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    return d.select("batch_id", "device", "kind", "is_input", "data_id", "n_tokens", (F.row_number().over(w) - 1).cast("bigint").alias("slot"), start.alias("start"))


def free_slots(rows: Iterable[tuple]) -> list[int]:
    """The slots of `temporary_slots` for one batch's (device, kind, since, last stage, is_input), sorted by since and block in a device and kind."""
    slots, last_own = [], None
    for *own, since, last, is_input in rows:
        if own != last_own:
            last_own, n, free, held = own, 0, [], []  # held: by the last stage, inputs only
        while held and held[0][0] < since:
            heapq.heappush(free, heapq.heappop(held)[1])
        if free:
            k = heapq.heappop(free)
        else:
            k, n = n, n + 1
        if is_input:
            heapq.heappush(held, (last, k))
        slots.append(k)
    return slots


def temporary_slots(live: DataFrame, data: DataFrame, data_device: DataFrame | None = None) -> DataFrame:
    """First free slot for each block of a device and kind, by the stage from which it is held, and id.

    An input that comes from another device is on its way during the stage before it is used; one that is at home there
    (data_device) is copied before the first stage. A slot is free again after the last stage of an input; an output stays
    until the outputs are sent."""
    rows = joined(live, data.select("batch_id", "is_input", "data_id", "kind"), ["batch_id", "is_input", "data_id"])
    local = F.lit(False)
    if data_device is not None:
        rows = joined(rows, data_device.select("batch_id", "is_input", "data_id", F.col("device").alias("home")), ["batch_id", "is_input", "data_id"], "left")
        local = F.coalesce(F.col("home") == F.col("device"), F.lit(False))
    rows = rows.withColumn("since", F.when(F.col("is_input") == 0, F.col("first_stage")).when(local, -1).otherwise(F.col("first_stage") - 1)).drop("home")

    types = dict.fromkeys(("batch_id", "data_id"), "bigint") | {"kind": "string"}
    rows = rows.select(*(F.col(x).cast(types.get(x, "int")).alias(x) for x in ("batch_id", "device", "kind", "is_input", "data_id", "first_stage", "last_stage", "since")))

    def run(of: pa.Table) -> pa.Table:
        of = of.sort_by([(x, "ascending") for x in ("device", "kind", "since", "data_id")])
        slots = free_slots(zip(*(of[x].to_pylist() for x in ("device", "kind", "since", "last_stage", "is_input")), strict=True))
        return of.drop_columns("since").append_column("slot", pa.array(slots, pa.int32()))

    return rows.groupBy("batch_id").applyInArrow(run, "batch_id bigint, device int, kind string, is_input int, data_id bigint, first_stage int, last_stage int, slot int")


def buffer_sizes(slots: DataFrame, local: DataFrame) -> DataFrame:
    """Per device and kind: tokens of the local buffer, slots of the temporary one."""
    a = local.groupBy("batch_id", "device", "kind").agg(F.sum("n_tokens").alias("local_tokens"))
    b = slots.groupBy("batch_id", "device", "kind").agg((F.max("slot") + 1).alias("slots"))
    return joined(a, b, ["batch_id", "device", "kind"], "full").select("batch_id", "device", "kind", F.coalesce("local_tokens", F.lit(0)).cast("bigint").alias("local_tokens"), F.coalesce("slots", F.lit(0)).cast("bigint").alias("slots"))


# Order of instruction kinds inside a stage.
ORDER = {"memcpy": 0, "wait": 1, "launch": 2, "attention": 3, "attention_backward": 3, "merge": 4, "sum": 4, "send_out": 5, "wait_out": 6, "reduce": 7, "sum_out": 7}


#: One operation of an instruction: send, recv, copy, attend, merge, sum or reduce; the block and its slot in the local, work
#: or in buffer; the other device; a copy's target slot; a work's key and output blocks, backward its outputs, log-sum-exp and
#: gradients; the stage whose partial a merge or sum adds to.
OPERATION = ["op", "is_input", "data_id", "buffer", "slot", "peer", "to_slot", "work_id", "kv_id", "kv_slot", "out_id", "out_slot", "from_stage", "o_slot", "l_slot", "do_slot", "dq_id", "dq_slot", "dkv_id", "dkv_slot"]
_OP_TYPES = dict.fromkeys(OPERATION, "bigint") | {"op": "string", "buffer": "string", "is_input": "int", "peer": "int", "from_stage": "int"}
_INSTRUCTION = f"batch_id bigint, device int, kind string, stage int, n_items bigint, operations array<struct<{', '.join(f'{k}: {v}' for k, v in _OP_TYPES.items())}>>, seq_no bigint"
# Names in the order of their bytes, so that their numbers sort as they do; the stage of the outputs' transfers; null.
_OPS, _BUFFERS = ["attend", "copy", "merge", "recv", "reduce", "send", "sum"], ["in", "local", "work"]
LAST, _NULL = 1_000_000, np.iinfo(np.int64).min
#: What a work reads and writes, as an operation names it: its block's column, block and slot in the operation.
_READS = [("q_id", "data_id", "slot"), ("kv_id", "kv_id", "kv_slot")]
_BACK_READS = [*_READS, ("o_id", None, "o_slot"), ("l_id", None, "l_slot"), ("do_id", None, "do_slot")]
_WRITES, _BACK_WRITES = [("out_id", "out_id", "out_slot")], [("dq_id", "dq_id", "dq_slot"), ("dkv_id", "dkv_id", "dkv_slot")]


def _firsts(*sorted_: np.ndarray) -> np.ndarray:
    """Where a new value, or combination of values, begins."""
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in sorted_], axis=0)
    return new


def _within(new: np.ndarray) -> np.ndarray:
    """Number of each row since the last new one."""
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values at the wanted ones of sorted keys; _NULL where there is none."""
    if not len(keys):
        return np.full(len(wanted), _NULL)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], _NULL)


def batch_operations(works: dict[str, np.ndarray], data: dict[str, np.ndarray], plan: Plan, n_stages: int, slack: float, back: bool) -> np.ndarray:
    """The operations of one batch's devices, a row each: device, stage, order of the instruction's kind, and OPERATION."""
    works = {c: x[np.argsort(works["work_id"], kind="stable")] for c, x in works.items()}
    io = BACKWARD_IO if back else FORWARD_IO
    reads, writes = (_BACK_READS, _BACK_WRITES) if back else (_READS, _WRITES)
    devices = int(max(works["device"].max(), data["device"].max())) + 1
    blocks, first, of = np.unique(2 * data["data_id"] + data["is_input"], return_index=True, return_inverse=True)
    is_input, data_id, kind = blocks & 1, blocks >> 1, data["kind"][first]
    index = {c: _found(blocks, np.arange(len(blocks)), 2 * works[c] + i) for _, i, c in io}
    if any((x == _NULL).any() for x in index.values()):
        raise ValueError("a work names a block that the data lack")

    # local slots, in the order (head, sequence, block) of a device and kind; a pair is a block on a device
    order = np.lexsort([data[x] for x in ("block", "seq_id", "head", "kind", "device")])
    slot = np.empty(len(order), np.int64)
    slot[order] = _within(_firsts(data["device"][order], data["kind"][order]))
    order = np.lexsort((data["device"], of))
    home_block, home_device = of[order], data["device"][order]
    home_pairs, home_slots = home_block * devices + home_device, slot[order]

    rows = zip(range(len(works["work_id"])), works["cost"].tolist(), works["device"].tolist(), *(works[c].tolist() for _, i, c in io if i), strict=True)
    inputs = data["is_input"] == 1
    done, moved = staged(rows, zip(*(data[x][inputs].tolist() for x in ("data_id", "device", "bytes")), strict=True), plan, n_stages, slack)
    work, at, stage = np.array(done, np.int64).reshape(-1, 3).T
    m_id, m_src, m_dst, m_stage = np.array(moved, np.int64).reshape(-1, 4).T

    # work slots, by the stages in which a device uses a block
    pairs, times = np.concatenate([index[c][work] * devices + at for _, _, c in io]), np.tile(stage, len(io))
    order = np.lexsort((times, pairs))
    pairs, times = pairs[order], times[order]
    new = _firsts(pairs)
    last_stage = times[np.append(new[1:], True)] if len(pairs) else times
    used, first_stage = pairs[new], times[new]
    block, device = used // devices, used % devices
    since = np.where(is_input[block] == 0, first_stage, np.where(np.isin(used, home_pairs), -1, first_stage - 1))
    order = np.lexsort((data_id[block], since, kind[block], device))
    used_slots = np.empty(len(used), np.int64)
    used_slots[order] = free_slots(zip(*(x[order].tolist() for x in (device, kind[block], since, last_stage, is_input[block])), strict=True))
    at_home, at_work = (lambda x: _found(home_pairs, home_slots, x)), (lambda x: _found(used, used_slots, x))

    parts = []

    def add(kind: str, device: np.ndarray, stage, op: str, buffer: str, **columns) -> None:
        part = np.full((3 + len(OPERATION), len(device)), _NULL)
        for row, x in ((0, device), (1, stage), (2, ORDER[kind]), *((3 + OPERATION.index(c), x) for c, x in columns.items() if c), (3, _OPS.index(op)), (6, _BUFFERS.index(buffer))):
            part[row] = x
        parts.append(part)

    slots = at_work(home_pairs)
    both = (is_input[home_block] == 1) & (slots != _NULL)
    add("memcpy", home_device[both], -1, "copy", "local", is_input=1, data_id=data_id[home_block[both]], slot=home_slots[both], to_slot=slots[both])
    block = np.searchsorted(blocks, 2 * m_id + 1)
    receive = {"is_input": 1, "data_id": m_id, "slot": at_work(block * devices + m_dst), "peer": m_src}
    add("wait", m_dst, m_stage, "recv", "work", **receive)
    add("launch", m_dst, m_stage - 1, "recv", "work", **receive)
    add("launch", m_src, m_stage - 1, "send", "local", is_input=1, data_id=m_id, slot=at_home(block * devices + m_src), peer=m_dst)
    operands = {"work_id": works["work_id"][work]}
    for c, name, own in reads + writes:
        operands |= {name: works[c][work], own: at_work(index[c][work] * devices + at)}
    add("attention_backward" if back else "attention", at, stage, "attend", "work", is_input=1, **{c: x for c, x in operands.items() if c})
    # what a device has written in a stage before is added to
    pairs, times = np.concatenate([index[c][work] * devices + at for c, _, _ in writes]), np.tile(stage, len(writes))
    order = np.lexsort((times, pairs))
    pairs, times = pairs[order], times[order]
    new = _firsts(pairs, times)
    pairs, times = pairs[new], times[new]
    again = np.flatnonzero(~_firsts(pairs))
    add("sum" if back else "merge", pairs[again] % devices, times[again], "sum" if back else "merge", "work", is_input=0, data_id=data_id[pairs[again] // devices], slot=at_work(pairs[again]), from_stage=times[again - 1])

    # outputs go to their homes
    out = np.unique(np.concatenate([index[c] * devices + works["device"] for _, i, c in io if not i]))
    out = out[~np.isin(out, home_pairs)]
    begin, end = (np.searchsorted(home_block, out // devices, side) for side in ("left", "right"))
    out = np.repeat(out, end - begin)
    src, block = out % devices, out // devices
    dst = home_device[np.repeat(begin, end - begin) + _within(_firsts(out))]
    order = np.lexsort((src, data_id[block], dst))
    src, dst, block, out = src[order], dst[order], block[order], out[order]
    receive = {"is_input": 0, "data_id": data_id[block], "slot": _within(_firsts(dst)), "peer": src}
    add("send_out", dst, LAST, "recv", "in", **receive)
    add("send_out", src, LAST, "send", "work", is_input=0, data_id=data_id[block], slot=at_work(out), peer=dst)
    add("wait_out", dst, LAST, "recv", "in", **receive)
    op, reduction = ("sum", "sum_out") if back else ("reduce", "reduce")
    add(reduction, dst, LAST, op, "in", **receive)
    own = np.unique(block * devices + dst)
    own = own[at_work(own) != _NULL]
    add(reduction, own % devices, LAST, op, "work", is_input=0, data_id=data_id[own // devices], slot=at_work(own))
    return np.concatenate(parts, axis=1)


def instructions(works: DataFrame, data: DataFrame, plan: Plan = DEFAULT, n_stages: int = 4, slack: float = 1.2, back: bool = False) -> DataFrame:
    """Instruction rows of each device, numbered in order, with their operations: local copies in; for each stage wait for its
    transfers, launch those of the next, attention, merge of partial results; transfers of outputs, wait, and the last reduction.
    n_items counts the blocks (attention: works) of an instruction; a reduction has one operation for each source of a block.

    Of forward works and data with their devices. Stages, slots and the transfers of outputs are those of `stages`, `local_slots`,
    `temporary_slots` and `required`: a batch is bounded, so one task makes all of it from its rows, and no table between is
    shuffled or joined. back: of the backward pass; attention gives gradients, and partial gradients are summed instead of merged."""
    integers = ("work_id", "device", *(c for _, _, c in FORWARD_IO))
    w = works.select("batch_id", F.col("cost_fw").cast("double").alias("cost"), *(F.col(c).cast("bigint") for c in integers))
    d = data.select("batch_id", "kind", *(F.col(c).cast("bigint") for c in ("data_id", "is_input", "seq_id", "head", "block", "bytes", "device")))
    kinds = {k: name for name, k in ORDER.items() if name not in (("attention", "merge", "reduce") if back else ("attention_backward", "sum", "sum_out"))}
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [pa.field(c, arrow[t]) for c, t in _OP_TYPES.items()]
    schema = pa.schema([("batch_id", pa.int64()), ("device", pa.int32()), ("kind", pa.string()), ("stage", pa.int32()), ("n_items", pa.int64()), ("operations", pa.list_(pa.field("element", pa.struct(fields)))), ("seq_no", pa.int64())])
    names = {"op": _OPS, "buffer": _BUFFERS}

    def run(w: pa.Table, d: pa.Table) -> pa.Table:
        if not w.num_rows:
            return schema.empty_table()
        batch = w["batch_id"][0].as_py()
        of_w, of_d = ({c: x[c].to_numpy() for c in x.column_names if c not in ("batch_id", "kind")} for x in (w, d))
        of_d["kind"] = np.array(d["kind"].to_pylist(), str)
        if back:
            of_w, of_d = backward_of(of_w, of_d)
        ops = batch_operations(of_w, of_d, plan, n_stages, slack, back)
        ops = ops[:, np.lexsort(ops[::-1])]
        device, stage, rank, *columns = ops
        new = _firsts(device, stage, rank)
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(new)))
        blocks = np.add.reduceat(_firsts(device, stage, rank, columns[2]).astype(np.int64), begin)
        n = np.where(rank[begin] == ORDER["reduce"], blocks, n)
        arrays = [pa.array(names[f.name]).take(pa.array(x)) if f.name in names else pa.array(x, f.type, mask=x == _NULL) for f, x in zip(fields, columns, strict=True)]
        operations = pa.ListArray.from_arrays(pa.array(np.append(begin, len(new)), pa.int32()), pa.StructArray.from_arrays(arrays, fields=fields))
        own = [np.full(len(begin), batch), device[begin], [kinds[k] for k in rank[begin].tolist()], stage[begin], n, operations.cast(schema.field("operations").type), _within(_firsts(device[begin]))]
        return pa.Table.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(own, schema, strict=True)], schema=schema)

    return w.groupBy("batch_id").cogroup(d.groupBy("batch_id")).applyInArrow(run, _INSTRUCTION)


def operations(instructions: DataFrame) -> DataFrame:
    """A row for each operation of the instructions."""
    return instructions.select("batch_id", "device", "seq_no", "kind", "stage", F.explode("operations").alias("x")).select("batch_id", "device", "seq_no", "kind", "stage", "x.*")


def unmatched(operations: DataFrame) -> DataFrame:
    """Sends of a device's own operations joined to the receives of the other's, on (block, source, target, stage, occurrence):
    those whose other end is missing. Empty if all meet."""
    key = ["batch_id", "is_input", "data_id", "src", "dst", "stage"]
    w = Window.partitionBy(*key).orderBy("seq_no")
    rows = operations.where("kind in ('launch', 'send_out')")
    side = lambda op, src, dst: rows.where(F.col("op") == op).withColumns({"src": F.col(src), "dst": F.col(dst)}).withColumn("k", F.row_number().over(w)).select(*key, "k", F.lit(1).alias(op))
    return joined(side("send", "device", "peer"), side("recv", "peer", "device"), [*key, "k"], "full").where("send is null or recv is null")


def multicast(terminals: list[tuple[int, list[int]]], n_nodes: int, n_stages: int, costs: list[float] | None = None) -> list[list[tuple[int, int, int]]]:
    """A tree (source, target, stage) for each (source, targets), over nodes, that keeps the largest load of a node in a stage
    low: exact by bounded search for up to four nodes and three sets, else greedy by the load each edge adds."""
    costs = costs or [1.0] * len(terminals)
    edges = [(k, t) for k, (_, own) in sorted(enumerate(terminals), key=lambda x: -costs[x[0]]) for t in own if t != terminals[k][0]]
    best: list = [float("inf"), None]
    exact = n_nodes <= 4 and len(edges) <= 6

    def search(i: int, chosen: list, load: dict) -> bool:
        top = max(load.values(), default=0.0)
        if top >= best[0]:
            return False
        if i == len(edges):
            best[:] = [top, list(chosen)]
            return True
        k, target = edges[i]
        have = {terminals[k][0]: -1} | {t: s for kk, _, t, s in chosen if kk == k}
        options = []
        for node, since in have.items():
            for stage in range(since + 1, n_stages):
                cost_ = max(load.get(("s", node, stage), 0.0), load.get(("r", target, stage), 0.0)) + costs[k]
                options.append((cost_, stage, node))
        for _, stage, node in sorted(options):
            for key in (("s", node, stage), ("r", target, stage)):
                load[key] = load.get(key, 0.0) + costs[k]
            done = search(i + 1, [*chosen, (k, node, target, stage)], load)
            for key in (("s", node, stage), ("r", target, stage)):
                load[key] -= costs[k]
            if done and not exact:
                return True
        return False

    search(0, [], {})
    if best[1] is None:
        return []
    return [[(a, b, s) for kk, a, b, s in best[1] if kk == k] for k in range(len(terminals))]
