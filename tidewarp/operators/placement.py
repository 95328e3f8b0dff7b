"""Placement of works and data on devices: the closed-form heuristic, hypergraph tables, a balanced partition, quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DEFAULT, Plan
from ..functions.padding import ceil_div
from ..tables import joined
from .batching import greedy_groups
from .blocks import offsets, work_io


# Scale of the compute weights, scale of the net weights, and by how much memory outweighs all compute.
COMPUTE_SCALE, NET_SCALE, MEMORY_FACTOR = 10_000, 45_000, 100


def alternating(block: Column, n: Column, devices: int) -> Column:
    """Device of a block when each device in turn takes ceil(n / devices) blocks, alternately from the front and the back.

    Closed form: a block would be taken from the front at one time and from the back at another; the earlier wins.
    """
    c = ceil_div(n, devices)
    f, r = ceil_div(c, 2), F.floor(c / 2).cast("bigint")
    front = F.floor(block / f).cast("bigint")
    mirrored = n - 1 - block
    back = F.floor(mirrored / F.greatest(r, F.lit(1))).cast("bigint")
    t_front = c * front + 2 * F.pmod(block, f)
    t_back = c * back + 2 * F.pmod(mirrored, F.greatest(r, F.lit(1))) + 1
    return F.when((r == 0) | (t_front < t_back), front).otherwise(back).cast("int")


def heuristic(works: DataFrame, data: DataFrame, sequences: DataFrame, plan: Plan = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(batch_id, work_id, device) and (batch_id, is_input, data_id, device): heads over the head-parallel devices, blocks of a
    sequence over the others; data over all devices."""
    return with_devices(works, sequences, plan).select("batch_id", "work_id", "device"), homes(data, sequences, plan)


def with_devices(works: DataFrame, sequences: DataFrame, plan: Plan = DEFAULT) -> DataFrame:
    """Works with the heuristic's device of each."""
    m, devices = plan.model, plan.cluster.n_devices
    a2a = min(m.q_blocks, devices)
    if devices % a2a or m.q_blocks % a2a:
        raise ValueError("devices and head blocks must divide by the head-parallel degree")
    p2p, per = devices // a2a, m.q_blocks // a2a
    n = offsets(sequences, plan).select("batch_id", "seq_id", "n_blocks")
    device = (alternating(F.col("q_block"), F.col("n_blocks"), p2p) * a2a + F.floor(F.col("head") / per)).cast("int")
    return joined(works, n, ["batch_id", "seq_id"]).withColumn("device", device).drop("n_blocks")


def with_homes(data: DataFrame, sequences: DataFrame, plan: Plan = DEFAULT) -> DataFrame:
    """Data with the heuristic's device of each: the blocks of a sequence over all devices."""
    n = offsets(sequences, plan).select("batch_id", "seq_id", "n_blocks")
    return joined(data, n, ["batch_id", "seq_id"]).withColumn("device", alternating(F.col("block"), F.col("n_blocks"), plan.cluster.n_devices)).drop("n_blocks")


def homes(data: DataFrame, sequences: DataFrame, plan: Plan = DEFAULT) -> DataFrame:
    """(batch_id, is_input, data_id, device): the blocks of a sequence over all devices."""
    return with_homes(data, sequences, plan).select("batch_id", "is_input", "data_id", "device")


def device_load(work_device: DataFrame, works: DataFrame, data_device: DataFrame, data: DataFrame) -> DataFrame:
    """Works, cost, blocks and bytes of every device of a batch."""
    w = joined(works, work_device, ["batch_id", "work_id"]).groupBy("batch_id", "device").agg(F.count("*").alias("n_works"), F.sum("cost_fw").alias("cost"))
    d = joined(data, data_device, ["batch_id", "is_input", "data_id"]).groupBy("batch_id", "device").agg(F.count("*").alias("n_blocks"), F.sum("bytes").alias("bytes"))
    out = joined(w, d, ["batch_id", "device"], "full")
    return out.select("batch_id", "device", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_works", "cost", "n_blocks", "bytes")))


def imbalance(load: DataFrame, devices: int) -> DataFrame:
    """Largest over mean cost of the devices of a batch; devices without work count."""
    return load.groupBy("batch_id").agg((F.max("cost") / (F.sum("cost") / devices)).alias("imbalance"))


def connectivity(work_device: DataFrame, works: DataFrame, data_device: DataFrame, data: DataFrame) -> DataFrame:
    """Per batch the bytes moved: sum over blocks of bytes * (devices that hold or use it - 1)."""
    used = joined(work_io(works), work_device, ["batch_id", "work_id"]).select("batch_id", "is_input", "data_id", "device")
    held = data_device.select("batch_id", "is_input", "data_id", "device")
    parts = used.unionByName(held).groupBy("batch_id", "is_input", "data_id").agg(F.countDistinct("device").alias("parts"))
    return joined(parts, data, ["batch_id", "is_input", "data_id"]).groupBy("batch_id").agg(F.sum(F.col("bytes") * (F.col("parts") - 1)).cast("bigint").alias("km1_bytes"))


def vertices(works: DataFrame, groups: DataFrame) -> DataFrame:
    """Hypergraph vertices: works (compute weight, the largest 10 000) and groups of blocks (memory weight: the smallest group
    outweighs a hundred times all compute). Weights are long integers, so nothing has to be scaled down again."""
    w = Window.partitionBy("batch_id")
    comp = works.select("batch_id", F.lit("work").alias("kind"), F.col("work_id").alias("id"), F.greatest(F.lit(1), F.floor(F.col("cost_fw") * COMPUTE_SCALE / F.max("cost_fw").over(w))).cast("bigint").alias("compute"))
    total = comp.groupBy("batch_id").agg(F.sum("compute").alias("all_compute"))
    mem = groups.groupBy("batch_id", F.col("group_id").alias("id")).agg(F.sum("bytes").alias("bytes"))
    mem = joined(mem.withColumn("least", F.min("bytes").over(w)), total, "batch_id")
    mem = mem.select("batch_id", F.lit("data").alias("kind"), "id", F.lit(0).cast("bigint").alias("compute"), F.ceil(F.col("bytes") * (MEMORY_FACTOR * F.col("all_compute") / F.col("least"))).cast("bigint").alias("memory"))
    return comp.withColumn("memory", F.lit(0).cast("bigint")).select("batch_id", "kind", "id", "compute", "memory").unionByName(mem)


def nets(data: DataFrame) -> DataFrame:
    """A net for each block, weight in proportion to its bytes, the largest 45 000, one at least."""
    w = Window.partitionBy("batch_id")
    return data.select("batch_id", "is_input", "data_id", F.greatest(F.lit(1), F.floor(F.col("bytes") * NET_SCALE / F.max("bytes").over(w))).cast("bigint").alias("weight"))


def pins(works: DataFrame, groups: DataFrame) -> DataFrame:
    """(net, vertex) of the hypergraph: every work that uses a block, and the group that owns it."""
    of_works = work_io(works).select("batch_id", "is_input", "data_id", F.lit("work").alias("kind"), F.col("work_id").alias("id"))
    of_groups = groups.select("batch_id", "is_input", "data_id", F.lit("data").alias("kind"), F.col("group_id").alias("id"))
    return of_works.unionByName(of_groups)


# --- balanced partition -----------------------------------------------------------------------------------------------


def _refine(part: np.ndarray, k: int, members: list[np.ndarray], weight: np.ndarray, of: list[list[int]], comp: np.ndarray, mem: np.ndarray, comp_most: float, mem_most: float, passes: int = 6) -> np.ndarray:
    """Moves of single vertices with positive gain in sum of weight * (parts of a net - 1), within the bounds; ends when a
    pass finds none. Vertices go in order, ties to the lower part."""
    count = np.zeros((len(members), k), np.int64)
    for net, own in enumerate(members):
        np.add.at(count[net], part[own], 1)
    load_c, load_m = np.bincount(part, comp, k), np.bincount(part, mem, k)
    for _ in range(passes):
        moved = 0
        for v in range(len(part)):
            here, own = part[v], of[v]
            if not len(own):
                continue
            c = count[own]
            leaves = (weight[own] * (c[:, here] == 1)).sum()
            enters = (weight[own][:, None] * (c == 0)).sum(0)
            gain = leaves - enters
            gain[here] = 0
            fits = (load_c + comp[v] <= np.maximum(comp_most, load_c[here])) & (load_m + mem[v] <= np.maximum(mem_most, load_m[here]))
            fits[here] = True
            gain = np.where(fits, gain, -1)
            to = int(gain.argmax())
            if gain[to] > 0:
                count[own, here] -= 1
                count[own, to] += 1
                for load, x in ((load_c, comp[v]), (load_m, mem[v])):
                    load[here] -= x
                    load[to] += x
                part[v] = to
                moved += 1
        if not moved:
            break
    return part


def _bound(mem: np.ndarray, comp: np.ndarray, k: int, eps: float) -> tuple[float, float]:
    """Memory: what longest-first greedy needs at most; compute: (1 + eps) of the mean, one more at least."""
    scaled = [int(x) for x in mem]
    load = [0] * k
    for i, g in enumerate(greedy_groups(scaled, k, True)):
        load[g] += scaled[i]
    mean = comp.sum() / k
    return max(load), max((1 + eps) * mean, mean + 1)


def partition(works: DataFrame, data: DataFrame, groups: DataFrame, seed_work: DataFrame, seed_data: DataFrame, plan: Plan = DEFAULT, eps: float = 0.2, inter_factor: float = 5.0) -> DataFrame:
    """batch_id, kind, id, device: works and data groups on devices, two levels (nodes, then the devices of each node).

    Starts from the heuristic placement and refines its connectivity within the balance bounds: never worse than the seed.
    A batch is one group; batches are bounded by the token budget.
    """
    c = plan.cluster
    v = vertices(works, groups)
    seed = seed_work.select("batch_id", F.lit("work").alias("kind"), F.col("work_id").alias("id"), "device").unionByName(
        joined(groups, seed_data, ["batch_id", "is_input", "data_id"]).groupBy("batch_id", "group_id").agg(F.min("device").alias("device")).select("batch_id", F.lit("data").alias("kind"), F.col("group_id").alias("id"), "device")
    )
    p = joined(pins(works, groups), nets(data), ["batch_id", "is_input", "data_id"])
    v = joined(v, seed, ["batch_id", "kind", "id"]).select("batch_id", F.lit("v").alias("row"), "kind", "id", "compute", F.col("memory").cast("double"), "device", F.lit(0).alias("is_input"), F.lit(0).cast("bigint").alias("data_id"), F.lit(0).cast("bigint").alias("weight"))
    p = p.select("batch_id", F.lit("p").alias("row"), "kind", "id", F.lit(0).cast("bigint").alias("compute"), F.lit(0.0).alias("memory"), F.lit(0).alias("device"), "is_input", "data_id", "weight")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vs = pdf[pdf["row"] == "v"].sort_values(["kind", "id"]).reset_index(drop=True)
        place = {x: i for i, x in enumerate(zip(vs["kind"], vs["id"], strict=True))}
        ps = pdf[pdf["row"] == "p"].sort_values(["is_input", "data_id", "kind", "id"])
        members, weight = [], []
        for _, g in ps.groupby(["is_input", "data_id"], sort=True):
            members.append(np.array([place[x] for x in zip(g["kind"], g["id"], strict=True)]))
            weight.append(int(g["weight"].iloc[0]))
        weight = np.array(weight)
        comp, mem = vs["compute"].to_numpy(float), vs["memory"].to_numpy(float)
        device = vs["device"].to_numpy().copy()

        def level(part: np.ndarray, own: np.ndarray, k: int, factor: float) -> np.ndarray:
            index = -np.ones(len(vs), np.int64)
            index[own] = np.arange(len(own))
            inner = [index[m][index[m] >= 0] for m in members]
            of: list[list[int]] = [[] for _ in own]
            for net, m in enumerate(inner):
                for x in m:
                    of[x].append(net)
            mem_most, comp_most = _bound(mem[own], comp[own], k, eps * factor)
            return _refine(part[own].copy(), k, inner, weight, of, comp[own], mem[own], comp_most, mem_most)

        node = device // c.devices_per_node
        if c.n_nodes > 1:
            node = level(node, np.arange(len(vs)), c.n_nodes, inter_factor)
        for d in range(c.n_nodes):
            own = np.flatnonzero(node == d)
            if len(own):
                device[own] = d * c.devices_per_node + level(device % c.devices_per_node, own, c.devices_per_node, 1.0)
        return pd.DataFrame({"batch_id": vs["batch_id"], "kind": vs["kind"], "id": vs["id"], "device": device.astype("int32")})

    return v.unionByName(p).groupBy("batch_id").applyInPandas(run, "batch_id bigint, kind string, id bigint, device int")


def split_placement(parts: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The partition as (work placement, data placement)."""
    w = parts.where("kind = 'work'").select("batch_id", F.col("id").alias("work_id"), "device")
    d = joined(groups, parts.where("kind = 'data'").select("batch_id", F.col("id").alias("group_id"), "device"), ["batch_id", "group_id"]).select("batch_id", "is_input", "data_id", "device")
    return w, d


def repair(parts: DataFrame, works: DataFrame, groups: DataFrame, plan: Plan = DEFAULT) -> DataFrame:
    """Data groups on a node where no work uses them go to that node's device with the least memory."""
    per = plan.cluster.devices_per_node
    w, d = split_placement(parts, groups)
    node = F.floor(F.col("device") / per)
    users = joined(joined(work_io(works), w, ["batch_id", "work_id"]), groups, ["batch_id", "is_input", "data_id"]).select("batch_id", "group_id", node.alias("node")).distinct()
    own = parts.where("kind = 'data'").withColumn("node", node)
    idle = joined(own, users.withColumnRenamed("group_id", "id"), ["batch_id", "id", "node"], "left_anti").select("batch_id", "id", "node")
    bytes_ = joined(groups, d, ["batch_id", "is_input", "data_id"]).groupBy("batch_id", "device").agg(F.sum("bytes").alias("bytes"))
    every = parts.select("batch_id").distinct().select("batch_id", F.explode(F.sequence(F.lit(0), F.lit(plan.cluster.n_devices - 1))).alias("device"))
    every = joined(every, bytes_, ["batch_id", "device"], "left")
    least = every.withColumn("node", node).groupBy("batch_id", "node").agg(F.min(F.struct(F.coalesce("bytes", F.lit(0)).alias("b"), "device"))["device"].alias("to"))
    moves = joined(idle, least, ["batch_id", "node"]).select("batch_id", F.lit("data").alias("kind"), "id", "to")
    return joined(parts, moves, ["batch_id", "kind", "id"], "left").select("batch_id", "kind", "id", F.coalesce("to", "device").cast("int").alias("device"))


def place_data(works: DataFrame, work_device: DataFrame, groups: DataFrame, devices: int) -> DataFrame:
    """Data groups given the works' devices: the candidates are the devices that use every block of the group (of any, if none
    does), the least loaded takes it, groups in order. (batch_id, group_id, device)."""
    use = joined(work_io(works), work_device, ["batch_id", "work_id"]).select("batch_id", "is_input", "data_id", "device").distinct()
    g = joined(groups, use, ["batch_id", "is_input", "data_id"], "left").groupBy("batch_id", "group_id", "is_input", "data_id", "bytes").agg(F.collect_set("device").alias("users"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        load, out = [0] * devices, []
        for gid, rows in pdf.groupby("group_id", sort=True):
            sets = [set(u) for u in rows["users"] if len(u)]
            own = set.intersection(*sets) if sets else set()
            own = own or set().union(*sets) or set(range(devices))
            to = min(own, key=lambda d: (load[d], d))
            load[to] += int(rows["bytes"].sum())
            out.append((rows["batch_id"].iloc[0], gid, to))
        return pd.DataFrame(out, columns=["batch_id", "group_id", "device"])

    return g.groupBy("batch_id").applyInPandas(run, "batch_id bigint, group_id bigint, device int")
