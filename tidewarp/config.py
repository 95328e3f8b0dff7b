"""Settings of a planning run: model shape, cluster shape, budgets. Plain values; DataFrame operators take them as literals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Model:
    n_heads: int = 8
    n_groups: int = 2
    head_dim: int = 128
    head_block: int = 2
    element_bytes: int = 2

    @property
    def q_blocks(self) -> int:
        return self.n_heads // self.head_block

    @property
    def heads_per_group(self) -> int:
        return self.n_heads // self.n_groups

    @property
    def kv_blocks(self) -> int:
        return (self.q_blocks - 1) * self.head_block // self.heads_per_group + 1


@dataclass(frozen=True)
class Cluster:
    n_nodes: int = 2
    devices_per_node: int = 4
    inter_gbps: float = 400.0
    intra_gbps: float = 4800.0
    inter_latency_ms: float = 0.0
    intra_latency_ms: float = 0.0
    max_tflops: float = 280.0
    mem_gb_s: float = 1500.0

    @property
    def n_devices(self) -> int:
        return self.n_nodes * self.devices_per_node


@dataclass(frozen=True)
class Plan:
    model: Model = Model()
    cluster: Cluster = Cluster()
    max_len: int = 2048
    budget: int = 8192
    block: int = 256
    cp: int = 4
    seed: int = 24
    #: mask parameters
    n_starting: int = 64
    l_pretrain: int = 4096
    question_proportion: float = 0.2
    n_answers: int = 4
    blockwise: int = 256
    k_local: int = 2


DEFAULT = Plan()
