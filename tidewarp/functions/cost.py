"""Roofline and link costs in milliseconds, buffer bytes, ring volumes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import Cluster, Model


def flops(pairs: Column, model: Model, density: Column, backward: bool = False) -> Column:
    """pairs: sum of q * k over the blocks of a work."""
    return 4 * pairs.cast("double") * model.n_heads * model.head_dim * density * (2.5 if backward else 1.0)


def bytes_forward(q: Column, k: Column, model: Model, density: Column) -> Column:
    """All of k and v is read once for each 64 rows of q."""
    return F.floor((q + 63) / 64) * k.cast("double") * (2 * model.n_groups * model.head_dim) * density


def bytes_backward(q: Column, k: Column, model: Model, density: Column, heads: int | None = None) -> Column:
    """dO once, and four tensors of q for each 128 rows of k; the division comes after the product."""
    size = 2 * (model.n_groups if heads is None else heads) * model.head_dim
    q = q.cast("double")
    return (q * size + F.floor(4 * q * (k + 127) / 128) * size) * density


def compute_ms(flops_: Column, cluster: Cluster) -> Column:
    return flops_ / F.lit(cluster.max_tflops) * F.lit(1e-9)


def memory_ms(bytes_: Column, cluster: Cluster) -> Column:
    return bytes_ / F.lit(cluster.mem_gb_s) * F.lit(1e-6)


def link_ms(bytes_: Column, same_device: Column, same_node: Column, cluster: Cluster) -> Column:
    per = lambda gbps: bytes_ * 8 / F.lit(1e6) / F.lit(gbps)
    return F.when(same_device, 0.0).when(same_node, cluster.intra_latency_ms + per(cluster.intra_gbps)).otherwise(cluster.inter_latency_ms + per(cluster.inter_gbps))


def buffer_bytes(name: Column, tokens: Column) -> Column:
    """Bytes of a buffer by its name, one head of 128; `Q` and `Out` are looked for first."""
    return F.when(name.contains("Q") | name.contains("Out"), tokens * 256).when(name.contains("KV"), tokens * 512).when(name.contains("LSE"), tokens * 4).cast("bigint")


def ring_volume_mb(tokens: Column, cp: int, kv_heads: int = 2, head_dim: int = 128, element: int = 2) -> Column:
    """What a ring of cp ranks sends: every rank's keys and values travel cp - 1 steps."""
    per_token = 2 * kv_heads * head_dim * element
    return per_token * (cp - 1) * cp * (tokens / cp) / F.lit(1e6)


def log_sigmoid(x: Column) -> Column:
    return -F.log1p(F.exp(-x))
