"""Schemas of the plan tables, element sizes, and the identifier arithmetic of blocks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Bytes of an element by declared type.
ELEMENT_BYTES = {"bfloat16": 2, "float16": 2, "float32": 4, "int32": 4, "int64": 8}
#: Kinds of data blocks.
BLOCK_KINDS = ("Q", "dQ", "KV", "dKV", "OUT", "dOUT", "LSE", "WORK")


def _struct(**kinds) -> StructType:
    return StructType([StructField(n, k, True) for n, k in kinds.items()])


DEVICE = _struct(node=IntegerType(), dev=IntegerType())
SEQUENCES = _struct(batch_id=LongType(), seq_id=LongType(), doc_id=LongType(), raw_len=LongType())
MASK_RANGES = _struct(seq_id=LongType(), q_pos=LongType(), range_no=IntegerType(), k_start=LongType(), k_end=LongType())
WORK_BLOCKS = _struct(batch_id=LongType(), work_id=LongType(), seq_id=LongType(), head=IntegerType(), q_block=LongType(), kv_block=LongType())
DATA_BLOCKS = _struct(batch_id=LongType(), data_id=LongType(), is_input=IntegerType(), kind=StringType(), seq_id=LongType(), head=IntegerType(), block=LongType(), n_tokens=LongType(), bytes=LongType())
PLACEMENT = _struct(batch_id=LongType(), item=StringType(), id=LongType(), device=IntegerType())
RESULTS = _struct(
    n_heads=IntegerType(), n_query_groups=IntegerType(), head_dim=IntegerType(), framework=StringType(), benchmark_type=StringType(), mask_type=StringType(),
    window_size=IntegerType(), a2a_degree=IntegerType(), block_size=IntegerType(), dp_degree=IntegerType(), avg_time=StringType(), n_iters=IntegerType(),
)
BATCHES = _struct(batches=ArrayType(ArrayType(IntegerType())), max_dp_degree=IntegerType())
EVENTS = _struct(seq_no=LongType(), kind=StringType(), block=LongType(), bytes=LongType())
RECORDS = _struct(framework=StringType(), metric=DoubleType())


def q_id(offset: Column, head: Column, n: Column, block: Column) -> Column:
    return offset + head * n + block


def kv_id(offset: Column, head: Column, n: Column, block: Column, q_heads: int) -> Column:
    return offset + q_heads * n + head * n + block


def out_id(offset: Column, head: Column, n: Column, block: Column) -> Column:
    return offset + 2 * (head * n + block)


def lse_id(offset: Column, head: Column, n: Column, block: Column) -> Column:
    return out_id(offset, head, n, block) + 1


def element_bytes(kind: Column) -> Column:
    pairs = [x for k, v in ELEMENT_BYTES.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), kind)
