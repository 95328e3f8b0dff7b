"""Queries of the training-data operators for the driver, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, mixing, neardup, pii, quality, quotes, toxicity, urlfilter, vptree


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id.op1,
        "op2_decontaminate": decontaminate.op2,
        "op3_quotes": quotes.op3,
        "op4_vptree": vptree.op4,
        "op5_quality": quality.op5,
        "op6_pii": pii.op6,
        "op7_mixing": mixing.op7,
        "op8_toxicity": toxicity.op8,
        "op9_url_filter": urlfilter.op9,
        "op10_neardup": neardup.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op4_vptree": vptree.OP4_SQL,
        "op9_url_filter": urlfilter.OP9_SQL,
        "op10_neardup": neardup.OP10_SQL,
    }
