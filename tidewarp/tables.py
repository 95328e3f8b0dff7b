"""Cutting lineage: tables written once into the folder that all executors share, and read back."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PLACE = "_written_at"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Where none is set, a temporary folder of its own if driver and executors
    are one process, as in tests; elsewhere other executors could not read that, so that it is refused."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    made = sc._jsc.sc().getCheckpointDir()
    if not made.isDefined():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tidewarp-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        made = sc._jsc.sc().getCheckpointDir()
    return made.get().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back; survives lost executors. The files go when the program ends, or when
    `freed` is told that nothing reads them any more."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewarp/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PLACE, path)
    return out


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by sorting and merging, of tables that grow with the corpus. Spark takes a table's size from its compressed files,
    and what an explode makes of a row for one row: it would collect tables of any size in the driver for a broadcast."""
    return left.join(right.hint("merge"), on, how)


def freed(*tables: DataFrame) -> None:
    """Remove the files of tables that `written` gave and that no result still to be computed reads."""
    for t in tables:
        if path := t.__dict__.get(_PLACE):
            _remove(t.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone already; the folder's owner clears it
        return
