"""Readers and writers: corpora, length vectors, batch files, result CSVs, log text, experiment folders, traces."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..operators.batching import shuffled_place


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_corpus(spark: SparkSession, path: str, fmt: str = "parquet", num_samples: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """A corpus, whole or its first `num_samples` rows by doc_id; only the given columns are scanned."""
    df = spark.read.format(fmt).load(path)
    df = df.select(*columns) if columns else df
    return df.orderBy("doc_id").limit(num_samples) if num_samples else df


def cached(df: DataFrame, folder: str, **config) -> DataFrame:
    """The table as Parquet under a name that its configuration hashes to; built once, read afterwards."""
    spark = df.sparkSession
    path = f"{folder}/{hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def mock_sequences(spark: SparkSession, n: int, low: int, high: int, seed: int, eod: int = 0) -> DataFrame:
    """Synthetic samples: seq_id and tokens 1 .. length-1 and an end mark, lengths from a hash of id and seed."""
    length = (F.pmod(shuffled_place(F.col("id"), seed), F.lit(high - low)) + low).cast("int")
    tokens = F.concat(F.sequence(F.lit(1), F.col("n") - 1), F.array(F.lit(eod)))
    return spark.range(n).select(F.col("id").alias("seq_id"), length.alias("n")).where("n > 1").select("seq_id", tokens.alias("tokens"))


def mock_multimodal(spark: SparkSession, segments: list[list[int]], image_sizes: list[int]) -> DataFrame:
    """In-memory multimodal samples: text segment lengths, image size, and total length."""
    rows = [(i, s, z, sum(s) + (len(s) - 1) * z) for i, (s, z) in enumerate(zip(segments, image_sizes, strict=True))]
    return spark.createDataFrame(rows, "seq_id bigint, text_lengths array<int>, image_size int, total_len int")


def multimodal_samples(spark: SparkSession, n: int, seed: int, image_size: int = 512, most_segments: int = 5, longest: int = 600, vocabulary: int = 50_000) -> DataFrame:
    """Synthetic multimodal samples: text segments with an image between each two, all tokens drawn by hash of seed and place.

    seq_id, text_lengths, image_size, total_len, tokens. Segments may be empty; the same seed gives the same samples."""
    draw = lambda *parts: shuffled_place(F.concat_ws("/", *(p.cast("string") for p in parts)), seed)
    i = F.col("id")
    count = (F.pmod(draw(i, F.lit("n")), F.lit(most_segments)) + 1).cast("int")
    lengths = F.transform(F.sequence(F.lit(1), count), lambda j: F.pmod(draw(i, F.lit("t"), j), F.lit(longest)).cast("int"))
    df = spark.range(n).withColumn("text_lengths", lengths).withColumn("image_size", F.lit(image_size))
    total = F.aggregate("text_lengths", F.lit(0), lambda a, x: a + x) + (F.size("text_lengths") - 1) * F.col("image_size")
    df = df.withColumn("total_len", total)
    places = F.when(F.col("total_len") > 0, F.sequence(F.lit(1), F.col("total_len"))).otherwise(F.array().cast("array<int>"))
    tokens = F.transform(places, lambda k: F.pmod(draw(i, k), F.lit(vocabulary)))
    return df.select(i.alias("seq_id"), "text_lengths", "image_size", "total_len", tokens.alias("tokens"))


def from_lengths(spark: SparkSession, lengths: list[int]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(lengths)), "seq_id bigint, raw_len bigint")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """A batch file {batches, max_dp_degree} as batch_id, place, raw_len, max_dp_degree."""
    df = spark.read.schema(schemas.BATCHES).json(path)
    return df.select("max_dp_degree", F.posexplode("batches").alias("batch_id", "lens")).select("batch_id", F.posexplode("lens").alias("place", "raw_len"), "max_dp_degree")


def write_batches(batches: DataFrame, path: str, max_dp_degree: int) -> None:
    """Batches (batch_id, place, raw_len) as one JSON object, in order: a file of the size of a configuration."""
    one = batches.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "raw_len"))), lambda x: x["raw_len"].cast("int")).alias("lens"))
    all_ = one.agg(F.transform(F.array_sort(F.collect_list(F.struct("batch_id", "lens"))), lambda x: x["lens"]).alias("batches"))
    all_.select("batches", F.lit(max_dp_degree).alias("max_dp_degree")).write.mode("overwrite").json(path)


def write_lengths(df: DataFrame, path: str) -> None:
    df.select("seq_id", "raw_len").write.mode("overwrite").parquet(path)


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("seq_id bigint, raw_len bigint").parquet(path)


def read_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Result CSVs, with the data-set name taken from the folder of each file."""
    df = spark.read.schema(schemas.RESULTS).option("header", True).csv(paths)
    return df.withColumn("dataset_dir", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def append_results(df: DataFrame, path: str, spark: SparkSession) -> DataFrame:
    """Appends the rows whose configuration has no finished result yet; returns them."""
    keys = [c for c in df.columns if c not in ("avg_time", "n_iters")]
    try:
        done = finished(spark.read.schema(df.schema).option("header", True).csv(path), keys)
        df = df.join(done, keys, "left_anti")
    except Exception as e:  # no file yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").option("header", True).csv(path)
    return df


def finished(results: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct configurations with a measured time."""
    return results.where("avg_time is not null and avg_time <> 'None'").select(*keys).distinct()


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines below a folder tree: run folder, file, line."""
    df = spark.read.option("recursiveFileLookup", True).text(path)
    file = F.col("_metadata.file_path")
    return df.select(F.regexp_extract(file, r"([^/]+)/[^/]+$", 1).alias("run"), F.regexp_extract(file, r"([^/]+)$", 1).alias("file"), F.col("value").alias("line"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Whole files of a tree dataset/framework/run/file: dataset, framework, run, file, content."""
    df = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path)
    part = F.split(F.col("_metadata.file_path"), "/")
    at = lambda k: F.element_at(part, -k)
    return df.select(at(4).alias("dataset"), at(3).alias("framework"), at(2).alias("run"), at(1).alias("file"), F.col("value").alias("content"))


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def trace_events(spans: DataFrame) -> DataFrame:
    """Chrome trace events as JSON lines of spans (name, cat, start_ms, dur_ms, node, device)."""
    us = lambda c: (F.col(c) * 1000).alias
    event = F.struct("name", F.lit("X").alias("ph"), "cat", us("start_ms")("ts"), us("dur_ms")("dur"), F.col("device").alias("tid"), F.col("node").alias("pid"))
    return spans.select(F.to_json(event).alias("value"))


def write_trace(spans: DataFrame, path: str) -> None:
    trace_events(spans).write.mode("overwrite").text(path)


def prefetch_slot(batch: Column, buffer: int) -> Column:
    return F.pmod(batch, F.lit(buffer))


def planner_node(batch: Column, per_node: int, nodes: int) -> Column:
    """Which node plans a batch: `per_node` in a row each, in turn."""
    return F.pmod(F.floor(batch / per_node), F.lit(nodes))
