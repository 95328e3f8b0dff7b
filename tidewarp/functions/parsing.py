"""What logs, run names and result folders say, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _number(line: Column, pattern: str, kind: str) -> Column:
    got = F.regexp_extract(line, pattern, 1)
    return F.when(got != "", got).cast(kind)


def log_metrics(lines: DataFrame, by: list[str]) -> DataFrame:
    """Per run: block size, inter-node cost, largest memory of a device in MB, compute imbalance (max / mean), plan seconds."""
    line = F.col("line")
    x = lines.select(
        *by,
        _number(line, r"Using block size:\s*(\d+)", "int").alias("block_size"),
        _number(line, r"Inter-node cost:\s*([\d.eE+-]+)", "double").alias("inter_cost"),
        _number(line, r"\(total mem:\s*(\d+)\)", "double").alias("mem"),
        _number(line, r"\(total workload:\s*([\d.eE+-]+)\)", "double").alias("work"),
        _number(line, r"Compilation took\s*([\d.eE+-]+)", "double").alias("seconds"),
    )
    return x.groupBy(*by).agg(
        F.max("block_size").alias("block_size"), F.max("inter_cost").alias("inter_node_cost"), (F.max("mem") / 1e6).alias("max_mem_mb"),
        (F.max("work") / F.avg("work")).alias("compute_imbalance"), F.max("seconds").alias("plan_seconds"),
    )


def elapsed_ms(line: Column) -> Column:
    return _number(line, r"elapsed time per iteration \(ms\):\s*([\d.eE+-]+)", "double")


def training_loss(line: Column) -> Column:
    return _number(line, r"Training loss:\s*([\d.eE+-]+)", "double")


def seqlens(line: Column) -> Column:
    """The list after `raw_seqlens:`."""
    return F.from_json(F.regexp_extract(line, r"raw_seqlens:\s*(\[[\d, ]*\])", 1), "array<int>")


def _item(name: Column, prefix: str) -> Column:
    return F.regexp_extract(name, rf"(?:^|_){prefix}([^_]*)", 1)


def run_config(name: Column) -> list[Column]:
    """Columns of a run name tp_dp_cp_bsz_hbs_msl_gbs_bal_msk…, the mask with its own parameter behind it."""
    part = lambda prefix, kind: F.when(_item(name, prefix) != "", _item(name, prefix)).cast(kind)
    balance = F.split(_item(name, "bal"), ",")
    rest = F.regexp_extract(name, r"_msk(.*)$", 1)
    mask = F.when(rest.contains("causal_blockwise"), "causal_blockwise").when(rest.contains("shared_question"), "shared_question").when(rest.contains("lambda"), "lambda").otherwise("causal")
    own = lambda word: F.coalesce(F.when(F.regexp_extract(rest, rf"{word}(\d+)", 1) != "", F.regexp_extract(rest, rf"{word}(\d+)", 1)).cast("int"), F.lit(-1))
    return [
        part("tp", "int").alias("tp"), part("dp", "int").alias("dp"), part("cp", "int").alias("cp"), part("bsz", "int").alias("block_size"), part("hbs", "int").alias("head_block"),
        part("msl", "int").alias("max_len"), part("gbs", "int").alias("batch_tokens"),
        F.get(balance, F.lit(0)).cast("double").alias("mem_eps"), F.get(balance, F.lit(1)).cast("double").alias("comp_eps"), F.get(balance, F.lit(2)).cast("double").alias("inter_eps"),
        mask.alias("mask"), own("lpretrain").alias("l_pretrain"), own("nans").alias("n_answers"), own("klocal").alias("k_local"),
    ]


def run_name(tp, dp, cp, block, head_block, max_len, tokens, mem_eps, comp_eps, inter_eps, mask) -> Column:
    return F.format_string("tp%d_dp%d_cp%d_bsz%d_hbs%d_msl%d_gbs%d_bal%.1f,%.1f,%.1f_msk%s", tp, dp, cp, block, head_block, max_len, tokens, mem_eps, comp_eps, inter_eps, mask)


def dataset_config(folder: Column) -> list[Column]:
    """Columns of a data-set folder name_maxlen_meanX_nNmD."""
    g = lambda k: F.regexp_extract(folder, r"^([^_]+)_(\d+)_mean([\d.]+)_(\d+)N(\d+)D$", k)
    return [g(1).alias("dataset"), g(2).cast("int").alias("max_len"), g(3).cast("double").alias("mean"), g(4).cast("int").alias("n_nodes"), g(5).cast("int").alias("n_devices")]


def run_status(log: Column, args_json: Column) -> Column:
    """success, failure or unknown, by what the log says first in that order."""
    done = log.contains("after training is done") | log.contains("StopIteration")
    losses = F.size(F.split(log, "Training loss:")) - 1
    enough = losses >= F.get_json_object(args_json, "$.n_iters").cast("int")
    failed = F.lit(False)
    for word in ("AssertionError", "OutOfMemoryError", "RuntimeError", "out of memory", "Connection reset by peer"):  # fixed values
        failed = failed | log.contains(word)
    return F.when(log.isNull() | args_json.isNull(), "unknown").when(done, "success").when(F.coalesce(enough, F.lit(False)), "success").when(failed, "failure").otherwise("unknown")


def has_failed(text: Column) -> Column:
    """Whether a run's output tells of a failure, in any case."""
    return F.lower(text).rlike("failed|broken pipe|exception|most recent call first")  # fixed values


def is_progress(text: Column) -> Column:
    """Whether a line of output is a progress update: it names a benchmark and is neither its summary nor its announcement."""
    return text.contains("Benchmark: ") & ~text.contains("total time") & ~text.contains("Benchmarking")  # fixed values


_OP = r"CommOp\(comm_type=(\w+), peer=\((\d+), (\d+)\), buffer_block=\((\w+), (\d+), (\d+)\)\)"


def comm_ops(text: Column) -> Column:
    """Operations named in an instruction dump: array of (kind, node, dev, buffer, slot, tokens). Patterns only; nothing in
    the text is ever evaluated."""
    each = F.regexp_extract_all(text, F.lit(_OP), F.lit(0))
    g = lambda x, k: F.regexp_extract(x, _OP, k)
    return F.transform(each, lambda x: F.struct(g(x, 1).alias("kind"), g(x, 2).cast("int").alias("node"), g(x, 3).cast("int").alias("dev"), g(x, 4).alias("buffer"), g(x, 5).cast("int").alias("slot"), g(x, 6).cast("bigint").alias("tokens")))


# Names as they are shown.
MASK_LABELS = {"causal": "Causal", "lambda": "Lambda", "causal_blockwise": "Causal Blockwise", "shared_question": "Shared Question"}


def relabel(column: Column, labels: dict[str, str], strict: bool = False) -> Column:
    out = None
    for k, v in labels.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown label: "), column)) if strict else column)


def label_rank(column: Column, order: list[str]) -> Column:
    """Place of a label in a given order, for sorting; unknown ones last."""
    return F.coalesce(F.element_at(F.create_map(*[x for i, k in enumerate(order) for x in (F.lit(k), F.lit(i))]), column), F.lit(len(order)))


def port_of(text: Column, low: int = 10_000, span: int = 50_000) -> Column:
    """A port from a name's SHA-1."""
    return (F.conv(F.substring(F.sha1(text.cast("binary")), 1, 8), 16, 10).cast("bigint") % span + low).cast("int")
