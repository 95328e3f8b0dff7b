"""Tokens of texts and conversations, labels, loss masks, positions. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A token is a run of characters other than space, tab, carriage return and line feed.
TOKEN = r"[^ \t\n\r]+"
VOCABULARY = 50_000
PAD = 0


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def n_tokens(text: Column) -> Column:
    """Tokens of a text: places where one begins. Counts without building the array."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("bigint")


def token_id(word: Column, vocabulary: int = VOCABULARY) -> Column:
    """1 .. vocabulary-1 from the word's MD5; 0 is the pad."""
    return (F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint") % (vocabulary - 1) + 1).cast("bigint")


def tokenize(text: Column, vocabulary: int = VOCABULARY) -> Column:
    return F.transform(words(text), lambda w: token_id(w, vocabulary))


def conversation_text(messages: DataFrame) -> DataFrame:
    """conv_id and the turns in one text: role: "…", content: "…". without anything between turns."""
    turn = F.struct("turn", F.concat(F.lit('role: "'), F.col("role"), F.lit('", content: "'), F.col("text"), F.lit('".')).alias("part"))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["part"]), "").alias("text"))


def labels(tokens: Column, pad: int = PAD) -> Column:
    """Next-token labels: one to the left, the last is the pad."""
    return F.when(F.size(tokens) > 0, F.concat(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), F.array(F.lit(pad).cast("bigint")))).otherwise(tokens)


def loss_mask(label: Column, pad: int = PAD) -> Column:
    """1.0 where there is something to predict. Taken before pads become 0 in tokens and labels."""
    return F.transform(label, lambda x: F.when(x == pad, 0.0).otherwise(1.0))


def without_pad(tokens: Column, pad: int) -> Column:
    return F.transform(tokens, lambda x: F.when(x == pad, 0).otherwise(x).cast("bigint"))


def positions(tokens: Column) -> Column:
    return F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))


def triangular(tokens: Column, blocked: bool = False) -> Column:
    """The lower triangle of a short sequence's attention, row by row; or, blocked, what is left out of it."""
    rows = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(rows, lambda q: F.transform(rows, lambda k: (k > q) if blocked else (k <= q)))


def epochs(samples: Column, seq_len: int, tokens: Column, extra: int = 0) -> Column:
    """Smallest number of passes, 1 at least, whose tokens cover samples * seq_len + extra."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil((samples * seq_len + extra) / tokens).cast("bigint"))


def scaled_length(n: Column, by: float) -> Column:
    """Length times a factor, halves to even."""
    return F.bround(n * F.lit(float(by))).cast("bigint")


def multimodal_length(text_lengths: Column, image_size: Column) -> Column:
    return F.aggregate(text_lengths, F.lit(0).cast("bigint"), lambda a, x: a + x) + (F.size(text_lengths) - 1) * image_size


def fits(n: Column, most: int) -> Column:
    return n <= most
