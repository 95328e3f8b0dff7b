"""Quotation linking: reply-ordered conversations without quotes, in DataFrame operations.

Lines that begin with `>` marks are quotes of as many levels; a run of lines of one level is a passage. Passages and the
own text of messages are normalised (lower case, single spaces) and hashed; a passage is joined to the message whose own
text, paragraph or line it is, the whole passage before its single lines: an earlier turn of its conversation if there is
one (the latest), else the first message anywhere that has it. The parent of a message is the original of its first passage
of level one that has one, those in its own conversation first; passages of deeper levels stand in, the least level first,
where level one has none. A nested passage names what the message of the passage around it answers: where that message
shows no reply itself, its thread goes on there. A thread is the messages that reply to one another inside a conversation;
(thread, turn) puts a conversation in reply order, parents first.

Joins are on hashes against one row per hash, conversation and turn, or one per hash, so that a text which a third of all
messages share makes no pairs; skewed sides are left to adaptive splitting. The latest earlier turn is found in runs of `TURNS`
turns of a conversation, then over the runs, so that a conversation that repeats one line over and over fills no window.
Threads are found by pointer doubling. A message's lines are gone through once.

Defined results: a null text has no quotes and stays null; a text of quotes only has an empty own text; attribution lines
(ending in a colon, right before a quote) count as part of the quote; blank passages are not looked up; a message with
a null conv_id or turn is nobody's original and its own thread, and may be linked to what it quotes; messages that repeat conv_id and turn share the thread of the turn. Other columns
than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..tables import freed
from .common import table, written

#: Turns of a conversation whose originals and quotes of one hash meet in a window.
TURNS = 4096
_MARKS = r"^[ \t]*((?:>[ \t]?)+)"
# Words before the colon of an attribution line.
_ATTRIBUTION = r"(?i)\b(wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _key(text: Column) -> Column:
    return F.sha2(_normal(text), 256)


def _with_passages(messages: DataFrame) -> DataFrame:
    """Adds clean (own text) and passages: array of (level, text), in order. Both come from a single pass over the lines."""
    lines = F.split(F.regexp_replace(F.col("text"), r"\r\n?", "\n"), "\n")
    marked = F.transform(
        lines,
        lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), r"[ \t]", "")).alias("level"),
            F.regexp_replace(x, _MARKS, "").alias("text"),
        ),
    )
    df = messages.withColumn("_lines", marked)
    n = F.size("_lines")
    introduced = lambda x, i: (x["level"] == 0) & x["text"].rlike(_ATTRIBUTION) & (i < n - 1) & (F.get(F.col("_lines"), i + 1)["level"] > 0)
    df = df.withColumn("_kept", F.transform("_lines", lambda x, i: F.struct(x["level"].alias("level"), x["text"].alias("text"), introduced(x, i).alias("intro"))))
    own = F.filter("_kept", lambda x: (x["level"] == 0) & ~x["intro"])
    # a run of lines of one level is a passage: where runs begin, and what lies between two beginnings
    df = df.withColumn("_own", own).withColumn("_quoted", F.filter("_kept", lambda x: ~x["intro"])).withColumn("_has", F.exists("_lines", lambda x: x["level"] > 0))
    none = F.array().cast("array<struct<level:int,text:string>>")
    size = F.size("_quoted")
    places = F.when(F.col("_has") & (size > 0), F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_starts", F.filter(places, lambda i: (i == 0) | (F.get(F.col("_quoted"), i)["level"] != F.get(F.col("_quoted"), i - 1)["level"])))

    def passage(start: Column, k: Column) -> Column:
        lines = F.slice(F.col("_quoted"), start + 1, F.coalesce(F.get(F.col("_starts"), k + 1), size) - start)
        return F.struct(F.get(F.col("_quoted"), start)["level"].alias("level"), F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))

    runs = F.transform(F.filter("_starts", lambda i: F.lit(True)), passage)
    passages = F.filter(runs, lambda x: (x["level"] > 0) & (F.trim(x["text"]) != ""))
    clean = F.regexp_replace(F.regexp_replace(F.array_join(F.transform("_own", lambda x: x["text"]), "\n"), r"^\n+|\n+$", ""), r"\n{3,}", "\n\n")
    df = df.withColumn("clean", F.when(F.col("_has"), clean).otherwise(F.col("text"))).withColumn("passages", F.when(F.col("_has"), passages).otherwise(none))
    return df.drop("_lines", "_kept", "_own", "_quoted", "_has", "_starts")


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, clean text, n_quotes, depth (deepest quote level), parent_conv, parent_turn, thread of each row.

    thread: smallest turn of the row's thread in its conversation; order by conv_id, thread, turn to read in reply order.
    """
    spark = messages.sparkSession
    base = messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"))
    rows = written(_with_passages(base).withColumn("_id", F.monotonically_increasing_id()), "messages")
    lines = F.transform(F.filter(F.split("p.text", "\n"), lambda x: F.trim(x) != ""), _key)
    quotes = written(
        rows.where(F.size("passages") > 0).select("_id", "conv_id", "turn", F.posexplode("passages").alias("place", "p"))
        .withColumn("whole", _key(F.col("p.text")))
        .withColumn("keys", F.concat(F.array(F.struct(F.col("whole").alias("key"), F.lit(0).alias("line"))), F.transform(F.array_except(lines, F.array("whole")), lambda x: F.struct(x.alias("key"), F.lit(1).alias("line")))))
        .select("_id", "conv_id", "turn", "place", F.col("p.level").alias("level"), F.explode("keys").alias("k")).select("_id", "conv_id", "turn", "place", "level", "k.*"),
        "quotes",
    )
    plain = rows.select(
        "conv_id", "turn", "role", "_id", F.col("clean").alias("text"), F.size("passages").cast("int").alias("n_quotes"),
        F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).cast("int").alias("depth"),
    )
    if quotes.isEmpty():
        return plain.select(*_OUT[:-3], F.lit(None).cast("bigint").alias("parent_conv"), F.lit(None).cast("bigint").alias("parent_turn"), F.col("turn").alias("thread"))
    asked = quotes.select("key").distinct()
    parts = F.array_distinct(F.concat(F.array(F.col("clean")), F.split("clean", r"\n\s*\n"), F.split("clean", "\n")))
    originals = (
        rows.where("clean is not null and conv_id is not null and turn is not null")
        .select("conv_id", "turn", F.explode(F.array_distinct(F.transform(F.filter(parts, lambda x: F.trim(x) != ""), _key))).alias("key"))
        .join(asked, "key", "left_semi").groupBy("key", "conv_id", "turn").agg(F.count("*").alias("n"))
    )
    originals = written(originals, "originals")
    # the latest earlier turn of the own conversation: running maximum over the originals of a run of turns, then over runs
    asks = quotes.where("conv_id is not null and turn is not null").select("key", "conv_id", "turn").distinct()
    events = originals.select("key", "conv_id", "turn", F.lit(0).alias("asks")).unionByName(asks.withColumn("asks", F.lit(-1))).withColumn("run", F.floor(F.col("turn") / TURNS))
    original = F.when(F.col("asks") == 0, F.col("turn"))
    inside = F.max(original).over(Window.partitionBy("key", "conv_id", "run").orderBy("turn", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    past = F.max("last").over(Window.partitionBy("key", "conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    before = events.groupBy("key", "conv_id", "run").agg(F.max(original).alias("last")).withColumn("past", past).where("past is not null").select("key", "conv_id", "run", "past")
    near = events.withColumn("inside", inside).where("asks = -1").join(before, ["key", "conv_id", "run"], "left")
    near = near.select("key", "conv_id", "turn", F.coalesce("inside", "past").alias("near_turn")).where("near_turn is not null")
    first = originals.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    # the original of every passage: by the whole passage before single lines, near before far, the latest near one, the first far one
    originals_of = (
        quotes.select("_id", "place", "level", "line", "key", "conv_id", "turn").join(near, ["key", "conv_id", "turn"], "left").join(first, "key", "left")
        .withColumn("elsewhere", F.when(~F.coalesce((F.col("first.conv_id") == F.col("conv_id")) & (F.col("first.turn") >= F.col("turn")), F.lit(False)), F.col("first")))
        .withColumn("to", F.coalesce(F.when(F.col("near_turn").isNotNull(), F.struct(F.lit(0).alias("far"), (-F.col("near_turn")).alias("rank"), F.col("conv_id"), F.col("near_turn").alias("turn"))), F.when(F.col("elsewhere").isNotNull(), F.struct(F.lit(1).alias("far"), F.lit(0).cast("bigint").alias("rank"), F.col("elsewhere.conv_id"), F.col("elsewhere.turn")))))
        .where("to is not null").groupBy("_id", "place", "level").agg(F.min(F.struct("line", "to.far", "to.rank", "to.conv_id", "to.turn")).alias("to"))
    )
    originals_of = written(originals_of.select("_id", "place", "level", "to.line", "to.far", "to.conv_id", "to.turn"), "passages")
    found = originals_of.groupBy("_id").agg(F.min(F.struct("level", "far", "line", "place", "conv_id", "turn")).alias("to"))
    found = found.select("_id", F.col("to.conv_id").alias("parent_conv"), F.col("to.turn").alias("parent_turn"))
    linked = written(plain.join(found, "_id", "left"), "linked")
    replies = linked.where("parent_conv = conv_id and parent_turn < turn").groupBy("conv_id", "turn").agg(F.min("parent_turn").alias("up"))
    # a passage right beside one of the level above, both from the own conversation: the outer one's message answers the nested one's
    outer = originals_of.where("far = 0").select("_id", "place", "level", "conv_id", "turn")
    nested = outer.select("_id", F.explode(F.array(F.col("place") - 1, F.col("place") + 1)).alias("place"), (F.col("level") - 1).alias("level"), F.col("turn").alias("up"))
    above = outer.join(nested, ["_id", "place", "level"]).where("up < turn").groupBy("conv_id", "turn").agg(F.max("up").alias("up"))
    replies = replies.unionByName(above.join(replies, ["conv_id", "turn"], "left_anti"))
    replies = step = written(replies, "replies")
    freed(originals, originals_of, quotes)
    while True:  # each pass doubles the way that a pointer goes up
        above = replies.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("higher"))
        before, step = step, written(replies.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("higher", "up").alias("up"), F.col("higher").isNotNull().alias("moved")), "replies")
        freed(before)
        replies = step.select("conv_id", "turn", "up")
        if step.where("moved").isEmpty():
            break
    return linked.join(replies.withColumnRenamed("up", "thread_"), ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread_", "turn")).select(*_OUT)


_OUT = ["conv_id", "turn", "role", "text", "n_quotes", "depth", "parent_conv", "parent_turn", "thread"]


def op3(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))
