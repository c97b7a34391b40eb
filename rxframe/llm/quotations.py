"""Quotation linking: replies joined to the messages that they quote, and conversations without quotes.

A message is split into lines; leading ``>`` signs give a line its quote level, and consecutive quoted lines of one
level are a passage. Passages are normalised (white space and case) and hashed. So are the runs of a message's own
lines, their paragraphs (cut at blank lines), and each of its own lines, since people quote parts. A quoted passage is linked to the first earlier message
of its conversation that has the same own passage; each conversation and hash has one such message, found by a
partial aggregate, so a passage that everybody quotes stays one row. If no own passage equals a quoted one, its
paragraphs are tried, then its lines one by one. Line breaks inside a passage or a paragraph do not count.

A message answers the message of its lowest-level linked quote (the latest such); without a link it starts a thread.
Answers come after what they answer, so sorting by (conversation, root of the thread, turn) gives conversations in reply
order. Roots and depths are found by pointer doubling, in as many rounds as the logarithm of the longest chain.

Defined cases: null text has no lines and no quotes and stays null; a message with quotes alone has an empty body;
a null conversation or turn links with nothing and is a thread of its own; rows that repeat conversation and turn
are messages of their own with the same place: each is an original of what follows, never of its equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxframe.llm.common import column
from rxframe.session import settle

#: A quoted line, its markers and its content; the line that announces a quote.
QUOTED = r"^[ \t]{0,3}>"
MARKERS = r"^((?:[ \t]{0,3}>)+)"
ANNOUNCE = r"(?i)^.{0,200}\b(wrote|writes|schrieb|escribió|a écrit)\s*:\s*$"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role`` and ``text`` with ``body`` (own lines) and ``runs`` (level and lines of each run)."""
    split = F.split(F.col("text"), r"\r?\n", -1)
    marks = lambda x: F.regexp_extract(x, MARKERS, 1)
    line = lambda x: F.struct(
        F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.regexp_replace(x, MARKERS + " ?", "").alias("line")
    )
    lines = F.transform(split, line)
    own = F.filter(lines, lambda x, i: (x.level == 0) & ~(x.line.rlike(ANNOUNCE) & (F.get(lines, i + 1).level > 0)))
    rows = messages.withColumn("lines", lines)
    body = F.array_join(F.transform(F.when(F.col("text").rlike(r"(?m)" + QUOTED), own).otherwise(lines), lambda x: x.line), "\n")
    body = F.when(F.col("text").rlike(r"(?m)" + QUOTED), F.regexp_replace(F.trim(body, F.lit("\n")), r"\n{3,}", "\n\n")).otherwise(F.col("text"))
    return rows.withColumn("body", body)


def passages(rows: DataFrame) -> DataFrame:
    """Runs of lines of one level: ``key``, ``conv_id``, ``turn``, ``level``, ``run``, ``lines`` (normalised, not blank), ``paragraphs``."""
    # A run starts where the level changes; its number is the count of changes up to the line.
    start = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (F.get("lines", i).level != F.get("lines", i - 1).level))
    rows = rows.filter(F.size("lines") > 0).select("key", "conv_id", "turn", "lines", F.posexplode(start).alias("run", "at"), start.alias("starts"))
    end = F.coalesce(F.get("starts", F.col("run") + 1), F.size("lines"))
    part = F.slice("lines", F.col("at") + 1, end - F.col("at"))
    every = F.transform(part, lambda x: normalised(x.line))
    # Normalised lines hold no line feed, so two of them are a blank line.
    blocks = F.transform(F.split(F.array_join(every, "\n"), "\n\n+"), normalised)
    texts, paragraphs = (F.filter(x, lambda x: x != "") for x in (every, blocks))
    return rows.select(
        "key", "conv_id", "turn", F.get("lines", F.col("at")).level.alias("level"), "run", texts.alias("lines"), paragraphs.alias("paragraphs")
    ).filter(F.size("lines") > 0)


def digest(lines: Column) -> Column:
    return F.md5(F.array_join(lines, " "))


def link(messages: DataFrame) -> DataFrame:
    """``key`` and ``parent`` turn of linked messages, with ``n_quotes`` and ``n_linked`` passages."""
    runs = settle(passages(messages), "passages")
    own = runs.filter("level = 0 AND conv_id IS NOT NULL AND turn IS NOT NULL")
    hashes = own.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(F.array(digest(F.col("lines"))), F.transform("paragraphs", lambda x: F.md5(x)), F.transform("lines", lambda x: F.md5(x))))).alias("hash"))
    first = settle(hashes.groupBy(F.col("conv_id").alias("_conv"), F.col("hash").alias("_hash")).agg(F.min("turn").alias("source")), "originals")
    quoted = runs.filter("level > 0")
    tried = quoted.select(
        "key", "conv_id", "turn", "level", "run",
        F.explode(F.concat(
            F.array(F.struct(F.lit(0).alias("part"), digest(F.col("lines")).alias("hash"))),
            F.transform("paragraphs", lambda x: F.struct(F.lit(1).alias("part"), F.md5(x).alias("hash"))),
            F.transform("lines", lambda x: F.struct(F.lit(2).alias("part"), F.md5(x).alias("hash"))),
        )).alias("x"),
    )
    hit = (F.col("conv_id") == F.col("_conv")) & (F.col("x.hash") == F.col("_hash")) & (F.col("source") < F.col("turn"))
    found = tried.join(first, hit, "left")
    # The whole passage counts before its paragraphs, these before its lines, and of equals the one said last.
    best = F.min(F.when(F.col("source").isNotNull(), F.struct("x.part", (-F.col("source")).alias("late"))))
    by_run = found.groupBy("key", "run", "level").agg(best.alias("best"))
    of = F.min(F.when(F.col("best").isNotNull(), F.struct("level", F.col("best.late").alias("late"))))
    return by_run.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count("best").alias("n_linked"), of.alias("answers")
    ).select("key", "n_quotes", "n_linked", (-F.col("answers.late")).alias("parent"))


def conversations(
    table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Every message: ``conv_id``, ``turn``, ``role``, ``body``, ``n_quotes``, ``n_linked``, ``parent_turn``, ``root_turn``, ``depth``.

    Order by ``conv_id``, ``root_turn``, ``turn`` to read threads in reply order.
    """
    rows = table.select(
        column(table, conv, "long").alias("conv_id"), column(table, turn, "long").alias("turn"),
        column(table, role, "string").alias("role"), column(table, text, "string").alias("text"),
        F.monotonically_increasing_id().alias("key"),
    )
    rows = settle(parsed(rows), "messages")
    links = settle(link(rows), "links").withColumnRenamed("key", "_key")
    linked = links.filter("parent IS NOT NULL").select("_key", "parent")
    # Places (conversation, turn) that answer another; repeated places take the earliest answer.
    up = rows.join(linked, F.col("key") == F.col("_key")).groupBy("conv_id", "turn").agg(F.min("parent").alias("root"), F.lit(1).cast("long").alias("depth"))
    up = settle(up, "up")
    while True:
        above = up.select(F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        next_up = up.join(above, (F.col("conv_id") == F.col("_conv")) & (F.col("root") == F.col("_turn")), "left")
        next_up = settle(next_up.select(
            "conv_id", "turn", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), F.col("_root").isNotNull().alias("moved")
        ), "up")
        up = next_up.drop("moved")
        if next_up.filter("moved").isEmpty():
            break
    up = up.withColumnsRenamed({"conv_id": "_conv", "turn": "_turn"})
    out = rows.join(links, F.col("key") == F.col("_key"), "left").join(up, (F.col("conv_id") == F.col("_conv")) & (F.col("turn") == F.col("_turn")), "left")
    return out.select(
        "conv_id", "turn", "role", "body",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
