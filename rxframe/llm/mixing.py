"""Mixing sources to target weights by weighted fair queueing.

Each document of a source gets a place in a shuffled order and the virtual finish time *words of its source up
to it, divided by the source's target*. Sorting all sources by finish time interleaves them at their weights;
the sorted stream is cut where the budget is spent. A source whose target is above its size goes round again,
up to ``repeats`` times, each round in an order of its own.

Running sums are taken part by part: a source is cut by its shuffle key, the stream by ranges of finish time,
which hold equal shares of the words because that is what a finish time says. Everything is SQL functions.

Defined cases: null text has size 0; a null source is a source of its own and comes last; documents without words
are never taken; an empty table gives an empty result; repeated rows are documents of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rxframe.llm.common import WORD, column, packed, parts_for, running
from rxframe.session import settle

WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = "mix"
ROWS_PER_PART = 20_000


def sizes(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id``, ``source`` and ``size`` in words."""
    return docs.select(
        column(docs, ident, "long").alias("doc_id"),
        column(docs, source, "string").alias("source"),
        F.coalesce(F.regexp_count(column(docs, text, "string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sized: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``source``, ``rows``, ``source_size`` and ``target``: shares by weight, full sources cut and the rest reshared.

    That is filling to a common level: with sources in order of cap by weight, the level is what the budget
    without the caps before gives each unit of weight left, at the first source that this level does not fill.
    """
    totals = sized.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    named = totals.select("*", weight.alias("weight"), (F.col("source_size") * repeats).alias("cap"))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    steps = named.select(
        "*",
        F.sum("source_size").over(every).alias("budget"),
        F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("filled"),
        F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
    ).withColumn("level", (F.col("budget") - F.col("filled")) / F.col("left"))
    # Levels rise up to the first source that its level does not fill, and fall after it.
    level = F.max("level").over(every)
    return steps.select(
        "source", "rows", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * level).alias("target")
    )


def shuffle_key(seed: str, round_: Column, ident: Column) -> Column:
    return F.md5(F.concat_ws("/", F.lit(seed), round_.cast("string"), F.coalesce(ident.cast("string"), F.lit(""))))


def schedule(sized: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """The mixed stream: a row for each document and round that is taken, with ``finish`` and its ``start`` in words.

    ``sized`` must have a stable ``row_id``. Order by ``start`` to read the stream.
    """
    shares = settle(targets(sized, weights, repeats), "targets")
    budget, n = shares.agg(F.sum("source_size"), F.sum("rows")).first()
    queue = sized.join(shares, sized.source.eqNullSafe(shares.source)).select(sized["*"], "rows", "source_size", "target")
    # A source needs the rounds that reach its target, and the document after it.
    rounds = F.least(F.lit(repeats), F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))).cast("int") + 1)
    queue = queue.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0), rounds - 1)).alias("round"))
    queue = queue.withColumn("key", shuffle_key(seed, F.col("round"), F.col("doc_id"))).withColumn(
        "slice",
        F.floor(F.conv(F.substring("key", 1, 6), 16, 10).cast("long") * F.ceil(F.col("rows") / ROWS_PER_PART) / 16_777_216),
    )
    queue = running(queue, ["source", "round"], "slice", ["key", "size", "row_id"], "size", "served")
    served = F.col("round") * F.col("source_size") + F.col("served")
    queue = queue.withColumn("finish", served / F.col("target"))
    # Finish times within one part of all are equal shares of the words.
    queue = queue.withColumn("stretch", F.floor(F.col("finish") * parts_for(n or 0, ROWS_PER_PART)))
    order = ["finish", F.col("source").asc_nulls_last(), "round", "key", "size", "row_id"]
    queue = running(queue, [], "stretch", order, "size", "end")
    taken = queue.filter(F.col("end") <= F.lit(budget or 0))
    return taken.select("row_id", "doc_id", "source", "round", "key", "size", "finish", (F.col("end") - F.col("size")).alias("start"))


def numbered(sized: DataFrame) -> DataFrame:
    """``sized`` stored with a stable ``row_id``, so that the texts are read once."""
    return settle(sized.withColumn("row_id", F.monotonically_increasing_id()), "sizes")


def mix(sized: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """For each numbered document: ``size``, ``source_size``, ``target`` and ``taken`` words."""
    shares = targets(sized, weights, repeats)
    taken = schedule(sized, weights, repeats, seed).groupBy("row_id").agg(F.sum("size").alias("taken"))
    known = sized.join(shares, sized.source.eqNullSafe(shares.source)).select(sized["*"], "source_size", "target")
    return known.join(taken, "row_id", "left").select(
        "row_id", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def apply(docs: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **how) -> DataFrame:
    """``docs`` as often as the mix takes them. Ids are taken as unique; rows that repeat one come as often as it.

    What a round takes of a source is a beginning of its shuffled order, so the last key of each round says for every
    document how often it comes. The table of these has one row a source; no text moves to be counted or copied.
    """
    taken = schedule(numbered(sizes(docs, ident, text, source)), seed=seed, **how)
    last = taken.groupBy(F.col("source").alias("_source"), "round").agg(F.max("key").alias("key"))
    last = settle(last.groupBy("_source").agg(F.collect_list(F.struct("round", "key")).alias("_last")), "last_keys")
    rows = packed(docs, _id=column(docs, ident, "long"), _from=column(docs, source, "string"), _said=F.coalesce(column(docs, text, "string").rlike(WORD), F.lit(False)))
    rows = rows.filter("_said").join(last, F.col("_from").eqNullSafe(F.col("_source")))
    copies = F.size(F.filter("_last", lambda x: shuffle_key(seed, x["round"], F.col("_id")) <= x["key"]))
    rows = rows.withColumn("_copies", copies).filter("_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns])
