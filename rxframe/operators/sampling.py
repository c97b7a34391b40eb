"""Noisy samples of names and match-quality comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _draw(seed: int, *parts):
    """A whole number drawn from the text of ``parts``."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _smallest(drawn: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the smallest draws.

    Draws are 32-bit numbers, counted in 65,536 ranges. Ranges below the cut are taken whole; only
    the one range the cut falls into is sorted.
    """
    ranged = drawn.withColumn("range", F.shiftright("draw", 16).cast("int"))
    counts = ranged.groupBy("range").count().orderBy("range").collect()  # 65,536 rows at most
    left, cut = n, -1
    for row in counts:
        cut = row["range"]
        if row["count"] >= left:
            break
        left -= row["count"]
    below = ranged.filter(F.col("range") < cut)
    edge = ranged.filter(F.col("range") == cut).orderBy("draw", "pos").limit(left)
    return below.unionByName(edge).drop("draw", "range")


def noisy_sample(names: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows of names(pos, name), repeated past the population; about half of the longer names
    lose one middle letter."""
    population = names.count()
    if population == 0 or n <= 0:
        return names.select(
            F.lit("").alias("line_id"), "name", F.col("name").alias("noisy")
        ).limit(0)
    whole, rest = divmod(n, population)

    def copies(first: int, last: int) -> DataFrame:
        return names.select(
            "pos", "name", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("copy")
        )

    picked = _smallest(
        copies(whole, whole).withColumn("draw", _draw(seed, F.col("copy"), F.col("pos"))), rest
    )
    if whole:
        picked = copies(0, whole - 1).unionByName(picked)
    size = F.length("name")
    cut = F.lit(2) + F.pmod(_draw(seed + 1, F.col("copy"), F.col("pos")), size - 2).cast("int")
    hurt = (size >= 5) & (F.pmod(_draw(seed + 2, F.col("copy"), F.col("pos")), F.lit(2)) == 0)
    shorter = F.concat(
        F.substr("name", F.lit(1), cut - 1), F.substr("name", cut + 1)
    )
    return picked.select(
        F.concat(F.lit("bench-"), F.col("pos"), F.lit("-"), F.col("copy")).alias("line_id"),
        "name",
        F.when(hurt, shorter).otherwise(F.col("name")).alias("noisy"),
    )


def match_quality(batch: DataFrame, tiered: DataFrame) -> DataFrame:
    """Match rate of both paths on the same lines."""

    def rate(rows: DataFrame, hit, name: str) -> DataFrame:
        return rows.agg(
            F.lit(name).alias("path"),
            F.count(F.lit(1)).alias("lines"),
            F.count(F.when(hit, 1)).alias("matched"),
        )

    both = rate(batch, F.col("match_method") != "unmatched", "batch").unionByName(
        rate(tiered, F.col("pos").isNotNull(), "tiered")
    )
    share = F.coalesce(F.try_divide(F.col("matched"), F.col("lines")), F.lit(0.0))
    return both.withColumn("match_rate", F.round(share, 4))
