"""Merging curated brands and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxframe.functions import text
from rxframe.sinks.upsert import last_wins


def merge_brands(base: DataFrame, additions: DataFrame) -> DataFrame:
    """Base plus additions whose brand is unknown; the first of equal additions counts.

    Additions carry ``extra_aliases``; their aliases are generated. Sort by (category, brand).
    """
    first = last_wins(
        additions.withColumn("brand_key", F.lower("brand")), ["brand_key"], [F.col("pos")]
    )
    known = base.select(F.lower("brand").alias("brand_key"))
    fresh = first.join(known, "brand_key", "left_anti").withColumn(
        "aliases", text.aliases(F.col("brand"), F.col("extra_aliases"))
    )
    columns = [c for c in base.columns]
    return base.unionByName(fresh.select(columns))


def pair_key(salts):
    return F.array_sort(F.transform(salts, F.lower))


def merge_rules(base: DataFrame, additions: DataFrame) -> DataFrame:
    """Base plus rules whose unordered ingredient pair is unknown."""
    first = last_wins(
        additions.withColumn("pair", pair_key(F.col("salts"))), ["pair"], [F.col("rule_pos")]
    )
    known = base.select(pair_key(F.col("salts")).alias("pair"))
    return base.unionByName(first.join(known, "pair", "left_anti").select(base.columns))


def category_order() -> list:
    return [F.col("category"), F.col("brand")]
