"""Readers of the reference files: pincode directory, store list, rules, curated brands, ingredient notes.

The files are small JSON or CSV documents; each reader gives the table that the operators take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rxframe import schemas

INTERACTIONS = "struct<interactions: array<struct<salts:array<string>, severity:string, effect:string, advice:string>>>"
GENERIC = "struct<name:string, price:double>"
CURATED = f"""struct<disclaimer:string, brands:array<struct<brand:string, aliases:array<string>, salt:string,
 salt_keys:array<string>, category:string, pack:string, brand_price:double, generic:{GENERIC}, price_asof:string>>>"""
NOTES = "map<string, struct<uses:string, side_effects:string>>"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``value``."""
    return spark.read.text(path, wholetext=True)


def offices(spark: SparkSession, path: str) -> DataFrame:
    """The pincode directory: ``pincode``, ``latitude`` and ``longitude`` as text."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    # A byte order mark may stand before the first name.
    names = {c.lstrip("﻿").strip().lower(): c for c in rows.columns}
    return rows.select(*[F.col(f"`{names[c]}`").alias(c) for c in ("pincode", "latitude", "longitude")])


def broken(texts: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """One row: documents that cannot be read, so that none goes unnoticed."""
    return texts.agg(F.count_if(F.from_json(column, schema).isNull()).alias("broken"))


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of one bounded file with their place in it."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(F.col("place"))) - 1).drop("place")


def interaction_rules(spark: SparkSession, path: str) -> DataFrame:
    found = documents(spark, path).select(F.from_json("value", INTERACTIONS)["interactions"].alias("r"))
    rows = found.select(F.posexplode("r").alias("place", "rule")).select("place", "rule.*")
    return _numbered(rows, "rule_pos").withColumn("rule_pos", F.col("rule_pos").cast("long"))


def dose_rules(spark: SparkSession, path: str) -> DataFrame:
    kind = f"struct<rules: array<struct<{_struct(schemas.DOSE_RULES)}>>>"
    found = documents(spark, path).select(F.from_json("value", kind)["rules"].alias("r"))
    return found.select(F.inline("r"))


def curated(spark: SparkSession, path: str) -> DataFrame:
    found = documents(spark, path).select(F.from_json("value", CURATED)["brands"].alias("b"))
    rows = found.select(F.posexplode("b").alias("place", "brand_row")).select("place", "brand_row.*")
    return _numbered(rows, "pos").withColumn("pos", F.col("pos").cast("long"))


def ingredient_notes(spark: SparkSession, path: str) -> DataFrame:
    found = documents(spark, path).select(F.explode(F.from_json("value", NOTES)).alias("salt", "note"))
    return found.select("salt", "note.*")


def _struct(columns: str) -> str:
    """A column list as the fields of a struct type."""
    out, depth = [], 0
    for word in columns.replace("\n", " ").split(","):
        if depth == 0:
            name, kind = word.strip().split(" ", 1)
            word = f"{name}:{kind}"
        depth += word.count("<") - word.count(">")
        out.append(word)
    return ",".join(out)
