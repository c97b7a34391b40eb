"""Product catalogue: import from CSV text, composition groups, stored copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxframe import constants as K
from rxframe.functions import composition, text


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue file with the columns of the published product lists, everything as text."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return raw.select(
        F.monotonically_increasing_id().alias("pos"),
        F.col("name"),
        F.col("`price(₹)`").alias("price"),
        F.col("Is_discontinued").alias("is_discontinued"),
        F.col("pack_size_label").alias("pack"),
        "short_composition1",
        "short_composition2",
    )


def import_products(rows: DataFrame, spelling: dict[str, str] = K.SPELLING) -> DataFrame:
    """Sellable products with a readable price and at least one ingredient.

    A list of any length may be one file that one task reads, so its rows are dealt out before their texts are parsed.
    """
    def stated(column: str):
        return text.strip(F.trim(text.strip(F.col(column)), F.lit(","))) != ""

    # As the element of an array these are computed once and after the rows are dealt out: a filter on plain columns would be
    # moved to the task that reads the file.
    once = F.struct(
        (F.upper(text.strip(F.col("is_discontinued"))) != "TRUE").alias("on_sale"),
        text.strip(F.col("price")).try_cast("double").alias("price"),
        (stated("short_composition1") | stated("short_composition2")).alias("stated"),
    )
    dealt = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "pos")
    judged = dealt.withColumn("o", F.explode(F.array(once)))
    parsed = judged.filter(F.col("o.on_sale") & (F.col("o.price") > 0) & F.col("o.stated")).select(
        "pos",
        text.strip(F.col("name")).alias("name"),
        text.strip(F.col("pack")).alias("pack"),
        F.col("o.price").alias("price"),
        composition.components_of(
            F.array("short_composition1", "short_composition2"), spelling
        ).alias("parts"),
    )
    return parsed.select(
        "pos",
        "name",
        text.norm(F.col("name")).alias("name_norm"),
        text.block_key(F.col("name")).alias("block_key"),
        composition.display(F.col("parts")).alias("salt"),
        composition.keys(F.col("parts")).alias("salt_keys"),
        "pack",
        "price",
        composition.signature(F.col("parts")).alias("signature"),
    )


def signature_groups(products: DataFrame) -> DataFrame:
    """Per composition: its cheapest product (earliest on equal price) and how many there are."""
    cheapest = F.min(F.struct("price", "pos", "name"))
    return (
        products.groupBy("signature")
        .agg(cheapest.alias("cheapest"), F.count(F.lit(1)).alias("product_count"))
        .select(
            "signature",
            F.col("cheapest.name").alias("generic_name"),
            F.col("cheapest.price").alias("generic_price"),
            "product_count",
        )
    )


def store_catalogue(products: DataFrame, path: str) -> None:
    products.write.mode("overwrite").parquet(path)


def load_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    products = spark.read.parquet(path)
    return products, signature_groups(products)
