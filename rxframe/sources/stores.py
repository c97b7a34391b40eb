"""Stores with coordinates from a pincode directory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxframe.functions import geo

STORE_JSON = "map<string, array<struct<code:string,name:string,address:string,district:string,state:string>>>"


def pincode_centroids(offices: DataFrame) -> DataFrame:
    """Mean coordinate per pincode over offices whose coordinates are readable and plausible.

    Coordinates are summed as fixed-point numbers so the result does not depend on row order.
    """
    read = offices.select(
        F.trim("pincode").alias("pincode"),
        F.trim("latitude").try_cast("double").alias("lat"),
        F.trim("longitude").try_cast("double").alias("lng"),
    ).filter(geo.in_box(F.col("lat"), F.col("lng")))

    def mean(column: str):
        return F.round(
            F.sum(F.col(column).cast("decimal(20,8)")).cast("double") / F.count(column), 5
        )

    return read.groupBy("pincode").agg(mean("lat").alias("lat"), mean("lng").alias("lng"))


def explode_store_json(documents: DataFrame, column: str = "value") -> DataFrame:
    """Documents of the form {pincode: [store, ...]} as one row per store."""
    per_pin = documents.select(
        F.explode(F.from_json(column, STORE_JSON)).alias("pincode", "entries")
    )
    return per_pin.select("pincode", F.inline("entries"))


def locate(stores: DataFrame, centroids: DataFrame) -> DataFrame:
    """Stores whose pincode is known, with its coordinates."""
    return stores.join(centroids, "pincode").select(
        "code", "name", "address", "district", "state", "pincode", "lat", "lng"
    )


def build_report(stores: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row: stores located, stores skipped, centroids available."""
    hit, known = F.col("hit"), F.col("known")
    placed = stores.select("pincode").join(
        centroids.select("pincode", F.lit(1).alias("hit")), "pincode", "left"
    )
    both = placed.select("hit", F.lit(None).cast("int").alias("known")).unionByName(
        centroids.select(F.lit(None).cast("int").alias("hit"), F.lit(1).alias("known"))
    )
    return both.agg(
        F.count(hit).alias("located"),
        F.count(F.when(hit.isNull() & known.isNull(), 1)).alias("skipped"),
        F.count(known).alias("centroids"),
    )
