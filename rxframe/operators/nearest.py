"""Pincode look-up and exact nearest stores on a pyramid of cells around the sphere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxframe import constants as K
from rxframe.functions import geo, text
from rxframe.session import settle

#: Edge of the finest cells on the unit sphere (about 1.3 km) and how many finer cells an edge of a coarser one holds.
EDGE = 2e-4
SHIFT = 2
#: Cells of this level are the coarsest; the sphere's whole cube, one level up, has at most 27 of them.
TOP = 6
#: More than rounding can change in a distance on the unit sphere (0.06 mm).
SLACK = 1e-11


def resolve_pincodes(requests: DataFrame, centroids: DataFrame) -> DataFrame:
    """Requests with the coordinates of their pincode; unknown pincodes give no row."""
    return requests.withColumn("pincode", text.strip(F.col("pincode"))).join(centroids, "pincode")


def store_centroids(stores: DataFrame) -> DataFrame:
    """Coordinates per pincode that has a store."""
    return stores.groupBy("pincode").agg(
        F.max(F.struct("code", "lat", "lng")).alias("s")
    ).select("pincode", "s.lat", "s.lng")


def _on_sphere(rows: DataFrame) -> DataFrame:
    """``rows`` with the point ``x``, ``y``, ``z`` of ``lat`` and ``lng`` on the unit sphere."""
    lat, lng = F.radians("lat"), F.radians("lng")
    return rows.withColumns({"x": F.cos(lat) * F.cos(lng), "y": F.cos(lat) * F.sin(lng), "z": F.sin(lat)})


def _cell(level: int) -> Column:
    """The cell of ``x``, ``y``, ``z`` on a level: cubes of the space around the sphere, so poles and date line are no borders."""
    axes = [F.shiftright(F.floor((F.col(c) + 1) / EDGE).cast("long"), SHIFT * level) for c in "xyz"]
    return F.shiftleft(axes[0], 28) + F.shiftleft(axes[1], 14) + axes[2]


def _cells(points: DataFrame, level: int) -> DataFrame:
    """``parent`` and ``cell`` of a level, how many ``points`` it holds and the box around them."""
    box = {f"{end}_{c}": getattr(F, end)(c) for c in "xyz" for end in ("min", "max")}
    return points.groupBy(_cell(level + 1).alias("parent"), _cell(level).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in box.items()]
    )


def _narrowed(spots: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """Each spot with the finest ``cell``s that can hold one of its ``k`` nearest points.

    From the coarsest level down, cells are replaced by the cells inside. Cells in order of their greatest distance hold k
    points up to some distance, and only cells whose least distance is not beyond it go on. So a spot keeps a handful of
    cells on each level wherever it is, and no key stands for all points.
    """
    # The coarsest cells are few, so each spot names them all: meeting them by one constant key would be a nested loop.
    side = range((int(2 / EDGE) >> SHIFT * TOP) + 1)
    coarsest = F.array(*[F.lit((a << 28) + (b << 14) + c).cast("long") for a in side for b in side for c in side])
    held = _on_sphere(spots).withColumn("cell", F.explode(coarsest))
    for level in range(TOP, -1, -1):
        inside = _cells(points, level).withColumnRenamed("cell", "_cell")
        met = held.join(inside, F.col("cell") == F.col("_cell" if level == TOP else "parent")).drop("cell")
        near, far = F.lit(0.0), F.lit(0.0)
        for c in "xyz":
            below, above = F.col(f"min_{c}") - F.col(c), F.col(c) - F.col(f"max_{c}")
            near = near + F.pow(F.greatest(below, above, F.lit(0.0)), 2.0)
            far = far + F.pow(F.greatest(F.abs(below), F.abs(above)), 2.0)
        met = met.select("lat", "lng", "x", "y", "z", F.col("_cell").alias("cell"), "n", F.sqrt(near).alias("near"), F.sqrt(far).alias("far"))
        spot = Window.partitionBy("lat", "lng")
        upto = F.sum("n").over(spot.orderBy("far", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        bound = F.min(F.when(F.col("upto") >= k, F.col("far"))).over(spot)
        met = met.withColumn("upto", upto).withColumn("bound", F.coalesce(bound, F.lit(4.0)))
        held = met.filter(F.col("near") <= F.col("bound") + SLACK).select("lat", "lng", "x", "y", "z", "cell")
    return held.select("lat", "lng", "cell")


def nearest_stores(
    probes: DataFrame,
    stores: DataFrame,
    k: int = 10,
    chain: str = "",
    keep=settle,
) -> DataFrame:
    """The ``k`` (1..25) nearest stores of each probe, distance to one decimal.

    Probes descend a pyramid of cells around the sphere (see ``_narrowed``) and compare only the stores of the finest cells
    that are left. Equal coordinates are handled once on both sides, and a place keeps its k first codes.
    """
    k = min(max(k, 1), K.NEAREST_MAX)
    at_place = F.row_number().over(Window.partitionBy("lat", "lng").orderBy("code"))
    places = keep(
        _on_sphere(stores.select("code", "lat", "lng").withColumn("_rank", at_place).filter(F.col("_rank") <= k).drop("_rank")),
        "places",
    )
    spots = probes.select("lat", "lng").distinct().filter("lat IS NOT NULL AND lng IS NOT NULL")
    cells = _narrowed(spots, places, k)
    targets = places.select(_cell(0).alias("cell"), "code", F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"))
    km = geo.haversine_km(F.col("lat"), F.col("lng"), F.col("s_lat"), F.col("s_lng"))
    by_distance = Window.partitionBy("lat", "lng").orderBy("km", "code")
    best = (
        cells.join(targets, "cell")
        .select("lat", "lng", "code", F.round(km, 9).alias("km"))
        .withColumn("rank", F.row_number().over(by_distance))
        .filter(F.col("rank") <= k)
    )
    details = stores.select("code", "name", "address", "district", "state", "pincode")
    named = best.join(details, "code").select(
        F.col("lat"),
        F.col("lng"),
        "rank",
        "code",
        "name",
        "address",
        "district",
        "state",
        "pincode",
        F.round("km", 1).alias("distance_km"),
        geo.map_link(
            *([F.lit(chain)] if chain else []), F.col("address"), F.col("district"), F.col("pincode")
        ).alias("maps_url"),
    )
    return probes.drop("pincode").join(named, ["lat", "lng"])
