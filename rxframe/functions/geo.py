"""Distances, coordinate box and map links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxframe import constants as K


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    return F.asin(F.sqrt(a)) * (2 * K.EARTH_RADIUS_KM)


def in_box(lat: Column, lng: Column) -> Column:
    return lat.between(*K.LAT_RANGE) & lng.between(*K.LNG_RANGE)


def map_link(*parts: Column) -> Column:
    """A map search address; blanks become '+'."""
    return F.replace(
        F.concat(F.lit(K.MAP_URL), F.concat_ws(" ", *parts)), F.lit(" "), F.lit("+")
    )
