"""Savings and price provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxframe import constants as K


def saving(brand: Column, generic: Column) -> Column:
    return F.round(brand - generic, 2)


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, half to even, 0 when there is nothing to compare with."""
    return F.when(
        F.coalesce(whole, F.lit(0.0)) != 0, F.rint(part / whole * 100).cast("int")
    ).otherwise(F.lit(0))


def exact_sum(c: Column) -> Column:
    """Sum of money that does not depend on the order rows arrive in."""
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def price_asof(c: Column) -> Column:
    return F.coalesce(c, F.lit(K.CURATED_PRICE_ASOF))
