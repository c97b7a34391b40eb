"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rxframe import session

#: The white space of the operators (blank, tab, line feed, vertical tab, form feed, return).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on; partition numbers stay with the cluster."""
    session.prepare(spark)
    return spark


def packed(rows: DataFrame, **parts: Column) -> DataFrame:
    """``rows`` as one struct column ``row`` beside the named parts, so that no name can clash."""
    return rows.select(F.struct(*[rows[f"`{c}`"] for c in rows.columns]).alias("row"), *[
        value.alias(name) for name, value in parts.items()
    ])


def unpacked(rows: DataFrame, names: Sequence[str], added: Sequence[str]) -> DataFrame:
    """The columns of ``row`` without those that ``added`` replaces, then ``added``."""
    gone = {a.lower() for a in added}
    return rows.select(*[F.col(f"row.`{c}`") for c in names if c.lower() not in gone], *added)


def column(rows: DataFrame, name: str, kind: str) -> Column:
    """A column by name, whatever its case; a table without it is an error."""
    found = [c for c in rows.columns if c == name] or [c for c in rows.columns if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are named {name}; the table has {', '.join(rows.columns) or 'none'}")
    return rows[f"`{found[0]}`"].cast(kind)


def running(rows: DataFrame, group: list[str], part: str, order: list, value: str, out: str) -> DataFrame:
    """Sum of ``value`` up to and with each row, inside ``group`` by ``part`` and then ``order``.

    ``part`` is a coarse rank of the order whose parts hold a bounded number of rows. Only sums of parts
    meet in one task per group; the rows themselves are sorted part by part, so a group may be any size.
    """
    within = Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*group, part).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, part]
    offsets = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before")
    )
    joined = rows.join(offsets, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left")
    return joined.withColumn(out, F.col("_before") + F.sum(value).over(within)).select(*rows.columns, out)


def parts_for(n_rows: int, per_part: int = 50_000) -> int:
    return max(1, -(-n_rows // per_part))


def struct_of(*fields: tuple[str, str]) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(k)) for n, k in fields])
