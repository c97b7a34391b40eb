"""Keyed upserts into parquet tables, and last-wins deduplication."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rxframe.session import passing, swept

BUCKET = "key_bucket"
POINTERS = "pointers"
#: Stored bytes of updates and old rows that one job of an upsert deals out, if whole buckets can be that small.
SLICE = 1 << 31


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order`` (give latest first).

    The rank filter is applied inside every map task before the shuffle, so copies of one key never
    gather in one place.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def merge(target: DataFrame, updates: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Target rows without an update plus the winning update per key."""
    winners = last_wins(updates, keys, order)
    return target.join(winners.select(*keys), keys, "left_anti").unionByName(winners)


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _hadoop(spark, path)
    return fs.exists(target)


@dataclass(frozen=True)
class Version:
    """What a pointer file says: number, bucket count, columns, the folder that holds each bucket, and the keys that deal rows
    into buckets (none: all)."""

    number: int
    buckets: int
    schema: str
    holders: dict[int, str]
    near: list[str] | None = None


def current(spark: SparkSession, path: str) -> Version | None:
    """The version of the last pointer of a table, or None."""
    fs, target = _hadoop(spark, f"{path}/{POINTERS}")
    if not fs.exists(target):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(target)]
    done = sorted(n for n in names if n.endswith(".json"))
    if not done:
        return None
    text = spark.read.text(f"{path}/{POINTERS}/{done[-1]}", wholetext=True).first()[0]
    found = json.loads(text)
    return Version(int(done[-1][:-5]), found["buckets"], found["schema"], {int(k): v for k, v in found["holders"].items()}, found.get("near"))


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders a reader of the current version opens."""
    version = current(spark, path)
    held = version.holders if version else {}
    return [f"{path}/data/{folder}/{BUCKET}={bucket}" for bucket, folder in sorted(held.items())]


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The current version of an upserted table, or an appended one; with a ``schema``, a missing table is empty."""
    version = current(spark, path)
    if version:
        kind = StructType.fromJson(json.loads(version.schema))
        paths = folders(spark, path)
        return spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)
    if schema and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def _merged(
    kept: DataFrame | None, updates: DataFrame, keys: list[str], order: list[Column], bucket: Column, near: list[str] | None = None
) -> DataFrame:
    """``merge`` with the bucket of every row, in one shuffle and one sort, whose order by bucket the writer needs too.

    As in a join, a key with a null equals no other: stored rows that have one stay. Rows are dealt by the keys ``near``, if given.
    """
    rows = updates.withColumn("_new", F.lit(True))
    if kept is not None:
        rows = kept.withColumn("_new", F.lit(False)).unionByName(rows)
    rows = rows.repartition(*near) if near else rows
    rank = F.row_number().over(Window.partitionBy(BUCKET, *keys).orderBy(F.col("_new").desc(), *order))
    stays = (F.col("_rank") == 1) if kept is None else (F.col("_rank") == 1) | (
        ~F.col("_new") & F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    )
    return rows.withColumn(BUCKET, bucket).withColumn("_rank", rank).filter(stays).drop("_rank", "_new")


def _slices(rows: list[DataFrame | None], buckets: list[int], most: int) -> list[list[int]]:
    """The buckets in groups whose rows, read from files, have about ``most`` bytes there."""
    size = sum(int(str(r._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for r in rows if r is not None)
    n = min(len(buckets), -(-size // most))
    return [buckets[i::n] for i in range(n)] if n > 1 else [buckets]


def upsert(
    updates: DataFrame,
    path: str,
    keys: list[str],
    order: list[Column],
    buckets: int = 64,
    stored: bool = False,
    near: list[str] | None = None,
) -> None:
    """Update-all / insert-all on ``keys`` into a parquet table.

    The table is laid out by a hash of the key. Buckets that hold an updated key are merged into a new folder,
    others keep the folder they are in; a small pointer file, which names the folder of every bucket, is renamed into
    place last. A job lost before that leaves the old version untouched, and a second writer of the same version
    fails at the rename. Folders that neither the new nor the previous version uses are removed afterwards. The bucket
    count is part of the version: another count writes the whole table anew. ``stored`` says that ``updates`` are read from
    a table and need not be written to be read twice. Rows that are read from tables, as all are but the first ones of a table
    that come from elsewhere, are dealt out ``SLICE`` bytes at a time, some buckets in each job, whose shuffle files go before the
    next one: the disk holds the shuffle of one job, not of the whole table. ``near`` names keys whose equal rows are to lie together, so that values
    they share are shuffled and stored once, almost; no value of them should hold a large part of the rows. It is part of the
    version like the bucket count.
    """
    with passing() as keep:
        _upsert(updates, path.rstrip("/"), keys, order, buckets, stored, near, keep)


def _upsert(updates, path, keys, order, buckets, stored, near, keep) -> None:
    spark = updates.sparkSession
    old = current(spark, path)
    fresh = uuid.uuid4().hex
    bucket = F.pmod(F.xxhash64(*(near or keys)), F.lit(buckets)).cast("int")
    held: dict[int, str] = {}
    if old and (old.buckets, old.near) == (buckets, near):
        # Updates are stored once, unless they are: their buckets are wanted first, then their rows.
        updates = updates if stored else keep(updates, "updates")
        # At most ``buckets`` numbers come back.
        touched = {r[0] for r in updates.select(bucket).distinct().collect()}
        if not touched:
            return
        held = {b: f for b, f in old.holders.items() if b not in touched}
        kind = StructType.fromJson(json.loads(old.schema))

        def kept_of(some: list[int]) -> DataFrame | None:
            paths = [f"{path}/data/{f}/{BUCKET}={b}" for b, f in old.holders.items() if b in some]
            return spark.read.schema(kind).parquet(*paths) if paths else None

        jobs = [(kept_of(some), some) for some in _slices([updates, kept_of([*touched])], sorted(touched), SLICE)]
    elif old:
        jobs = [(read_table(spark, path), None)]
    else:
        jobs = [(None, some) for some in (_slices([updates], [*range(buckets)], SLICE) if stored else [None])]
    for kept, some in jobs:
        wanted = updates if len(jobs) == 1 else updates.filter(bucket.isin(some))
        rows = _merged(None if kept is None else kept.select(*updates.columns), wanted, keys, order, bucket, near)
        with swept(spark):
            rows.write.mode("append").partitionBy(BUCKET).option("compression", "zstd").parquet(f"{path}/data/{fresh}")
    fs, target = _hadoop(spark, f"{path}/data/{fresh}")
    names = [f.getPath().getName() for f in fs.listStatus(target)]
    held |= {int(n.split("=")[1]): fresh for n in names if n.startswith(f"{BUCKET}=")}
    _point(spark, path, Version(old.number + 1 if old else 0, buckets, updates.schema.json(), held, near))
    _clean(spark, path, held, old)


def _point(spark: SparkSession, path: str, version: Version) -> None:
    jvm = spark._jvm
    fs, folder = _hadoop(spark, f"{path}/{POINTERS}")
    fs.mkdirs(folder)
    text = json.dumps({"buckets": version.buckets, "schema": version.schema, "holders": version.holders, "near": version.near})
    draft = jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}")
    final = jvm.org.apache.hadoop.fs.Path(folder, f"{version.number:012d}.json")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"another upsert wrote version {version.number} of {path}")


def _clean(spark: SparkSession, path: str, held: dict[int, str], old: Version | None) -> None:
    """Remove what neither this version nor the one before, which readers may still be at, uses."""
    used = {*held.values(), *(old.holders.values() if old else [])}
    fs, target = _hadoop(spark, f"{path}/data")
    for f in fs.listStatus(target):
        if f.getPath().getName() not in used:
            fs.delete(f.getPath(), True)


def merge_into_table(
    updates: DataFrame, table: str, keys: list[str], order: list[Column]
) -> None:
    """The same upsert on a catalog table whose format supports row-level MERGE."""
    condition = " AND ".join(f"{table}.{k} = s.{k}" for k in keys)
    (
        last_wins(updates, keys, order)
        .alias("s")
        .mergeInto(table, F.expr(condition))
        .whenMatched()
        .updateAll()
        .whenNotMatched()
        .insertAll()
        .merge()
    )
