"""Exact dedup: two passes over Bloom filter bits, so that only possibly repeated rows shuffle.

Pass one counts the filter's bit positions and keeps those that at least two rows hit. Pass two tests every
row against these bits: a row with a bit hit only by itself has no equal and passes straight through; the
rest are grouped by digest. Everything is SQL functions.

The filter holds ``bits_per_row`` bits a row and never more than ``max_bits`` (2**28 bits are 32 MB), which
bounds what is broadcast. Beyond that more rows reach the shuffle; the result stays the same.

Defined cases: null text counts as empty; of equal texts the one with the most code points, then the smallest
id, stays, null ids last; rows repeated whole count each, and one of them stays; an empty table gives an empty
result; input columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rxframe.llm.common import SPACE_CHARS, column, packed, unpacked
from rxframe.session import settle

BITS_PER_ROW = 16
MAX_BITS = 1 << 28
#: Bits of one stored bitmap, as ``bitmap_construct_agg`` lays them out.
CHUNK = 32_768
ADDED = ["keep_id", "group_size", "kept"]


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text_sha256`` of the text without white space and ``text_length`` in code points."""
    body = column(docs, text, "string")
    work = packed(
        docs,
        text_sha256=F.sha2(normalised(body), 256),
        text_length=F.length(F.coalesce(body, F.lit(""))).cast("long"),
    )
    return unpacked(work, docs.columns, ["text_sha256", "text_length"])


def _positions(digest: Column, bits: int) -> list[Column]:
    h = F.xxhash64(digest)
    return [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]


def repeated_bits(digests: DataFrame, digest: str, bits: int) -> DataFrame:
    """Pass one: ``chunk`` and ``bitmap`` of the positions that two or more rows hit."""
    hits = digests.select(F.explode(F.array(*_positions(F.col(digest), bits))).alias("p")).groupBy("p").count()
    return (
        hits.filter("count >= 2")
        .groupBy(F.expr(f"p div {CHUNK}").alias("chunk"))
        .agg(F.bitmap_construct_agg(F.col("p") % CHUNK).alias("bitmap"))
    )


def maybe_repeated(rows: DataFrame, digest: str, filter_bits: DataFrame, bits: int) -> DataFrame:
    """Pass two: ``rows`` with a boolean ``maybe``, without a shuffle."""
    bitmap = F.broadcast(filter_bits)
    out = rows
    for i, p in enumerate(_positions(F.col(digest), bits)):
        side = bitmap.select(F.col("chunk").alias(f"_c{i}"), F.col("bitmap").alias(f"_b{i}"))
        place = F.expr(f"int(_p{i} % {CHUNK})")
        byte = F.conv(F.hex(F.substring(F.col(f"_b{i}"), F.expr(f"int(_p{i} % {CHUNK}) div 8 + 1").cast("int"), F.lit(1))), 16, 10)
        out = (
            out.withColumn(f"_p{i}", p)
            .join(side, F.expr(f"_p{i} div {CHUNK} = _c{i}"), "left")
            .withColumn(f"_m{i}", F.coalesce(F.getbit(byte.cast("int"), place % 8) == 1, F.lit(False)))
            .drop(f"_p{i}", f"_c{i}", f"_b{i}")
        )
    return out.withColumn("maybe", F.col("_m0") & F.col("_m1")).drop("_m0", "_m1")


def filter_bits(n_rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> int:
    wanted = max(CHUNK, n_rows * bits_per_row)
    return min(max_bits, 1 << (wanted - 1).bit_length())


def may_match(rows: DataFrame, keys: list[str], side: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: whether the key may be among those of ``side``; nothing of ``rows`` shuffles."""
    bits = filter_bits(side.count())
    key = side.select(F.xxhash64(*keys).alias("_key"))
    found = settle(repeated_bits(key.union(key), "_key", bits), "wanted")
    return maybe_repeated(rows.withColumn("_key", F.xxhash64(*keys)), "_key", found, bits).drop("_key")


def join_few(rows: DataFrame, keys: list[str], side: DataFrame) -> DataFrame:
    """Left join of ``rows`` with ``side`` (one row a key), in which rows that match nothing hardly ever shuffle."""
    values = [c for c in side.columns if c not in keys]
    tested = may_match(rows, keys, side)
    other = side.select(*[F.col(k).alias(f"_{k}") for k in keys], *values)
    some = tested.filter("maybe").join(other, [F.col(k) == F.col(f"_{k}") for k in keys], "left").select(*rows.columns, *values)
    kinds = dict(side.dtypes)
    none = tested.filter("NOT maybe").select(*rows.columns, *[F.lit(None).cast(kinds[v]).alias(v) for v in values])
    return none.unionByName(some)


def mark(
    rows: DataFrame,
    digest: str = "text_sha256",
    length: str = "text_length",
    ident: str = "doc_id",
    bits_per_row: int = BITS_PER_ROW,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``rows`` with ``keep_id``, ``group_size`` and ``kept`` by equal ``digest``."""
    key = rows[f"`{digest}`"]
    bits = filter_bits(rows.count(), bits_per_row, max_bits)
    found = settle(repeated_bits(rows.select(key.alias("digest")), "digest", bits), "repeated_bits")
    work = packed(rows, digest=key, length=rows[f"`{length}`"], ident=rows[f"`{ident}`"])
    work = maybe_repeated(work, "digest", found, bits)
    order = F.struct((-F.col("length")).alias("l"), F.col("ident").isNull().alias("n"), F.col("ident").alias("i"))
    equal = work.filter("maybe").groupBy("digest", order.alias("first")).agg(F.count(F.lit(1)).alias("rows"))
    groups = equal.groupBy("digest").agg(F.sum("rows").alias("group_size"), F.min(F.struct("first", "rows")).alias("m")).filter("group_size > 1")
    groups = settle(
        groups.select("digest", "group_size", F.col("m.first.i").alias("keep_id"), (-F.col("m.first.l")).alias("keep_length"), (F.col("m.rows") > 1).alias("tied")),
        "groups",
    )
    alone = work.filter("NOT maybe").select("row", F.col("ident").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    seen = work.filter("maybe").join(groups, "digest", "left")
    named = [
        "row",
        F.when(F.col("group_size").isNull(), F.col("ident")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
    ]
    won = F.col("group_size").isNull() | (F.col("ident").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length")))
    seen = seen.withColumn("won", won).withColumn("tied", F.col("won") & F.coalesce("tied", F.lit(False)))
    one = seen.filter("NOT tied").select(*named, F.col("won").alias("kept"))
    # Only rows that repeat id and text would all win; one of them does.
    again = Window.partitionBy("digest").orderBy(F.lit(0))
    ties = seen.filter("tied").withColumn("rank", F.row_number().over(again)).select(*named, (F.col("rank") == 1).alias("kept"))
    return unpacked(alone.unionByName(one).unionByName(ties), rows.columns, ADDED)


def dedup(docs: DataFrame, text: str = "text", ident: str = "doc_id", **sizes: int) -> DataFrame:
    """The documents that stay, with the columns of ``docs``."""
    work = packed(docs, i=column(docs, ident, "long"), t=column(docs, text, "string"))
    marked = mark(fingerprints(work, "t"), ident="i", **sizes)
    return marked.filter("kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])
