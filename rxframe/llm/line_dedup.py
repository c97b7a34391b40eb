"""Line dedup: repeated runs of lines from a suffix array over line ids, built by distributed prefix doubling.

Non-blank lines of all documents, in order of document and line, are one sequence of line ids. Level t ranks every
position by the 2**t lines that start there: equal windows share a rank, and ranks keep the order of the suffix
array. The next level ranks the pairs (rank here, rank 2**t lines further on); positions whose window occurs once
leave the array, since no repeated run can start there.

A run counts if it has ``min_words`` words. The shortest windows with that many words, from a line onwards and up to a
line, have at most ``min_words`` lines, so levels up to log2(min_words) are enough: two overlapping windows of the
last level below its length name the interval of the suffix array whose suffixes share that prefix. Every position
of an interval but the first in the text starts a later copy. Each line of a longer repeated run is in one of these
windows, so joining the marked lines gives the maximal runs, and those lines are deleted. Windows never reach over
the end of a document.

All steps are SQL functions. Ranks are running sums over distinct pairs, and lines are grouped by partial
aggregates, so a very common line is one row per task before it meets its copies.

Defined cases: null text stays null and has no lines; blank lines are kept and do not interrupt a run; a null id
sorts after all others; rows that repeat id and text are one document to the array and lose the same lines; an
empty table gives an empty result; input columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rxframe.llm import exact_dedup
from rxframe.llm.common import SPACE, WORD, column, packed, running, unpacked
from rxframe.session import settle

MIN_WORDS = 50
#: Parts of the rank space that running sums are taken over.
PARTS = 4096
ADDED = ["clean_text", "n_lines", "n_deleted"]
DOC = ["k", "h"]
HERE = ["k", "h", "j"]


def _lines(body: Column) -> Column:
    return F.split(body, "\n", -1)


def keyed(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """``docs`` packed, with document key ``k`` (id, null as the greatest) and ``h`` (hash of the text), and ``text``."""
    body = column(docs, text, "string")
    return packed(docs, k=F.coalesce(column(docs, ident, "long"), F.lit(2**63 - 1)), h=F.xxhash64(body), text=body)


def positions(rows: DataFrame, min_words: int) -> DataFrame:
    """Non-blank lines: ``k``, ``h``, raw line ``i``, place ``j``, ``digest``, and the lines of the shortest windows.

    ``after`` counts from this line on and ``before`` up to it; null where the document has too few words there.
    """
    lines = rows.select("k", "h", F.posexplode(_lines(F.col("text"))).alias("i", "line"))
    lines = lines.select(
        "k", "h", "i", F.unhex(F.md5("line")).alias("digest"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("w")
    ).filter("w > 0")
    inside = Window.partitionBy(*DOC).orderBy("i")
    # Repeated rows give the same lines again; each counts once.
    lines = lines.dropDuplicates([*DOC, "i"])
    lines = lines.withColumn("j", F.row_number().over(inside)).withColumn("end", F.sum("w").over(inside))
    lines = lines.withColumn("start", F.col("end") - F.col("w")).withColumn("all", F.sum("w").over(Window.partitionBy(*DOC)))
    after = F.count(F.lit(1)).over(Window.partitionBy(*DOC).orderBy("start").rangeBetween(0, min_words - 1))
    before = F.count(F.lit(1)).over(Window.partitionBy(*DOC).orderBy("end").rangeBetween(1 - min_words, 0))
    return lines.select(
        "k", "h", "i", "j", "digest",
        F.when(F.col("all") - F.col("start") >= min_words, after).alias("after"), F.when(F.col("end") >= min_words, before).alias("before"),
    )


def windows(lines: DataFrame) -> DataFrame:
    """The shortest windows of enough words: ``k``, ``h``, first line ``j`` and ``len``."""
    onward = lines.filter("after IS NOT NULL").select("k", "h", "j", F.col("after").alias("len"))
    # Where a window is the shortest both ways, one row is enough.
    back = lines.filter("before IS NOT NULL").select("k", "h", (F.col("j") - F.col("before") + 1).cast("int").alias("j"), F.col("before").alias("len"))
    return onward.unionByName(back).distinct()


def _place() -> Column:
    return F.struct(*HERE)


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of ``keys`` with two places or more: ``n`` and the ``first`` place."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(_place()).alias("first"), F.max(_place()).alias("last"))
    return groups.filter("first != last").drop("last")


def _join(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of their group."""
    renamed = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    joined = rows.join(renamed, [F.col(k) == F.col(f"_{k}") for k in keys])
    return joined.drop(*[f"_{k}" for k in keys])


def _ahead(level: DataFrame, by: Column | int) -> DataFrame:
    """Positions of ``level`` with the rank ``c2`` that starts ``by`` lines further on in the same document."""
    after = level.select(F.col("k").alias("_k"), F.col("h").alias("_h"), F.col("j").alias("_j"), F.col("c").alias("c2"))
    return level.join(after, (F.col("k") == F.col("_k")) & (F.col("h") == F.col("_h")) & (F.col("j") + by == F.col("_j"))).drop("_k", "_h", "_j")


def first_ranks(lines: DataFrame) -> DataFrame:
    """Level 0: positions of repeated lines with the rank ``c`` of the line among all repeated ones."""
    groups = settle(_repeated(lines, ["digest"]), "lines")
    part = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    ranked = running(groups.withColumn("part", part), [], "part", ["digest"], "n", "upto")
    ranked = settle(ranked.select("digest", (F.col("upto") - F.col("n")).alias("c")), "ranks")
    return _join(lines, ranked, ["digest"]).drop("digest")


def doubled(level: DataFrame, step: int, total: int) -> DataFrame:
    """The next level from windows of ``step`` lines; ``total`` bounds the ranks."""
    pairs = settle(_ahead(level, step), "pairs")
    groups = settle(_repeated(pairs, ["c", "c2"]), "pair_groups")
    # Inside the block of one rank, pairs are ordered by the second rank.
    part = F.floor(F.col("c2") * PARTS / max(1, total))
    ranked = running(groups.withColumn("part", part), ["c"], "part", ["c2"], "n", "upto")
    ranked = settle(ranked.select("c", "c2", (F.col("c") + F.col("upto") - F.col("n")).alias("rank")), "ranks")
    return _join(pairs, ranked, ["c", "c2"]).drop("c", "c2").withColumnRenamed("rank", "c")


def later_copies(shortest: DataFrame, level: DataFrame, t: int) -> DataFrame:
    """Later copies among the windows of 2**t to 2**(t+1) - 1 lines: ``k``, ``h``, ``j`` and ``len``."""
    own = shortest.filter(F.col("len").between(2**t, 2 ** (t + 1) - 1))
    ranks = level.select("k", "h", "j", "c")
    own = _join(own, ranks, HERE).withColumn("at", (F.col("j") + F.col("len") - 2**t).cast("int"))
    after = ranks.withColumnsRenamed({"j": "at", "c": "c2"})
    own = settle(own.withColumn("c2", F.col("c")) if t == 0 else _join(own, after, [*DOC, "at"]), "windows")
    groups = settle(_repeated(own, ["len", "c", "c2"]).drop("n"), "intervals")
    return _join(own, groups, ["len", "c", "c2"]).filter(_place() != F.col("first")).select("k", "h", "j", "len")


def repeated_lines(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``k``, ``h`` and raw line ``i`` of every line inside a later copy of a run."""
    lines = settle(positions(rows, min_words), "positions")
    total, shortest = lines.count(), settle(windows(lines), "shortest")
    level, marks = settle(first_ranks(lines.select(*HERE, "digest")), "level"), None
    for t in range(min_words.bit_length()):
        found = later_copies(shortest, level, t)
        marks = found if marks is None else marks.unionByName(found)
        if 2 ** (t + 1) > min_words or level.isEmpty():
            break
        level = settle(doubled(level, 2**t, total), "level")
    covered = marks.select("k", "h", F.explode(F.sequence("j", (F.col("j") + F.col("len") - 1).cast("int"))).alias("j")).distinct()
    return _join(lines, covered, HERE).select("k", "h", "i")


def runs(deleted: DataFrame) -> DataFrame:
    """Maximal runs of deleted lines: ``k``, ``h``, ``start`` and ``lines`` (blank lines end a run here)."""
    inside = Window.partitionBy(*DOC).orderBy("i")
    numbered = deleted.withColumn("run", F.col("i") - F.row_number().over(inside))
    return numbered.groupBy(*DOC, "run").agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("lines")).drop("run")


def dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``clean_text``, ``n_lines`` (non-blank) and ``n_deleted``. Documents that lose nothing do not shuffle."""
    rows = keyed(docs, ident, text)
    gone = repeated_lines(rows.select("k", "h", "text"), min_words).groupBy(*DOC).agg(F.collect_set("i").alias("gone"))
    both = exact_dedup.join_few(rows, DOC, settle(gone, "gone"))
    left = F.filter(_lines(F.col("text")), lambda x, i: ~F.array_contains(F.col("gone"), i))
    blank = rf"(?s)^{SPACE}*$"
    n = F.size(F.filter(_lines(F.col("text")), lambda x: ~x.rlike(blank)))
    out = both.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("clean_text"),
        F.when(F.col("text").isNull(), 0).otherwise(n).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_deleted"),
    )
    return unpacked(out, docs.columns, ADDED)
