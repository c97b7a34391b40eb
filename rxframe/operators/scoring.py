"""Best candidate per query text inside blocks, without a row per pair.

Both sides are cut into bounded chunks. A chunk of queries meets a chunk of candidates as one row with
two arrays, and the scoring task returns one winner per query. The chunk key is spread over the
chunks of both sides, so a block holding a third of all names becomes many equal rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxframe.functions import similarity

QUERY_CHUNK = 128
CANDIDATE_CHUNK = 1024
QUERY_CHUNKS_PER_KEY = 4
NEVER = 2**31 - 1


def _scorer(scorer: str, whole: bool, cutoff: float):
    @F.pandas_udf("idx array<int>, score array<double>")
    def score(queries: pd.Series, candidates: pd.Series) -> pd.DataFrame:
        found = [
            similarity.best_candidates(list(q), list(c), scorer, whole, cutoff)
            for q, c in zip(queries, candidates)
        ]
        return pd.DataFrame(
            {"idx": [i.astype("int32") for i, _ in found], "score": [s for _, s in found]}
        )

    return score


def _edit(cutoff: float, whole: bool) -> Column:
    """The same by Spark's own edit distance: 100 x (1 - distance / longer length), for each query of the chunk.

    The best so far (at first ``cutoff``) bounds the distance that the next candidate may have, so a pair that cannot
    win or tie is given up after a few diagonals.
    """
    none = F.struct(F.lit(-float(cutoff)).alias("rank"), F.lit(NEVER).alias("gap"), F.get("c_items", F.lit(-1)).alias("item"))

    def best(q):
        def better(so_far, c):
            longer = F.greatest(q["n"], c["n"])
            # The small addition keeps ties in spite of rounding; it only lets a pair in that is then compared.
            limit = F.floor(longer * (so_far["rank"] + 100.0) / 100.0 + 1e-6).cast("int")
            # Beyond the limit the distance is -1, here a number that no candidate can win with.
            distance = F.pmod(F.call_function("levenshtein", q["text"], c["text"], limit), F.lit(NEVER))
            score = (longer - distance) * F.lit(100.0) / F.greatest(longer, F.lit(1))
            score = F.floor(score).cast("double") if whole else score
            gap = F.abs(q["n"] - c["n"]) if whole else F.lit(0)
            return F.least(so_far, F.struct((-score).alias("rank"), gap.alias("gap"), c.alias("item")))

        found = F.aggregate("c_items", none, better)
        return F.transform(
            F.array(found), lambda f: F.struct(q["text"].alias("text"), f["item"].alias("item"), (-f["rank"]).alias("score"))
        )[0]

    measured = F.transform("q_texts", lambda q: F.struct(q.alias("text"), F.length(q).alias("n")))
    return F.filter(F.transform(measured, best), lambda w: w["item"].isNotNull())


def _chunks(counts: Column, size: int) -> Column:
    return F.ceil(counts / size).cast("int")


def best_per_query(
    queries: DataFrame,
    candidates: DataFrame,
    scorer: str = "weighted",
    whole: bool = True,
    cutoff: float = 0.0,
) -> DataFrame:
    """queries(block, text), candidates(block, text, ord) -> (text, candidate, ord, score).

    Texts are distinct per block on both sides; ``ord`` is any orderable column that breaks ties.
    Queries without a candidate at ``cutoff`` are left out.
    """
    spark = queries.sparkSession
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        4 * spark.sparkContext.defaultParallelism,
    )
    sizes = (
        candidates.groupBy("block")
        .agg(F.count(F.lit(1)).alias("n_c"))
        .join(queries.groupBy("block").agg(F.count(F.lit(1)).alias("n_q")), "block")
        .select(
            "block",
            _chunks(F.col("n_c"), CANDIDATE_CHUNK).alias("c_chunks"),
            _chunks(F.col("n_q"), QUERY_CHUNK).alias("q_chunks"),
            _chunks(F.col("n_q"), QUERY_CHUNK * QUERY_CHUNKS_PER_KEY).alias("salts"),
        )
    )
    spread = F.xxhash64("text")
    # The join with ``sizes`` may leave rows spread by block alone, so chunks are spread explicitly.
    left = (
        queries.join(sizes, "block")
        .withColumn("q_chunk", F.pmod(spread, F.col("q_chunks")))
        .repartition(tasks, "block", "q_chunk")
        .groupBy("block", "q_chunk", "c_chunks", "salts")
        .agg(F.collect_list("text").alias("q_texts"))
        .select(
            "block",
            F.explode(F.sequence(F.lit(0), F.col("c_chunks") - 1)).alias("c_chunk"),
            F.pmod("q_chunk", "salts").cast("int").alias("salt"),
            "q_texts",
        )
        .repartition(tasks, "block", "c_chunk", "salt")
    )
    right = (
        candidates.join(sizes, "block")
        .withColumn("c_chunk", F.pmod(spread, F.col("c_chunks")).cast("int"))
        .repartition(tasks, "block", "c_chunk")
        .groupBy("block", "c_chunk", "salts")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "text", F.length("text").alias("n")))).alias("c_items"))
        .select(
            "block",
            "c_chunk",
            F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
            "c_items",
        )
        .repartition(tasks, "block", "c_chunk", "salt")
    )
    met = left.join(right, ["block", "c_chunk", "salt"])
    if scorer == "edit":
        each = met.select(F.explode(_edit(cutoff, whole)).alias("w"))
    else:
        scored = _scorer(scorer, whole, cutoff)("q_texts", F.col("c_items.text"))
        rows = F.transform(
            F.arrays_zip("q_texts", "found.idx", "found.score"),
            lambda z: F.struct(
                z["q_texts"].alias("text"),
                F.get("c_items", z["idx"]).alias("item"),
                z["score"].alias("score"),
            ),
        )
        found = met.select("q_texts", "c_items", scored.alias("found"))
        each = found.select(F.explode(F.filter(rows, lambda w: w["item"].isNotNull())).alias("w"))
    winners = each.select("w.text", "w.item", "w.score")
    gap = F.abs(F.length("text") - F.length("item.text")) if whole else F.lit(0)
    best = winners.groupBy("text").agg(
        F.min(F.struct((-F.col("score")).alias("rank"), gap.alias("gap"), "item")).alias("best")
    )
    return best.select(
        "text",
        F.col("best.item.text").alias("candidate"),
        F.col("best.item.ord").alias("ord"),
        (-F.col("best.rank")).alias("score"),
    )
