"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rxframe.session import settle


def _settled(rows: DataFrame, name: str, count: str) -> tuple[DataFrame, int]:
    """``rows`` stored, and how many of them meet ``count``, taken while writing."""
    seen = Observation()
    stored = settle(rows.observe(seen, F.count_if(F.expr(count)).alias("n")), name)
    return stored, seen.get["n"]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every vertex with a link.

    Each round hangs every vertex on its smallest neighbour, shortens the chains by pointer jumping and joins
    links by their roots; links inside one root go. Rounds and jumps grow with the logarithm of the longest
    chain. Nothing but counts reaches the driver, and every round is stored, so a lost executor costs one round.
    """
    edges = settle(
        links.select(F.least(a, b).cast("long").alias("a"), F.greatest(a, b).cast("long").alias("b")).filter("a < b").distinct(), "links"
    )
    known: DataFrame | None = None
    while True:
        both = edges.unionByName(edges.select(F.col("a").alias("b"), F.col("b").alias("a")))
        parents = both.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("up")).select("id", F.least("id", "up").alias("up"))
        parents = settle(parents, "parents")
        while True:
            above = parents.select(F.col("id").alias("_id"), F.col("up").alias("_up"))
            jumped = parents.join(above, F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up"), (F.col("up") != F.col("_up")).alias("moved"))
            jumped, moved = _settled(jumped, "jumps", "moved")
            parents = jumped.select("id", "up")
            if not moved:
                break
        if known is None:
            known = parents.select("id", F.col("up").alias("component"))
        else:
            step = parents.select(F.col("id").alias("_id"), "up")
            known = known.join(step, F.col("component") == F.col("_id"), "left").select("id", F.coalesce("up", "component").alias("component"))
            known = settle(known, "components")
        left = parents.select(F.col("id").alias("_a"), F.col("up").alias("ra"))
        right = parents.select(F.col("id").alias("_b"), F.col("up").alias("rb"))
        rest = edges.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).filter("ra != rb")
        edges, n = _settled(rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links", "true")
        if not n:
            return known
