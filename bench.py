"""Headline timings. Prints one JSON line.

Inputs (captures, catalogue, baskets) are stored first and timed apart as ``prepare``; every query is
run once cold and three times warm, and the warm median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from checks import fixtures as X  # noqa: E402
from rxframe import session  # noqa: E402
from rxframe.operators import alternatives, matching, quality, safety, sampling  # noqa: E402
from rxframe.operators.captures import parse_captures  # noqa: E402
from rxframe.sinks import upsert as U  # noqa: E402
from rxframe.sources import catalogue  # noqa: E402


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    begin = time.perf_counter()
    captures = session.settle(X.captures(spark, d), "captures")
    products = session.settle(X.products(spark, d), "products")
    rows = session.settle(X.catalogue_rows(spark, d), "catalogue_rows")
    baskets = session.settle(X.baskets(spark, d), "baskets")
    curated = session.settle(X.curated(spark, d), "curated")
    lines = session.settle(
        quality.check(parse_captures(captures, X.processed_at())).filter("rejection_reason IS NULL"),
        "lines",
    )
    prepare = time.perf_counter() - begin
    groups = catalogue.signature_groups(products)
    terms = session.settle(matching.term_index(curated, products), "terms")
    rules = X.rules(spark, d)
    items = X.table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    newest = [F.col("l_shipdate").desc(), F.col("l_partkey").desc(), F.col("l_suppkey").desc()]

    def noisy(n: int):
        return session.settle(
            sampling.noisy_sample(products.select("pos", "name"), n).select(
                "line_id",
                F.lit("benchmark").alias("source_file_hash"),
                F.col("noisy").alias("drug_name_normalized"),
                F.lit("benchmark").alias("pipeline_run_id"),
            ),
            f"noisy_{n}",
        )

    few, many = noisy(500), noisy(5000)
    keep = session.settle

    def upsert():
        path = f"{session.scratch_root(spark)}/silver"
        cut = F.lit("1999-01-01").cast("timestamp")
        U.upsert(items.filter(F.col("l_shipdate") < cut), path, keys, newest, 8)
        U.upsert(items.filter(F.col("l_shipdate") >= cut), path, keys, newest, 8)
        return U.read_table(spark, path)

    names = lines.select("line_id", F.col("drug_name_normalized").alias("name"))
    queries = {
        "fuzzy_match_500": lambda: matching.match_lines(few, products, groups, keep=keep),
        "fuzzy_match_5000": lambda: matching.match_lines(many, products, groups, keep=keep),
        "fuzzy_match_wratio": lambda: matching.match_lines(lines, products, groups, keep=keep),
        "fuzzy_match_levenshtein": lambda: matching.match_lines(lines, products, groups, "edit", keep=keep),
        "tiered_match": lambda: matching.tiered_match(names, terms, keep=keep),
        "parse_and_validate": lambda: quality.check(parse_captures(captures, X.processed_at())),
        "silver_upsert": upsert,
        "interaction_pairs": lambda: safety.interactions(baskets, rules, keep=keep),
        "catalogue_import": lambda: catalogue.import_products(rows, X.SPELLING),
        "signature_groups": lambda: catalogue.signature_groups(products),
        "alternatives": lambda: alternatives.with_alternatives(
            products.withColumnRenamed("name", "brand"), products
        ),
    }
    warm, cold = {}, {}
    for name, build in queries.items():
        times = []
        for _ in range(4):
            start = time.perf_counter()
            build().write.mode("overwrite").format("noop").save()
            times.append(time.perf_counter() - start)
        cold[name] = round(times[0], 3)
        warm[name] = round(statistics.median(times[1:]), 3)
    line = {
        "metric": "total_warm_seconds",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "prepare": round(prepare, 3),
        "lines": lines.count(),
        "products": products.count(),
        "sf": os.path.basename(d).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
