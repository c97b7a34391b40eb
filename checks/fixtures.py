"""Every input of the registered queries, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rxframe.functions import text
from rxframe.operators import matching
from rxframe.plans.lookup import Reference
from rxframe.session import settle
from rxframe.sources import catalogue

SPELLING = {"blue": "red", "cold": "hot"}
IGNORED = ["gear"]
LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate",
    "l_returnflag",
]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _text(c: str | Column) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _word(n: int) -> Column:
    return F.split_part("p_name", F.lit(" "), F.lit(n))


def _short_name() -> Column:
    return F.concat("p_name", F.lit(" "), _text("p_size"))


# --- prescriptions ------------------------------------------------------------


def rx_lines(
    spark: SparkSession, d: str, by_part: DataFrame | None = None, kind: str = "string", dealt: bool = True
) -> DataFrame:
    """Line items as prescription lines: rx_id, position, name, the source columns and those of ``by_part``, on ``l_partkey``.

    ``rx_id`` is the number of the order as a value of ``kind``.
    Parts are joined before the lines are numbered, so that the lines stay dealt out by ``rx_id``. Every line item counts in
    the positions, with a part or without and once, however many parts have its key: hence the rank over row numbers.
    Where nobody needs them ``dealt``, lines are numbered first: names do not travel to that, nor columns of the order to the parts.
    """
    items = table(spark, d, "lineitem").select("l_orderkey", *LINE_ORDER, F.monotonically_increasing_id().alias("_row"))
    order = Window.partitionBy("rx_id").orderBy(*LINE_ORDER, "_row")
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("l_partkey"), _short_name().alias("name"), F.lit(True).alias("_part")
    )

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rx_id", F.col("l_orderkey").cast(kind)).withColumn("position", F.dense_rank().over(order) - 1)

    items = items if dealt else numbered(items)
    joined, known = items.join(part, "l_partkey", "left"), F.col("_part")
    if by_part is not None:
        joined, known = joined.join(by_part.withColumn("_more", F.lit(True)), "l_partkey", "left"), known & F.col("_more")
    return (numbered(joined) if dealt else joined).filter(known).drop("_row", "_part", "_more")


def _medicine() -> Column:
    name, part = F.col("name"), F.col("l_partkey") % 8
    blank = F.col("l_orderkey") % 50 == 3
    spoken = (
        F.when(part == 0, F.lit(None).cast("string"))
        .when(part == 1, F.concat(F.substring(name, 1, 6), F.substr(name, F.lit(8))))
        .when(part == 2, F.concat(F.lit("Cap. "), F.upper(name)))
        .when(part == 3, F.replace(name, F.lit(" "), F.lit("  ")))
        .otherwise(name)
    )
    amount = F.col("l_quantity").cast("bigint") * F.when(
        F.col("l_partkey") % 101 == 0, F.lit(10000)
    ).otherwise(F.lit(1))
    kind = F.col("l_linenumber") % 5
    dosage = (
        F.when(kind == 1, F.concat(_text(amount), F.lit("mg")))
        .when(kind == 2, F.lit("1.2.3 ml"))
        .when(kind == 3, F.concat(_text(amount), F.lit(" mcg daily")))
        .when(kind == 4, F.lit("one tab"))
    )
    times, often = _text("l_linenumber"), F.col("l_suppkey") % 4
    frequency = (
        F.when(often == 1, F.concat(F.lit("BD x "), times, F.lit(" days")))
        .when(often == 2, F.concat(F.lit("OD × "), times))
        .when(often == 3, F.lit("HS"))
    )
    confidence = (
        F.when(F.col("l_linenumber") == 7, "unsure")
        .when(F.col("l_returnflag") == "A", "high")
        .when(F.col("l_returnflag") == "N", "Medium")
        .otherwise("low")
    )
    return F.struct(
        F.when(blank, " ").otherwise(F.concat(F.lit("Tab "), name)).alias("raw_text"),
        F.when(blank, "  ").otherwise(spoken).alias("normalized_name"),
        dosage.alias("dosage"),
        frequency.alias("frequency"),
        confidence.alias("confidence"),
    )


def captures(spark: SparkSession, d: str) -> DataFrame:
    """Bronze rows: one JSON document per order, some broken on purpose.

    The medicines of a document lie in the order of ``rx_lines``, but their numbers are not needed: the arrays are sorted by what
    the lines would be numbered by. So lines are dealt and sorted by the number of the order alone.
    """
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), _short_name().alias("name"))
    rows = table(spark, d, "lineitem").select("l_orderkey", *LINE_ORDER, F.monotonically_increasing_id().alias("_row"))
    lines = rows.join(part, "l_partkey").withColumn("rx_id", F.col("l_orderkey").cast("bigint"))
    items = (
        lines.repartition("rx_id")
        .sortWithinPartitions("rx_id")
        .select("rx_id", F.struct(*LINE_ORDER, "_row", _medicine().alias("m")).alias("item"))
        .groupBy("rx_id")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderkey").cast("bigint").alias("rx_id"))
    joined = orders.join(items, "rx_id", "left")
    document = F.to_json(
        F.struct(
            F.lit(True).alias("is_prescription"),
            F.coalesce(F.col("items.m"), F.array()).alias("medicines"),
            F.lit("").alias("notes"),
        )
    )
    kind = F.col("o_orderkey") % 50
    return joined.select(
        F.concat(F.lit("run_"), F.date_format("o_orderdate", "yyyyMM")).alias("pipeline_run_id"),
        F.sha2(_text("o_orderkey"), 256).alias("source_file_hash"),
        F.when(kind == 0, F.substring(document, 1, 20))
        .when(kind == 1, "[1]")
        .when(kind == 2, "{}")
        .otherwise(document)
        .alias("raw_response"),
        F.lit("reader-1").alias("model_name"),
        F.lit("local").alias("model_provider"),
        F.lit("v1").alias("prompt_version"),
        F.col("o_orderdate").cast("timestamp").alias("ingested_at"),
        F.trunc("o_orderdate", "month").alias("ingest_date"),
    )


def processed_at() -> Column:
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


# --- catalogue ----------------------------------------------------------------


def catalogue_rows(spark: SparkSession, d: str) -> DataFrame:
    """Product list as text columns, one row per part."""
    key = F.col("p_partkey")
    second = F.concat(
        _word(2), F.lit(" "), _text((F.col("p_size") % 5 + 1) * 10), F.lit("mg")
    )
    return table(spark, d, "part").select(
        key.alias("pos"),
        F.concat(_short_name(), F.lit(" Tablet")).alias("name"),
        F.when(key % 97 == 0, "N/A")
        .when(key % 89 == 0, "0")
        .otherwise(_text("p_retailprice"))
        .alias("price"),
        F.when(F.col("p_type") == "PROMO", " true ").otherwise("FALSE").alias("is_discontinued"),
        F.col("p_brand").alias("pack"),
        F.concat(_word(1), F.lit(" ("), _text("p_size"), F.lit("mg)")).alias("short_composition1"),
        F.when(F.col("p_type") != "SMALL", second).alias("short_composition2"),
    )


def products(spark: SparkSession, d: str) -> DataFrame:
    return catalogue.import_products(catalogue_rows(spark, d), SPELLING)


def stored_products(spark: SparkSession, d: str) -> DataFrame:
    """The products as a written table, for queries that read them several times."""
    return settle(products(spark, d), "products")


def curated_source(spark: SparkSession, d: str) -> DataFrame:
    """Curated brands: one per name and size among the promotional parts."""
    first = F.min(F.struct("p_partkey", "p_retailprice", "p_brand")).alias("f")
    grouped = (
        table(spark, d, "part")
        .filter("p_type = 'PROMO'")
        .groupBy("p_name", "p_size")
        .agg(first)
        .select("p_name", "p_size", "f.*")
    )
    strength = _text((F.col("p_size") % 5 + 1) * 10)
    return grouped.select(
        F.col("p_partkey").alias("pos"),
        F.concat("p_name", F.lit("-"), _text("p_size")).alias("brand"),
        F.concat(
            _word(1), F.lit(" "), _text("p_size"), F.lit("mg + "), _word(2), F.lit(" "), strength,
            F.lit("mg"),
        ).alias("salt"),
        F.array(_word(1), _word(2)).alias("salt_keys"),
        F.col("p_brand").alias("category"),
        F.lit("10 tablets").alias("pack"),
        F.col("p_retailprice").alias("brand_price"),
        F.struct(
            F.col("p_name").alias("name"), F.round(F.col("p_retailprice") * 0.4, 2).alias("price")
        ).alias("generic"),
        F.array(F.concat(_word(2), F.lit(" "), _word(1))).alias("extra_aliases"),
        "p_size",
    )


def curated(spark: SparkSession, d: str) -> DataFrame:
    rows = curated_source(spark, d)
    return rows.withColumn("aliases", text.aliases(F.col("brand"), F.col("extra_aliases"))).drop(
        "extra_aliases", "p_size"
    )


def entries(spark: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    items = products(spark, d) if items is None else items
    return matching.entries(
        curated(spark, d), items, catalogue.signature_groups(items), SPELLING
    )


def terms(spark: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    return matching.term_index(curated(spark, d), products(spark, d) if items is None else items)


def stored_terms(spark: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    """The search terms as a written table: matching reads them several times."""
    return settle(terms(spark, d, items), "terms")


def rules(spark: SparkSession, d: str) -> DataFrame:
    """Interaction rules: one per distinct part name, between its two words."""
    return (
        table(spark, d, "part")
        .groupBy("p_name")
        .agg(F.min("p_partkey").alias("rule_pos"))
        .select(
            F.array(_word(1), _word(2)).alias("salts"),
            F.when((F.ascii(_word(1)) + F.ascii(_word(2))) % 2 == 0, "major")
            .otherwise("moderate")
            .alias("severity"),
            F.concat(F.lit("effect of "), "p_name").alias("effect"),
            F.concat(F.lit("advice on "), "p_name").alias("advice"),
            "rule_pos",
        )
    )


def reference(spark: SparkSession, d: str) -> Reference:
    items = stored_products(spark, d)
    return Reference(stored_terms(spark, d, items), entries(spark, d, items), items, rules(spark, d))


def baskets(spark: SparkSession, d: str) -> DataFrame:
    """Prescription lines already tied to a product."""
    items = products(spark, d).withColumnsRenamed({"pos": "l_partkey", "name": "brand"})
    return rx_lines(spark, d, items).select(
        "rx_id",
        "l_orderkey",
        "position",
        "brand",
        "salt",
        "salt_keys",
        "signature",
        F.col("price").alias("brand_price"),
    )


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Look-up lines, one request per order; they are numbered by its number, which is shorter than its text."""
    m = _medicine()
    return rx_lines(spark, d, kind="bigint", dealt=False).select(
        F.col("rx_id").cast("string").alias("rx_id"),
        "position",
        *[m[c].alias(c) for c in ("raw_text", "normalized_name", "dosage", "frequency", "confidence")],
    )


# --- stores -------------------------------------------------------------------


def offices(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    lat = (F.lit(8) + (key * 37 % 280) / 10).cast("decimal(6,1)")
    lng = (F.lit(69) + (key * 53 % 280) / 10).cast("decimal(6,1)")
    return table(spark, d, "customer").select(
        F.concat(F.lit(" "), F.lpad(_text(key % 60), 6, "0")).alias("pincode"),
        F.when(key % 23 == 0, "0").when(key % 29 == 0, "NA").otherwise(_text(lat)).alias("latitude"),
        _text(lng).alias("longitude"),
    )


def store_documents(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    store = F.struct(
        F.lpad(_text(key), 9, "0").alias("code"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("Road "), _text(key)).alias("address"),
        F.concat(F.lit("District "), _text("s_nationkey")).alias("district"),
        F.concat(F.lit("State "), _text(F.col("s_nationkey") % 5)).alias("state"),
    )
    pin = F.lpad(_text(key % 70), 6, "0")
    return table(spark, d, "supplier").select(
        F.to_json(F.create_map(pin, F.array(store))).alias("value")
    )


def probes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        key.alias("probe"),
        F.when(key % 23 == 0, 0.0)
        .otherwise((F.lit(8) + (key * 37 % 280) / 10).cast("decimal(6,1)").cast("double"))
        .alias("lat"),
        (F.lit(69) + (key * 53 % 280) / 10).cast("decimal(6,1)").cast("double").alias("lng"),
    )


# --- people -------------------------------------------------------------------


def feedback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.when(F.col("event_type") == "error", "wrong").otherwise("correct").alias("verdict"),
        F.concat(F.lit("brand_"), _text(F.col("user_id") % 40)).alias("matched_brand"),
    )


def scans(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    medicine = lambda brand, query: F.struct(brand.alias("brand"), query.alias("query"))
    no = F.lit(None).cast("string")
    result = F.struct(
        F.array(
            medicine(F.col("o_orderpriority"), F.lit("q")),
            medicine(no, F.concat(F.lit("q"), _text("o_custkey"))),
        ).alias("medicines"),
        F.when(
            key % 17 != 0, F.struct(F.col("o_totalprice").cast("decimal(18,2)").alias("saving"))
        ).alias("totals"),
        F.array_repeat(F.struct(F.lit("major").alias("severity")), (key % 4).cast("int")).alias(
            "interactions"
        ),
    )
    return table(spark, d, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.lit("scan").alias("source"),
        F.unix_timestamp("o_orderdate").alias("created_at"),
        F.to_json(result).alias("result"),
    )


def saved_requests(spark: SparkSession, d: str) -> DataFrame:
    """Names each customer asks to save: up to three parts, the first one asked twice."""
    key = F.col("c_custkey")
    asked = table(spark, d, "customer").select(
        key.alias("user_id"),
        F.posexplode(F.array(key, key + 211, key + 409, key)).alias("nth", "p_partkey"),
    )
    part = table(spark, d, "part").select("p_partkey", _short_name().alias("name"))
    return asked.join(part, "p_partkey").select(
        "user_id", (F.col("user_id") * 4 + F.col("nth")).alias("id"), "p_partkey", "name"
    )


def user_meds(spark: SparkSession, d: str) -> DataFrame:
    items = products(spark, d).select(
        F.col("pos").alias("p_partkey"), F.col("name").alias("brand"), "salt", "salt_keys"
    )
    return saved_requests(spark, d).join(items, "p_partkey").drop("p_partkey", "name")


def patients(spark: SparkSession, d: str) -> DataFrame:
    """A weight and a medicine per customer."""
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("c_custkey"), F.array(_word(1), _word(2)).alias("salt_keys")
    )
    return (
        table(spark, d, "customer")
        .select("c_custkey", (F.lit(1) + (F.col("c_custkey") % 620) / 10).alias("weight_kg"))
        .join(part, "c_custkey")
        .withColumnRenamed("c_custkey", "patient")
    )


def dose_rules(spark: SparkSession, d: str) -> DataFrame:
    """Dosing rules from the parts: one per first word, one per two-word name."""
    part = table(spark, d, "part").filter("p_partkey IS NOT NULL")

    def level(name: Column, salts: Column, offset: int) -> DataFrame:
        grouped = (
            part.withColumn("id", name)
            .groupBy("id")
            .agg(
                F.min("p_partkey").alias("at"),
                F.min("p_size").alias("least"),
                F.max("p_size").alias("most"),
                F.max("p_retailprice").alias("dear"),
            )
            .withColumn("p_name", F.col("id"))
        )
        fixed = F.col("id").endswith("anvil")
        per_kg = ~fixed
        cap = F.round(F.col("dear"), 0)
        return grouped.select(
            "id",
            F.concat(F.lit("Label of "), "id").alias("label"),
            salts.alias("salts"),
            F.when(fixed, "fixed").otherwise("per_kg").alias("type"),
            F.when(per_kg, F.col("least") / 2).alias("mg_per_kg_low"),
            F.when(per_kg, F.col("most").cast("double")).alias("mg_per_kg_high"),
            F.lit("twice daily").alias("frequency"),
            F.lit(3).alias("max_doses_per_day"),
            F.when(per_kg, cap).alias("max_single_mg"),
            (F.ascii("id") % 24).alias("min_age_months"),
            F.when(
                per_kg,
                F.array(
                    F.struct(F.lit("Drops").alias("label"), F.lit(100.0).alias("mg_per_ml")),
                    F.struct(F.lit("Syrup").alias("label"), F.lit(24.0).alias("mg_per_ml")),
                ),
            ).alias("syrups"),
            F.when(
                fixed,
                F.array(
                    F.struct(
                        F.lit("2-5 years").alias("age_label"),
                        F.col("most").cast("double").alias("dose_mg"),
                        F.lit("half").alias("dose_text"),
                    )
                ),
            ).alias("fixed_doses"),
            F.lit("With food.").alias("notes"),
            (F.col("at") * 2 + offset).alias("rule_pos"),
        )

    return level(_word(1), F.array(_word(1)), 0).unionByName(
        level(F.col("p_name"), F.array(_word(1), _word(2)), 1)
    )


def access_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("client"), "ts")


def landing_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Document texts as file contents."""
    return table(spark, d, "documents").select(
        F.concat(F.lit("scan_"), _text("doc_id"), F.lit(".JPG")).alias("path"),
        F.encode("text", "utf-8").alias("content"),
    )


def runs(captured: DataFrame) -> DataFrame:
    """One run per month of captures."""
    return captured.groupBy("pipeline_run_id").agg(
        F.min("ingested_at").alias("run_started_at"),
        F.max("ingested_at").alias("run_finished_at"),
        F.create_map(F.lit("match"), F.lit(1.5)).alias("stage_durations_sec"),
        F.lit("success").alias("status"),
    )
