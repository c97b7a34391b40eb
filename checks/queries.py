"""Registered queries: operators applied to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import fixtures as X
from rxframe import session
from rxframe.functions import composition, geo, money, text
from rxframe.operators import (
    alternatives,
    curated,
    dosing,
    matching,
    nearest,
    quality,
    quota,
    reports,
    safety,
    sampling,
)
from rxframe.operators.captures import parse_captures
from rxframe.plans import lookup, pipeline
from rxframe.sinks import upsert as U
from rxframe.sinks.layers import Layers, flat_metrics
from rxframe.sources import catalogue, landing, stores
from rxframe.streaming import ingest
from rxframe.streaming import quota as quota_stream_form

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DAY = "yyyy-MM-dd"
LANDING_RECORDS = 251  # documents a landing file, some MB; odd, so that repeated runs of rows do not make equal files
EDIT_THRESHOLD = 60  # prescriptions leave out the "Tablet" of the product name


def query(fn):
    QUERIES[fn.__name__] = lambda spark, d: fn(session.prepare(spark), d.rstrip("/"))
    return fn


def _joined(c, sep: str = ","):
    return F.array_join(c, sep)


def _json(c):
    return F.to_json(c)


def _map_text(c):
    """A map as sorted key=value text."""
    pairs = F.array_sort(F.map_entries(c))
    return F.array_join(
        F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )


def _lines(spark, d):
    return quality.check(parse_captures(X.captures(spark, d), X.processed_at()))


def _clean(spark, d):
    return _lines(spark, d).filter("rejection_reason IS NULL")


def _clean_names(spark, d, *more):
    """The clean lines as a written table: matching reads them twice, once for the distinct names."""
    return session.settle(_clean(spark, d).select("line_id", *more), "clean")


def _layers(spark) -> Layers:
    return Layers(session.scratch_root(spark), buckets=8)


LINE_COLUMNS = [
    "line_id", "source_file_hash", "drug_name_raw", "drug_name_normalized", "dosage_value",
    "dosage_unit", "frequency", "quantity", "extraction_confidence", "pipeline_run_id",
]
MATCH_INPUT = ["source_file_hash", "drug_name_normalized", "pipeline_run_id"]
MATCH_COLUMNS = [
    "line_id", "source_file_hash", "drug_name_normalized", "matched_product", "matched_salt",
    "match_score", "match_method", "brand_price", "generic_name", "generic_price", "saving",
    "pipeline_run_id",
]


# --- captures and quality -----------------------------------------------------


@query
def parse_lines(spark, d):
    return parse_captures(X.captures(spark, d), X.processed_at()).select(
        *LINE_COLUMNS, "rejection_reason"
    )


@query
def validate_lines(spark, d):
    return _lines(spark, d).select("line_id", "source_file_hash", "rejection_reason")


@query
def quarantine_summary(spark, d):
    checked = _lines(spark, d)
    return quality.failure_counts(checked, "pipeline_run_id")


@query
def failure_summary(spark, d):
    return quality.failure_summary(_lines(spark, d)).select(
        _map_text("validation_failures").alias("validation_failures")
    )


@query
def prescription_gate(spark, d):
    kept = quality.prescriptions_only(X.captures(spark, d))
    return kept.groupBy("pipeline_run_id").agg(F.count(F.lit(1)).alias("captures"))


# --- catalogue ----------------------------------------------------------------


@query
def catalogue_import(spark, d):
    return X.products(spark, d).select(
        "pos", "name", "name_norm", "block_key", "salt", _joined("salt_keys").alias("salt_keys"),
        "pack", "price", "signature",
    )


@query
def signature_groups(spark, d):
    return catalogue.signature_groups(X.products(spark, d))


@query
def composition_parts(spark, d):
    """Glued curated compositions, split and put back together."""
    parts = composition.components(F.col("salt"), X.SPELLING)
    return X.curated(spark, d).select(
        "pos",
        composition.signature(parts).alias("signature"),
        composition.display(parts).alias("display"),
        _joined(composition.keys(parts)).alias("keys"),
    )


@query
def curated_merge(spark, d):
    source = X.curated_source(spark, d)
    base = X.curated(spark, d).join(source.filter("p_size <= 25").select("pos"), "pos", "left_semi")
    merged = curated.merge_brands(base, source.drop("p_size"))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(*curated.category_order(), "brand_price"))
    return merged.select(
        "brand", "category", "brand_price", _joined("aliases", ";").alias("aliases"), rank.alias("category_rank")
    )


@query
def rule_merge(spark, d):
    rules = X.rules(spark, d)
    swapped = rules.withColumns(
        {"salts": F.reverse("salts"), "effect": F.concat(F.lit("again: "), "effect")}
    )
    merged = curated.merge_rules(rules.filter("severity = 'major'"), swapped)
    return merged.select(_joined("salts").alias("salts"), "severity", "effect")


@query
def alias_terms(spark, d):
    return X.curated(spark, d).select("brand", F.explode("aliases").alias("alias"))


# --- layers -------------------------------------------------------------------


@query
def silver_upsert(spark, d):
    """Line items as keyed rows: the older half stored, the newer half merged in twice."""
    rows = X.table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    rest = [c for c in rows.columns if c not in ("l_shipdate", *keys)]
    order = [F.col("l_shipdate").desc(), *[F.col(c).desc() for c in rest]]
    path = f"{session.scratch_root(spark)}/lines"
    cut = F.lit("1999-01-01").cast("timestamp")
    U.upsert(rows.filter(F.col("l_shipdate") < cut), path, keys, order, 8)
    newer = rows.filter(F.col("l_shipdate") >= cut)
    U.upsert(newer, path, keys, order, 8)
    U.upsert(newer, path, keys, order, 8)
    return U.read_table(spark, path).withColumn("l_shipdate", F.date_format("l_shipdate", DAY))


@query
def last_wins(spark, d):
    rows = X.table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return U.last_wins(rows, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()]).select(
        "user_id", "event_type", "event_id"
    )


@query
def layer_roundtrip(spark, d):
    """Captures appended by date and read back by run and by date range."""
    layers = _layers(spark)
    layers.append_bronze(X.captures(spark, d))
    by_run = layers.read_bronze(spark, "run_199703", "1997-03-01", "1997-03-31")
    by_date = layers.read_bronze(spark, first_date="1998-01-01", last_date="1998-06-30")
    return by_run.unionByName(by_date).select(
        "pipeline_run_id", "source_file_hash", F.date_format("ingest_date", DAY).alias("ingest_date")
    )


@query
def replay_lines(spark, d):
    """Silver after a run and a replay of the stored captures."""
    layers = _layers(spark)
    layers.append_bronze(X.captures(spark, d))
    items = X.stored_products(spark, d)
    with session.passing() as keep:
        pipeline.replay(spark, items, layers, scorer="edit", at=X.processed_at(), keep=keep)
    with session.passing() as keep:
        pipeline.replay(spark, items, layers, "1996-01-01", "1997-12-31", "edit", X.processed_at(), keep)
    return layers.read(spark, "silver").select(*LINE_COLUMNS)


@query
def quarantine_view(spark, d):
    rejected = session.settle(_lines(spark, d).filter("rejection_reason IS NOT NULL"), "rejected")
    view = pipeline.quarantine_view(rejected.unionByName(rejected))
    return view.select("pipeline_run_id", "line_id", "rejection_reason")


@query
def gold_upsert(spark, d):
    layers = _layers(spark)
    matched = session.settle(_edit_match(spark, d))
    layers.upsert_gold(matched, stored=True)
    layers.upsert_gold(matched.filter("match_method = 'unmatched'"), stored=True)
    return layers.read(spark, "gold").select(*MATCH_COLUMNS)


@query
def serving_snapshot(spark, d):
    layers = _layers(spark)
    matched = session.settle(_edit_match(spark, d))
    layers.publish(matched, stored=True)
    layers.publish(matched.filter("match_method <> 'unmatched'"), stored=True)
    served = layers.read(spark, "serving")
    return served.groupBy("pipeline_run_id", "match_method").agg(
        F.count(F.lit(1)).alias("lines"), F.countDistinct("line_id").alias("line_ids")
    )


# --- landing ------------------------------------------------------------------


@query
def landing_hash(spark, d):
    rows = landing.lineage(X.landing_bytes(spark, d), "run_1", X.processed_at())
    return rows.select(
        "pipeline_run_id", "source_file_hash", "source_path", "media_type", "size_bytes",
        F.date_format("ingest_date", DAY).alias("ingest_date"),
    )


def _landing_folder(spark, d) -> str:
    """The documents written as files with an image extension, of the size that images have.

    A landing file is read as one value, so no file holds a whole partition.
    """
    folder = f"{session.scratch_root(spark)}/landing"
    rows = X.table(spark, d, "documents").select(F.hex(F.encode("text", "utf-8")).alias("text"))
    rows.write.option("extension", "PNG").option("maxRecordsPerFile", LANDING_RECORDS).csv(folder)
    return folder


def _landed(rows):
    """Bytes taken in; how the documents fall into files is up to Spark."""
    return rows.groupBy("media_type").agg(
        F.sum("size_bytes").alias("bytes"),
        (F.count(F.lit(1)) == F.countDistinct("source_file_hash")).alias("no_repeats"),
    )


@query
def landing_scan(spark, d):
    files = landing.scan(spark, _landing_folder(spark, d))
    return _landed(landing.lineage(files, "run_1", X.processed_at()))


@query
def incremental_landing(spark, d):
    """Files taken in by a stream that is started twice: the second start adds none."""
    folder, root = _landing_folder(spark, d), session.scratch_root(spark)
    for _ in range(2):
        ingest.ingest_new_files(
            spark, folder, f"{root}/ingest", f"{root}/checkpoint", "run_1"
        ).awaitTermination()
    return _landed(spark.read.parquet(f"{root}/ingest"))


@query
def incremental_refine(spark, d):
    """Stored captures refined by a stream that is started twice."""
    layers = _layers(spark)
    layers.append_bronze(X.captures(spark, d))
    items = X.stored_products(spark, d)
    for _ in range(2):
        ingest.refine_new_captures(
            spark, layers, items, f"{layers.root}/checkpoint", "edit", X.processed_at()
        ).awaitTermination()
    return layers.read(spark, "silver").select(*LINE_COLUMNS)


@query
def retried_quarantine(spark, d):
    """Rejections of a micro-batch that fails after its appends and is run again: each once."""
    layers = _layers(spark)
    layers.append_bronze(X.captures(spark, d))
    items = X.stored_products(spark, d)
    lost = []

    def fail_once(number):
        lost.append(number)
        if len(lost) == 1:
            raise RuntimeError("lost on purpose")

    for _ in range(2):
        try:
            ingest.refine_new_captures(
                spark, layers, items, f"{layers.root}/checkpoint", "edit", X.processed_at(), after=fail_once
            ).awaitTermination()
        except StreamingQueryException as error:
            if "lost on purpose" not in str(error):
                raise
    rejected = layers.read(spark, "quarantine")
    return rejected.select("pipeline_run_id", "line_id", "rejection_reason")


@query
def backfill_window(spark, d):
    """Only the captures of one date window are refined."""
    layers = _layers(spark)
    layers.append_bronze(X.captures(spark, d))
    pipeline.replay(
        spark, X.stored_products(spark, d), layers, "1997-01-01", "1997-06-30", "edit", X.processed_at()
    )
    return layers.read(spark, "silver").select(*LINE_COLUMNS)


# --- matching -----------------------------------------------------------------


@query
def term_index(spark, d):
    return X.terms(spark, d)


@query
def search_names(spark, d):
    return matching.search_names(X.curated(spark, d), X.products(spark, d))


@query
def exact_match(spark, d):
    names = _clean(spark, d).select("line_id", F.col("drug_name_normalized").alias("name"))
    found = matching.exact_terms(names, X.stored_terms(spark, d))
    return found.select("line_id", "term", "tier", "pos")


@query
def generic_enrich(spark, d):
    items = X.products(spark, d)
    return matching.with_generic(items, catalogue.signature_groups(items)).select(
        "pos", "name", "generic_name", "generic_price", "product_count", "saving",
        money.percent(F.col("price") - F.col("generic_price"), F.col("price")).alias("saving_pct"),
    )


@query
def curated_signature_link(spark, d):
    items = X.products(spark, d)
    linked = matching.link_curated(
        X.curated(spark, d), catalogue.signature_groups(items), X.SPELLING
    )
    return linked.select("pos", "brand", "signature", "product_count")


@query
def all_entries(spark, d):
    return X.entries(spark, d).withColumn("salt_keys", _joined("salt_keys"))


def _edit_match(spark, d, clean=None):
    items = X.stored_products(spark, d)
    return matching.match_lines(
        _clean_names(spark, d, *MATCH_INPUT) if clean is None else clean,
        items,
        catalogue.signature_groups(items),
        "edit",
        EDIT_THRESHOLD,
        X.processed_at(),
        session.settle,
    )


@query
def fuzzy_match_levenshtein(spark, d):
    return _edit_match(spark, d).select(*MATCH_COLUMNS)


@query
def fuzzy_match_wratio(spark, d):
    items = X.stored_products(spark, d)
    return matching.match_lines(
        _clean_names(spark, d, *MATCH_INPUT),
        items,
        catalogue.signature_groups(items),
        matched_at=X.processed_at(),
        keep=session.settle,
    ).select(*MATCH_COLUMNS)


@query
def unmatched_report(spark, d):
    missed = matching.unmatched(_edit_match(spark, d))
    return missed.groupBy("drug_name_normalized").agg(
        F.count(F.lit(1)).alias("lines"), F.max("match_score").alias("best_score")
    )


@query
def tiered_match(spark, d):
    names = _clean_names(spark, d, F.col("drug_name_normalized").alias("name"))
    return matching.tiered_match(names, X.stored_terms(spark, d), keep=session.settle)


@query
def best_of_two(spark, d):
    lines = _clean_names(spark, d, "drug_name_raw", "drug_name_normalized")
    return matching.best_of_two(
        lines, X.stored_terms(spark, d), "drug_name_raw", "drug_name_normalized", keep=session.settle
    )


@query
def tiered_match_edit(spark, d):
    names = _clean_names(spark, d, F.col("drug_name_normalized").alias("name"))
    return matching.tiered_match(names, X.stored_terms(spark, d), scorer="edit", keep=session.settle)


@query
def best_of_two_edit(spark, d):
    lines = _clean_names(spark, d, "drug_name_raw", "drug_name_normalized")
    return matching.best_of_two(
        lines, X.stored_terms(spark, d), "drug_name_raw", "drug_name_normalized", "edit", session.settle
    )


@query
def noisy_names(spark, d):
    """A sample as long as the catalogue and a half, so that names repeat."""
    items = X.stored_products(spark, d).select("pos", "name")
    return sampling.noisy_sample(items, 3 * items.count() // 2)


@query
def match_quality(spark, d):
    items = X.stored_products(spark, d)
    noisy = session.settle(sampling.noisy_sample(items.select("pos", "name"), items.count()))
    lines = noisy.select(
        "line_id",
        F.lit("benchmark").alias("source_file_hash"),
        F.col("noisy").alias("drug_name_normalized"),
        F.lit("benchmark").alias("pipeline_run_id"),
    )
    batch = matching.match_lines(
        lines, items, catalogue.signature_groups(items), keep=session.settle
    )
    names = noisy.select("line_id", F.col("noisy").alias("name"))
    tiered = matching.tiered_match(names, X.stored_terms(spark, d, items), keep=session.settle)
    return sampling.match_quality(batch, tiered)


# --- alternatives and suggestions ---------------------------------------------


@query
def alternatives_topk(spark, d):
    items = X.products(spark, d)
    own = items.select("pos", F.col("name").alias("brand"), "signature")
    found = alternatives.with_alternatives(own, items, 5)
    return found.select("pos", F.posexplode("alternatives").alias("nth", "a")).select(
        "pos", "nth", "a.brand", "a.price", "a.pack"
    )


@query
def prefix_suggest(spark, d):
    """Every first, third and sixth prefix of the part names as a query text."""
    part = X.table(spark, d, "part").select("p_name", "p_size")
    name = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"))
    asked = part.select(
        F.explode(F.array(*[F.upper(F.substring(name, 1, n)) for n in (1, 3, 6, 40)])).alias("query")
    ).distinct()
    items = X.stored_products(spark, d)
    names = matching.search_names(X.curated(spark, d), items)
    return alternatives.suggest(asked, names, X.terms(spark, d, items), X.entries(spark, d, items), 8)


def _salt_info(spark, d):
    """A note per second word of the part names."""
    return (
        X.table(spark, d, "part")
        .groupBy(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("salt"))
        .agg(F.struct(F.max("p_size").cast("string").alias("uses")).alias("info"))
    )


@query
def medicine_detail(spark, d):
    """Details of every product under its exact name."""
    items = X.stored_products(spark, d)
    detail = alternatives.medicine_detail(
        items.select("name").distinct(),
        X.stored_terms(spark, d, items),
        X.entries(spark, d, items),
        items,
        _salt_info(spark, d),
    )
    return detail.select(
        "name", "brand", "salt", "category", "brand_price", "generic_name", "generic_price",
        "price_asof", "same_salt_brands", "match_score",
        _joined(F.col("alternatives.brand"), ";").alias("alternatives"),
        _joined(F.transform("salt_info", lambda s: F.concat(s["salt"], F.lit("="), s["info"]["uses"])), ";").alias("salt_info"),
    )


# --- safety -------------------------------------------------------------------


@query
def interaction_pairs(spark, d):
    found = safety.interactions(
        X.baskets(spark, d), X.rules(spark, d), ignored=X.IGNORED, keep=session.settle
    )
    order = safety.display_order(F.col("effect"), F.col("brand_a"), F.col("brand_b"))
    rank = F.row_number().over(Window.partitionBy("rx_id").orderBy(*order))
    return found.select(
        "rx_id", "brand_a", "brand_b", "rule_pos", "severity", "effect", "pos_a", "pos_b", rank.alias("warning_rank")
    )


@query
def cross_interactions(spark, d):
    orders = X.table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("rx_id"), F.col("o_custkey").alias("user_id")
    )
    scanned = X.baskets(spark, d).join(orders, "rx_id").withColumnRenamed("rx_id", "scan_id")
    saved = reports.saved_medicines(X.user_meds(spark, d))
    found = safety.cross_interactions(
        scanned, saved, X.rules(spark, d), ignored=X.IGNORED, keep=session.settle
    )
    order = [F.col("severity") != "major", "pos_a", "rule_pos", "effect", "brand_a", "saved_med"]
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy(*order))
    return found.select(
        "scan_id", "user_id", "brand_a", "saved_med", "rule_pos", "severity", "effect", "pos_a",
        rank.alias("warning_rank"),
    )


# --- look-ups -----------------------------------------------------------------


@query
def basket_totals(spark, d):
    items = X.products(spark, d)
    priced = X.baskets(spark, d).join(catalogue.signature_groups(items), "signature")
    return reports.basket_totals(priced)


@query
def lookup_report(spark, d):
    return lookup.lookup(X.requests(spark, d), X.reference(spark, d)).sections()


@query
def name_lookup(spark, d):
    """Typed names: every part name of an order as one request."""
    lines = X.rx_lines(spark, d).select("rx_id", "position", F.col("name"))
    report = lookup.lookup(lookup.names_as_requests(lines), X.reference(spark, d))
    return report.totals


# --- stores -------------------------------------------------------------------


def _stores(spark, d):
    return stores.locate(
        stores.explode_store_json(X.store_documents(spark, d)),
        stores.pincode_centroids(X.offices(spark, d)),
    )


@query
def pincode_centroid(spark, d):
    return stores.pincode_centroids(X.offices(spark, d))


@query
def store_build(spark, d):
    return _stores(spark, d)


@query
def store_build_report(spark, d):
    return stores.build_report(
        stores.explode_store_json(X.store_documents(spark, d)),
        stores.pincode_centroids(X.offices(spark, d)),
    )


@query
def pincode_resolve(spark, d):
    asked = X.table(spark, d, "customer").select(
        F.col("c_custkey").alias("probe"),
        F.concat(F.lit(" "), F.lpad((F.col("c_custkey") % 80).cast("string"), 6, "0"), F.lit(" ")).alias("pincode"),
    )
    return nearest.resolve_pincodes(asked, nearest.store_centroids(_stores(spark, d)))


@query
def nearest_stores(spark, d):
    found = nearest.nearest_stores(X.probes(spark, d), _stores(spark, d), 5, "Generic Store")
    return found.select("probe", "rank", "code", "distance_km", "maps_url")


@query
def store_distance(spark, d):
    """Distance of every customer to the centroid of its own pincode."""
    own = X.probes(spark, d).withColumn(
        "pincode", F.lpad((F.col("probe") % 60).cast("string"), 6, "0")
    )
    centre = stores.pincode_centroids(X.offices(spark, d)).withColumnsRenamed(
        {"lat": "c_lat", "lng": "c_lng"}
    )
    km = geo.haversine_km(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng"))
    return own.join(centre, "pincode").select("probe", F.round(km, 3).alias("km"))


# --- dosing -------------------------------------------------------------------


@query
def dose_rules(spark, d):
    return dosing.supported(X.dose_rules(spark, d))


@query
def dose_rule_match(spark, d):
    matched = dosing.match_rules(X.patients(spark, d), X.dose_rules(spark, d))
    return matched.select("patient", "rule_id")


@query
def dose_table(spark, d):
    rules = X.dose_rules(spark, d)
    doses = dosing.dose_table(dosing.match_rules(X.patients(spark, d), rules), rules)
    syrup = F.transform(
        "syrups",
        lambda s: F.concat_ws(
            ":", s["label"], (s["ml_low"] * 100).cast("int").cast("string"),
            (s["ml_high"] * 100).cast("int").cast("string"),
        ),
    )
    return doses.select(
        "patient", "weight_kg", "rule_id", "label", "dose_mg_low", "dose_mg_high", "capped",
        _joined("cautions", "|").alias("cautions"), _joined(syrup, "|").alias("syrups"),
        F.size("fixed_doses").alias("fixed_doses"), "error",
    )


# --- reports ------------------------------------------------------------------


@query
def match_stats(spark, d):
    return reports.match_stats(_edit_match(spark, d))


def _metrics(spark, d):
    captured = X.captures(spark, d)
    checked = session.settle(_lines(spark, d), "checked")
    items = X.stored_products(spark, d)
    clean = checked.filter("rejection_reason IS NULL")
    matched = matching.match_lines(
        clean,
        items,
        catalogue.signature_groups(items),
        "edit",
        EDIT_THRESHOLD,
        X.processed_at(),
        session.settle,
    )
    return (
        reports.run_metrics(
            X.runs(captured), captured, clean,
            quality.failure_counts(checked, "pipeline_run_id"), matched,
        ),
        matched,
    )


def _metrics_text(rows):
    return rows.withColumns(
        {
            "run_started_at": F.date_format("run_started_at", DAY),
            "run_finished_at": F.date_format("run_finished_at", DAY),
            "validation_failures": _map_text("validation_failures"),
            "stage_durations_sec": _map_text("stage_durations_sec"),
        }
    )


@query
def run_metrics(spark, d):
    return _metrics_text(_metrics(spark, d)[0])


@query
def metrics_mirror(spark, d):
    """Metrics appended as history and mirrored, one row per run, maps as JSON text."""
    layers = _layers(spark)
    metrics = session.settle(_metrics(spark, d)[0])
    for _ in range(2):
        layers.append_metrics(metrics)
        layers.mirror_metrics(metrics)
    mirrored = layers.read(spark, "serving_metrics")
    history = spark.read.parquet(layers.metrics).groupBy("pipeline_run_id").agg(
        F.count(F.lit(1)).alias("history_rows")
    )
    return mirrored.join(history, "pipeline_run_id").select(
        "pipeline_run_id", "silver_rows", "stage_durations_sec", "history_rows"
    )


@query
def run_health(spark, d):
    metrics, matched = _metrics(spark, d)
    health = reports.pipeline_health(metrics, matched)
    return health.withColumns(
        {
            "last_run_at": F.date_format("last_run_at", DAY),
            "validation_failures": _map_text("validation_failures"),
            "stage_durations_sec": _map_text("stage_durations_sec"),
        }
    )


@query
def layer_reconcile(spark, d):
    checked = session.settle(_lines(spark, d).select("line_id", *MATCH_INPUT, "rejection_reason"), "checked")
    clean = checked.filter("rejection_reason IS NULL")
    return reports.reconcile(
        bronze=X.captures(spark, d),
        silver=clean,
        quarantine=checked.filter("rejection_reason IS NOT NULL"),
        gold=_edit_match(spark, d, clean),
    )


@query
def row_count_trend(spark, d):
    captured = X.captures(spark, d)
    per_run = X.runs(captured).join(
        _clean(spark, d).groupBy("pipeline_run_id").agg(F.count(F.lit(1)).alias("silver_rows")),
        "pipeline_run_id",
    )
    return quality.row_count_trend(per_run, 3)


@query
def feedback_stats(spark, d):
    return reports.feedback_stats(X.feedback(spark, d))


@query
def most_corrected(spark, d):
    return reports.most_corrected(X.feedback(spark, d))


@query
def lifetime_saving(spark, d):
    return reports.lifetime_saving(X.scans(spark, d))


@query
def scan_history(spark, d):
    history = reports.scan_history(X.scans(spark, d), 5)
    return history.withColumn("medicines", _joined("medicines", "|"))


@query
def saved_medicines(spark, d):
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("brand"))
    found = reports.saved_medicines(X.user_meds(spark, d))
    return found.select("user_id", "brand", "id", "salt", rank.alias("brand_rank"))


@query
def save_requests(spark, d):
    """Names to save, resolved to entries; brands before "m" are there already."""
    asked = X.saved_requests(spark, d)
    ref = X.reference(spark, d)
    existing = reports.saved_medicines(X.user_meds(spark, d)).filter("brand < 'm'")
    return lookup.resolve_saved(asked, existing, ref).select("user_id", "brand", "id")


@query
def quota_admission(spark, d):
    """Two hits per client and day."""
    return quota.admissions(X.access_log(spark, d), 2, 86_400).select(
        "event_id", "client", "admitted"
    )


@query
def quota_stream(spark, d):
    """The same on a stream that gets the log in four parts, one after another in time."""
    root = session.scratch_root(spark)
    log = session.settle(X.access_log(spark, d).withColumn("ts", F.col("ts").cast("timestamp")))
    first, last = log.select(F.min("ts"), F.max("ts")).first()
    if first is None:
        return quota.admissions(log, 2, 86_400).select("event_id", "client", "admitted")
    part = F.least(F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) * 4 / (F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)) + 1)), F.lit(3))
    for number in range(4):
        log.filter(part == number).write.mode("append").parquet(f"{root}/log")
        arriving = spark.readStream.schema(log.schema).parquet(f"{root}/log")
        writer = quota_stream_form.admissions(arriving, 2, 86_400).writeStream.format("parquet").option("path", f"{root}/out")
        writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "client", "admitted")
