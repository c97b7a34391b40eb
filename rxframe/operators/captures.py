"""Raw captures (nested JSON) to typed prescription lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxframe import schemas
from rxframe.functions import text

UNPARSEABLE = "unparseable_bronze_json"
MALFORMED = "malformed_payload"


def _first_given(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def document(raw: Column) -> Column:
    """The JSON text as the only element of an array, so that text after the value is an error."""
    return F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))


def parse_captures(bronze: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """One row per medicine of every capture.

    The document is parsed once, as a variant. Text that is no JSON, or JSON of another shape,
    becomes a single flagged line; a document without ``medicines`` gives no lines.
    """
    captures = bronze.select(
        "source_file_hash", "pipeline_run_id", document(F.col("raw_response")).alias("doc")
    ).withColumn("medicines", F.try_variant_get("doc", "$[0].medicines", schemas.MEDICINES))
    fits = F.col("medicines").isNotNull() & ~F.exists("medicines", lambda m: m.isNull())
    # A document whose medicines fit is there; only for the others its copy is made to see that.
    broken = F.try_variant_get("doc", "$[1]", "variant").isNotNull() | (
        ~fits & F.try_variant_get("doc", "$[0]", "variant").isNull()
    )
    absent = F.schema_of_variant(F.try_variant_get("doc", "$[0]", "variant")).startswith(
        "OBJECT"
    ) & F.try_variant_get("doc", "$[0].medicines", "variant").isNull()
    reason = (
        F.when(broken, F.lit(UNPARSEABLE))
        .when(fits | absent, F.lit(None).cast("string"))
        .otherwise(F.lit(MALFORMED))
    )
    blank_line = F.array(F.lit(None).cast(schemas.MEDICINES[6:-1]))
    flagged = captures.select(
        "source_file_hash",
        "pipeline_run_id",
        reason.alias("rejection_reason"),
        "medicines",
    )
    lines = flagged.select(
        "source_file_hash",
        "pipeline_run_id",
        "rejection_reason",
        F.posexplode(
            F.when(F.col("rejection_reason").isNotNull(), blank_line).otherwise(F.col("medicines"))
        ).alias("position", "medicine"),
    )
    med = F.col("medicine")
    raw = _first_given(med["raw_text"], med["normalized_name"])
    given = lines.withColumns(
        {
            "name": text.clean_name(_first_given(med["normalized_name"], raw)),
            "number": text.dose_number(med["dosage"]),
            "unit": text.unit_text(med["dosage"]),
        }
    )
    # As the element of an array the patterns' results are computed once: a filter on what is derived from them
    # (the failed expectation) would otherwise be moved below this step together with a copy of every pattern.
    once = F.struct("name", text.number_value(F.col("number")).alias("value"), "unit")
    lines = given.withColumn("once", once).withColumn("o", F.explode(F.array("once")))
    return lines.select(
        F.concat(F.substring("source_file_hash", 1, 12), F.lit("-"), F.col("position")).alias(
            "line_id"
        ),
        "source_file_hash",
        raw.alias("drug_name_raw"),
        F.col("o.name").alias("drug_name_normalized"),
        F.col("o.value").alias("dosage_value"),
        F.nullif("o.unit", F.lit("")).alias("dosage_unit"),
        med["frequency"].alias("frequency"),
        text.quantity(med["frequency"]).alias("quantity"),
        F.when(F.col("rejection_reason").isNotNull(), F.lit(0.0))
        .otherwise(text.confidence(med["confidence"]))
        .alias("extraction_confidence"),
        "pipeline_run_id",
        (F.current_timestamp() if processed_at is None else processed_at)
        .cast("timestamp")
        .alias("processed_at"),
        "rejection_reason",
    )
