"""Weight-based dose tables from a rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxframe import constants as K


def supported(rules: DataFrame) -> DataFrame:
    return rules.select("id", "label")


def match_rules(medicines: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule_id``: the rule with most ingredients, all held by the medicine.

    The earlier rule (smaller ``rule_pos``) wins ties. Each distinct ingredient list is looked up
    once.
    """
    lists = medicines.select("salt_keys").distinct()
    held = lists.select(
        "salt_keys", F.explode(F.array_distinct(F.transform("salt_keys", F.lower))).alias("salt")
    )
    needed = rules.select(
        "id",
        "rule_pos",
        F.size(F.array_distinct("salts")).alias("need"),
        F.explode(F.array_distinct("salts")).alias("salt"),
    )
    best = (
        held.join(needed, "salt")
        .groupBy("salt_keys", "id", "rule_pos", "need")
        .agg(F.count(F.lit(1)).alias("have"))
        .filter("have = need")
        .groupBy("salt_keys")
        .agg(F.max(F.struct("need", (-F.col("rule_pos")).alias("early"), "id")).alias("best"))
        .select("salt_keys", F.col("best.id").alias("rule_id"))
    )
    return medicines.join(best, "salt_keys", "left")


def round_ml(ml: Column) -> Column:
    """Nearest syringe mark: quarter millilitres below 5 ml, else halves; half to even."""
    step = F.when(ml < K.ML_STEP_LIMIT, K.ML_STEP_SMALL).otherwise(K.ML_STEP_LARGE)
    return F.round(F.rint(ml / step) * step, 2)


def _number(c: Column) -> Column:
    """Number text without a trailing '.0'."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def dose_table(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Doses for requests of (rule_id, weight_kg and any other columns).

    Problems are reported in ``error``, never raised.
    """
    own = requests.columns
    rule = rules.withColumnRenamed("id", "rule_id").withColumn("known", F.lit(True))
    w = F.col("weight_kg")
    joined = requests.join(rule, "rule_id", "left")
    heavy = F.col("type") == "per_kg"
    cap = F.nullif(F.col("max_single_mg"), F.lit(0.0))
    low, high = F.col("mg_per_kg_low") * w, F.col("mg_per_kg_high") * w
    no_rule_before, no_rule_after = K.RULE_ERROR.split("{name}")
    error = F.when(
        F.col("known").isNull(),
        F.concat(F.lit(no_rule_before), F.coalesce("rule_id", F.lit("")), F.lit(no_rule_after)),
    ).when(
        ~F.coalesce(w.between(K.MIN_WEIGHT_KG, K.MAX_WEIGHT_KG), F.lit(False)),
        F.lit(K.WEIGHT_ERROR),
    )
    months = F.nullif(F.col("min_age_months"), F.lit(0))
    age = F.when(months >= 12, F.concat((months / 12).cast("int"), F.lit(" year(s)"))).otherwise(
        F.concat(months, F.lit(" month(s)"))
    )
    age_before, age_after = K.AGE_CAUTION.split("{age}")
    cap_before, cap_after = K.CAP_CAUTION.split("{cap}")
    judged = joined.select(
        *own,
        "label",
        "type",
        "frequency",
        "max_doses_per_day",
        F.coalesce("notes", F.lit("")).alias("notes"),
        "syrups",
        "fixed_doses",
        error.alias("error"),
        F.when(heavy, F.when(low > cap, cap).otherwise(low)).alias("low"),
        F.when(heavy, F.when(high > cap, cap).otherwise(high)).alias("high"),
        F.coalesce(heavy & (high > cap), F.lit(False)).alias("capped"),
        F.concat(F.lit(age_before), age, F.lit(age_after)).alias("age_caution"),
        F.concat(F.lit(cap_before), _number(cap), F.lit(cap_after)).alias("cap_caution"),
    )
    fine = F.col("error").isNull()
    syrups = F.transform(
        "syrups",
        lambda s: F.struct(
            s["label"].alias("label"),
            round_ml(F.col("low") / s["mg_per_ml"]).alias("ml_low"),
            round_ml(F.col("high") / s["mg_per_ml"]).alias("ml_high"),
        ),
    )
    cautions = F.filter(
        F.array("age_caution", F.when(F.col("capped"), F.col("cap_caution"))),
        lambda c: c.isNotNull(),
    )
    per_kg = fine & (F.col("type") == "per_kg")
    return judged.select(
        *own,
        F.when(fine, F.col("label")).alias("label"),
        F.when(fine, F.col("frequency")).alias("frequency"),
        F.when(fine, F.col("max_doses_per_day")).alias("max_doses_per_day"),
        F.when(fine, F.col("notes")).alias("notes"),
        F.when(per_kg, F.round("low", 1)).alias("dose_mg_low"),
        F.when(per_kg, F.round("high", 1)).alias("dose_mg_high"),
        (fine & F.col("capped")).alias("capped"),
        F.when(fine, cautions).alias("cautions"),
        F.when(per_kg, syrups).alias("syrups"),
        F.when(fine & (F.col("type") == "fixed"), F.col("fixed_doses")).alias("fixed_doses"),
        "error",
    )
