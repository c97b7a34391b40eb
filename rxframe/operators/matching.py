"""Product matching: search terms, exact, batch fuzzy, tiered and best-of-two."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxframe import constants as K
from rxframe.functions import composition, money, text
from rxframe.operators import scoring
from rxframe.session import lazy

CURATED, BULK = 0, 1


# --- the searchable entries ---------------------------------------------------


def link_curated(curated: DataFrame, groups: DataFrame, spelling=K.SPELLING) -> DataFrame:
    """Curated rows with the composition group of the catalogue they belong to, if any."""
    sig = composition.signature(composition.components(F.col("salt"), spelling))
    known = groups.select("signature", "product_count")
    return (
        curated.withColumn("own_signature", sig)
        .join(known.withColumnRenamed("signature", "own_signature"), "own_signature", "left")
        .withColumn(
            "signature", F.when(F.col("product_count").isNotNull(), F.col("own_signature"))
        )
        .drop("own_signature")
    )


def with_generic(products: DataFrame, groups: DataFrame) -> DataFrame:
    """Products with the cheapest product of the same composition and the saving."""
    return products.join(groups, "signature").withColumn(
        "saving", money.saving(F.col("price"), F.col("generic_price"))
    )


def entries(
    curated: DataFrame, products: DataFrame, groups: DataFrame, spelling=K.SPELLING
) -> DataFrame:
    """Curated and catalogue rows in one layout, keyed by (tier, pos)."""
    linked = link_curated(curated, groups, spelling)
    stated = F.col("price_asof") if "price_asof" in curated.columns else F.lit(None).cast("string")
    own_asof = F.coalesce(F.nullif(stated, F.lit("")), F.lit(K.CURATED_PRICE_ASOF))
    return linked.select(
        F.lit(CURATED).alias("tier"),
        "pos",
        "brand",
        "salt",
        "salt_keys",
        "category",
        "pack",
        "brand_price",
        F.col("generic.name").alias("generic_name"),
        F.col("generic.price").alias("generic_price"),
        own_asof.alias("price_asof"),
        "signature",
        F.coalesce("product_count", F.lit(0)).alias("same_salt_brands"),
    ).unionByName(
        products.join(groups, "signature").select(
            F.lit(BULK).alias("tier"),
            "pos",
            F.col("name").alias("brand"),
            "salt",
            "salt_keys",
            F.lit(K.BULK_CATEGORY).alias("category"),
            "pack",
            F.col("price").alias("brand_price"),
            "generic_name",
            "generic_price",
            F.lit(K.BULK_PRICE_ASOF).alias("price_asof"),
            "signature",
            F.col("product_count").alias("same_salt_brands"),
        )
    )


def term_index(curated: DataFrame, products: DataFrame) -> DataFrame:
    """Every search term with the entry that registered it first: (term, tier, pos, variant)."""
    from_curated = curated.select(
        F.lit(CURATED).alias("tier"),
        "pos",
        F.posexplode(
            F.concat(
                F.array("brand"),
                F.coalesce("aliases", F.array().cast("array<string>")),
                F.array("salt"),
            )
        ).alias("variant", "term"),
    ).withColumn("term", text.norm(F.col("term")))
    # Only the first product of a name can be the first of a term, so names are stripped once, however many products share one.
    # A product without a position comes first.
    own = F.when(F.count("pos") == F.count(F.lit(1)), F.min("pos")).alias("pos")
    from_bulk = products.groupBy("name_norm").agg(own).select(
        F.lit(BULK).alias("tier"),
        "pos",
        F.posexplode(
            F.array("name_norm", text.strip_form_suffix(F.col("name_norm")))
        ).alias("variant", "term"),
    )
    first = F.min(F.struct("tier", "pos", "variant")).alias("first")
    return (
        from_curated.unionByName(from_bulk)
        .filter(F.col("term") != "")
        .groupBy("term")
        .agg(first)
        .select("term", "first.*")
    )


def search_names(curated: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct (normalised, display) names for suggestions."""
    return (
        curated.select(text.norm(F.col("brand")).alias("name_norm"), F.col("brand").alias("display"))
        .union(products.select("name_norm", F.col("name").alias("display")))
        .distinct()
    )


# --- batch match against the catalogue ----------------------------------------


def representatives(products: DataFrame) -> DataFrame:
    """One product per normalised name: smallest (name, price, position)."""
    first = F.min(F.struct("name", "price", "pos", "salt", "signature", "block_key"))
    return products.groupBy("name_norm").agg(first.alias("p")).select("name_norm", "p.*")


def exact_names(names: DataFrame, products: DataFrame) -> DataFrame:
    """Names equal to a product name after normalising."""
    return names.join(representatives(products), names["q_norm"] == F.col("name_norm"))


def match_names(
    names: DataFrame,
    products: DataFrame,
    scorer: str = "weighted",
    form_prefixes: list[str] = K.FORM_PREFIXES_SHORT,
    keep: Callable = lazy,
) -> DataFrame:
    """Best product per distinct normalised name: (q_norm, score, name, salt, price, signature).

    ``keep`` may store intermediate tables that are read several times (``session.settle``).
    """
    reps = keep(representatives(products), "representatives")
    columns = ["q_norm", "score", "name", "salt", "price", "signature"]
    queries = keep(
        names.select("q_norm")
        .filter("q_norm <> ''")
        .distinct()
        .join(reps, F.col("q_norm") == F.col("name_norm"), "left")
        .withColumn("block", text.block_key(F.col("q_norm"), form_prefixes)),
        "names",
    )
    same = queries.filter("name_norm IS NOT NULL").withColumn("score", F.lit(100))
    rest = queries.filter("name_norm IS NULL")
    best = scoring.best_per_query(
        rest.select("block", F.col("q_norm").alias("text")),
        reps.select(
            F.col("block_key").alias("block"),
            F.col("name_norm").alias("text"),
            F.col("name").alias("ord"),
        ),
        scorer=scorer,
    )
    # Product columns are joined to the winners, so they never travel with the candidate chunks.
    near = best.join(reps, F.col("candidate") == F.col("name_norm")).select(
        F.col("text").alias("q_norm"),
        F.col("score").cast("int").alias("score"),
        "name",
        "salt",
        "price",
        "signature",
    )
    return same.select(columns).unionByName(near.select(columns))


def match_lines(
    lines: DataFrame,
    products: DataFrame,
    groups: DataFrame,
    scorer: str = "weighted",
    threshold: int = K.BATCH_THRESHOLD,
    matched_at: Column | None = None,
    keep: Callable = lazy,
) -> DataFrame:
    """Silver lines to matched lines; every line stays, unmatched ones keep their best score."""
    named = lines.withColumn("q_norm", text.norm(F.col("drug_name_normalized")))
    best = match_names(named, products, scorer, keep=keep)
    hit = F.col("score") >= threshold
    enriched = best.join(groups, "signature", "left").select(
        "q_norm",
        "score",
        *[
            F.when(hit, F.col(source)).alias(name)
            for source, name in (
                ("name", "matched_product"),
                ("salt", "matched_salt"),
                ("price", "brand_price"),
                ("generic_name", "generic_name"),
                ("generic_price", "generic_price"),
            )
        ],
    )
    # Stored, the matches of the distinct names have a known size: if they are few, the lines stay where they are.
    return named.join(keep(enriched, "matches"), "q_norm", "left").select(
        "line_id",
        "source_file_hash",
        "drug_name_normalized",
        "matched_product",
        "matched_salt",
        F.coalesce("score", F.lit(0)).alias("match_score"),
        F.when(F.col("matched_product").isNull(), "unmatched")
        .when(F.col("score") >= 100, "exact")
        .otherwise("blocked_fuzzy")
        .alias("match_method"),
        "brand_price",
        "generic_name",
        "generic_price",
        money.saving(F.col("brand_price"), F.col("generic_price")).alias("saving"),
        "pipeline_run_id",
        (F.current_timestamp() if matched_at is None else matched_at)
        .cast("timestamp")
        .alias("matched_at"),
    )


# --- tiered match against curated and catalogue terms ---------------------------


def exact_terms(names: DataFrame, terms: DataFrame, column: str = "name") -> DataFrame:
    """Names whose look-up text is a registered term."""
    return names.withColumn("term", text.query_term(F.col(column))).join(terms, "term")


def match_terms(
    queries: DataFrame, terms: DataFrame, scorer: str = "weighted", keep: Callable = lazy
) -> DataFrame:
    """Distinct look-up texts (``term``) to (term, tier, pos, match_score); misses have score 0.

    Exact term, else the best curated term from 72 (final from 95), else the best term with the
    same first three letters from 85, which wins ties against the curated one.
    """
    order = F.struct("tier", "pos", "variant").alias("ord")
    asked = keep(
        queries.select("term").filter("term <> ''").distinct().join(terms, "term", "left"), "terms"
    )
    exact = asked.filter("pos IS NOT NULL").select(
        "term", "tier", "pos", F.lit(100).alias("match_score")
    )
    rest = asked.filter("pos IS NULL").select("term")

    one_block = F.lit("").alias("block")
    text_col = F.col("term").alias("text")
    curated = keep(
        scoring.best_per_query(
            rest.select(one_block, text_col),
            terms.filter(F.col("tier") == CURATED).select(one_block, text_col, order),
            scorer,
            whole=False,
            cutoff=K.CURATED_THRESHOLD,
        ).select("text", F.col("ord").alias("c_ord"), F.floor("score").cast("int").alias("c_score")),
        "curated",
    )
    open_ = rest.join(
        curated.filter(F.col("c_score") >= K.CURATED_STOP).select(F.col("text").alias("term")),
        "term",
        "left_anti",
    ).filter(F.length("term") >= K.BLOCK_LENGTH)
    prefix = F.substring("term", 1, K.BLOCK_LENGTH).alias("block")
    bulk = scoring.best_per_query(
        open_.select(prefix, text_col),
        terms.select(prefix, text_col, order),
        scorer,
        whole=False,
        cutoff=K.BULK_THRESHOLD,
    ).select("text", F.col("ord").alias("b_ord"), F.floor("score").cast("int").alias("b_score"))
    by_text = F.col("term") == F.col("text")
    judged = (
        rest.join(curated, by_text, "left").drop("text").join(bulk, by_text, "left").drop("text")
    )
    winner = F.when(
        F.col("b_score") >= F.coalesce("c_score", F.lit(0)),
        F.struct(F.col("b_ord").alias("ord"), F.col("b_score").alias("s")),
    ).otherwise(F.struct(F.col("c_ord").alias("ord"), F.col("c_score").alias("s")))
    near = judged.withColumn("w", winner).select(
        "term",
        F.col("w.ord.tier").alias("tier"),
        F.col("w.ord.pos").alias("pos"),
        F.coalesce("w.s", F.lit(0)).alias("match_score"),
    )
    return exact.unionByName(near)


def tiered_match(
    names: DataFrame,
    terms: DataFrame,
    column: str = "name",
    scorer: str = "weighted",
    keep: Callable = lazy,
) -> DataFrame:
    """Every row with (tier, pos, match_score) of its best entry; nulls and 0 when there is none."""
    asked = names.withColumn("term", text.query_term(F.col(column)))
    found = keep(match_terms(asked, terms, scorer, keep), "found")
    return (
        asked.join(found, "term", "left")
        .withColumn("match_score", F.coalesce("match_score", F.lit(0)))
        .drop("term")
    )


def best_of_two(
    lines: DataFrame,
    terms: DataFrame,
    raw: str,
    interpreted: str,
    scorer: str = "weighted",
    keep: Callable = lazy,
) -> DataFrame:
    """Match the literal text and its interpretation, keep the better; the interpretation on ties."""
    asked = lines.withColumns(
        {"term_i": text.query_term(F.col(interpreted)), "term_r": text.query_term(F.col(raw))}
    )
    both = asked.select(
        F.explode(F.array_distinct(F.array("term_i", "term_r"))).alias("term")
    ).distinct()
    found = keep(match_terms(both, terms, scorer, keep), "found")

    def side(suffix: str) -> DataFrame:
        hit = F.struct("tier", "pos", "match_score").alias(f"hit_{suffix}")
        return found.filter("pos IS NOT NULL").select(F.col("term").alias(f"term_{suffix}"), hit)

    joined = asked.join(side("i"), "term_i", "left").join(side("r"), "term_r", "left")
    pick = F.when(
        F.col("hit_r.match_score") > F.coalesce("hit_i.match_score", F.lit(0)), F.col("hit_r")
    ).otherwise(F.col("hit_i"))
    return (
        joined.withColumn("hit", pick)
        .withColumns(
            {
                "tier": F.col("hit.tier"),
                "pos": F.col("hit.pos"),
                "match_score": F.coalesce("hit.match_score", F.lit(0)),
            }
        )
        .drop("term_i", "term_r", "hit_i", "hit_r", "hit")
    )


def with_entry(matched: DataFrame, all_entries: DataFrame) -> DataFrame:
    """Attach the matched entry; unmatched rows keep nulls."""
    return matched.join(all_entries, ["tier", "pos"], "left")


def unmatched(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("match_method") == "unmatched")
