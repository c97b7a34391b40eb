"""Composition parsing: ingredient keys, strengths, signatures and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rxframe import constants as K
from rxframe.functions import text


def _respell(key: Column, spelling: dict[str, str]) -> Column:
    if not spelling:
        return key
    table = F.create_map(*[F.lit(x) for pair in spelling.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def components_of(texts: Column, spelling: dict[str, str] = K.SPELLING) -> Column:
    """Ingredient texts -> array of struct(key, strength), empty texts left out.

    Reads "Name (500mg)", "Name 650mg" and "Name 75mg (remark)". Each step binds its results to the
    array element, so no pattern runs twice on the same text.
    """
    bodies = F.filter(
        F.transform(
            texts, lambda t: text.strip(F.trim(text.strip(t), F.lit(",")))
        ),
        lambda b: b != "",
    )
    split_off = F.transform(
        bodies,
        lambda b: F.struct(
            b.alias("body"),
            b.rlike(K.PAREN_STRENGTH_PATTERN).alias("has_bracket"),
            F.regexp_extract(b, K.PAREN_STRENGTH_PATTERN, 1).alias("before"),
            F.regexp_extract(b, K.PAREN_STRENGTH_PATTERN, 2).alias("bracket"),
        ),
    )
    judged = F.transform(
        split_off,
        lambda p: F.struct(
            (p["has_bracket"] & p["bracket"].rlike(r"\d")).alias("in_bracket"),
            p["before"].alias("before"),
            p["bracket"].alias("bracket"),
            F.when(p["has_bracket"], text.strip(p["before"])).otherwise(p["body"]).alias("plain"),
        ),
    )
    glued = F.transform(
        judged,
        lambda p: F.when(
            p["in_bracket"],
            F.struct(p["before"].alias("name"), p["bracket"].alias("strength")),
        ).otherwise(
            F.struct(
                F.regexp_extract(p["plain"], K.GLUED_STRENGTH_PATTERN, 1).alias("name"),
                F.regexp_extract(p["plain"], K.GLUED_STRENGTH_PATTERN, 2).alias("strength"),
            )
        ),
    )
    # A text without a strength is the name itself.
    named = F.zip_with(
        judged,
        glued,
        lambda p, g: F.struct(
            F.lower(
                F.trim(
                    F.regexp_replace(
                        F.when(g["strength"] == "", p["plain"]).otherwise(g["name"]),
                        f"{text.BLANK}+",
                        " ",
                    )
                )
            ).alias("key"),
            F.lower(F.regexp_replace(g["strength"], f"{text.BLANK}+", "")).alias("strength"),
        ),
    )
    return F.transform(
        named,
        lambda n: F.struct(
            _respell(n["key"], spelling).alias("key"), n["strength"].alias("strength")
        ),
    )


def components(c: Column, spelling: dict[str, str] = K.SPELLING) -> Column:
    """A whole composition text, split on '+'."""
    return components_of(F.split(F.coalesce(c, F.lit("")), r"\+"), spelling)


def signature(parts: Column) -> Column:
    """Same ingredients at the same strengths give the same text."""
    return F.array_join(
        F.transform(F.array_sort(parts), lambda p: F.concat(p["key"], F.lit("@"), p["strength"])),
        "|",
    )


def display(parts: Column) -> Column:
    def one(p: Column) -> Column:
        name = text.title(p["key"])
        return F.when(
            p["strength"] != "", F.concat(name, F.lit(" ("), p["strength"], F.lit(")"))
        ).otherwise(name)

    return F.array_join(F.transform(parts, one), " + ")


def keys(parts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: p["key"])))
