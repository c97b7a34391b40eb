"""Known answers of the scalar expressions."""

import pytest
from pyspark.sql import functions as F

from rxframe.functions import composition, geo, money, text


def ask(spark, expression, values, type_="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


CASES = [
    (text.norm, {"Montek-LC": "montek lc", "  A  B\t": "a b", None: ""}),
    (
        text.strip_form_prefix,
        {"Tab. Dolo": "Dolo", "tablet  X": "X", "Tab.B": "Tab.B", "INJ Y": "Y", "drop Z": "Z", "T. Pan": "Pan"},
    ),
    (
        text.strip_form_suffix,
        {
            "ascoril ls dry syrup": "ascoril ls",
            "calpol 650 tablet": "calpol 650",
            "x eye ear drops": "x",
            "tablet": "tablet",
            "a tablets b": "a tablets b",
        },
    ),
    (text.clean_name, {"  Cap.  RED   ROD ": "RED ROD", None: "", "  ": ""}),
    (
        text.dose_value,
        {"650mg": 650.0, "1.2.3 ml": None, "1. g": 1.0, "one tab": None, None: None, ". mg": None, "5 MCG": 5.0},
    ),
    (text.dose_unit, {"650mg": "mg", "1.2.3 ml": "ml", "23 mcg daily": "mcg", "x": None, None: None, "2 IU": "iu"}),
    (text.quantity, {"BD x 5 days": 5, "OD × 3": 3, "max 4": 4, "HS": None, None: None, "X7 tabs": 7}),
    (text.confidence, {"High": 0.95, "medium": 0.7, "LOW": 0.4, "unsure": 0.5, None: 0.5}),
    (text.block_key, {"Tab Dolo 650": "dol", "Cream X": "cre", "pa": "pa", "": ""}),
    (text.title, {"b-complex": "B-Complex", "vitamin d3": "Vitamin D3", "iron": "Iron"}),
    (text.query_term, {"Syp. Ascoril-LS": "ascoril ls", "  ": ""}),
]


@pytest.mark.parametrize("fn,answers", CASES, ids=[c[0].__name__ for c in CASES])
def test_text(spark, fn, answers):
    assert ask(spark, fn, list(answers)) == list(answers.values())


def test_aliases(spark):
    rows = spark.createDataFrame(
        [("Dolo 650", ["DOLO", "Para"]), ("Pan-40", None), ("Crocin", [])],
        "brand string, extra array<string>",
    )
    got = [r[0] for r in rows.select(text.aliases(F.col("brand"), F.col("extra"))).collect()]
    assert got == [["dolo", "para"], ["pan"], []]


def test_components(spark):
    answers = {
        "Amoxycillin  (500mg)": [("amoxicillin", "500mg")],
        "Paracetamol 650mg": [("paracetamol", "650mg")],
        "Aspirin 75mg (low dose)": [("aspirin", "75mg")],
        "Ibuprofen 400 mg + Paracetamol 325mg": [("ibuprofen", "400mg"), ("paracetamol", "325mg")],
        ", Iron ,+ + Folic Acid (1.5 mg)": [("iron", ""), ("folic acid", "1.5mg")],
        "Ferrous Ascorbate (100mg)": [("iron", "100mg")],
        "Multivitamin": [("multivitamin", "")],
        "": [],
        None: [],
    }
    got = ask(spark, composition.components, list(answers))
    assert [[tuple(p) for p in parts] for parts in got] == list(answers.values())


def test_signature_sorts_pairs_not_text(spark):
    parts = ask(spark, lambda c: composition.signature(composition.components(c)), ["b 5mg + a b 2mg + a 9mg"])
    assert parts == ["a@9mg|a b@2mg|b@5mg"]
    shown = ask(spark, lambda c: composition.display(composition.components(c)), ["b-complex + iron 5mg"])
    assert shown == ["B-Complex + Iron (5mg)"]
    keys = ask(spark, lambda c: composition.keys(composition.components(c)), ["iron 5mg + ferrous sulfate 2mg + a 1g"])
    assert keys == [["a", "iron"]]


def test_money_and_geo(spark):
    row = spark.range(1).select(
        money.saving(F.lit(33.6), F.lit(9.0)),
        money.percent(F.lit(2.5), F.lit(100.0)),
        money.percent(F.lit(1.0), F.lit(0.0)),
        F.round(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), 3),
        geo.in_box(F.lit(6.0), F.lit(98.0)),
        geo.in_box(F.lit(5.9), F.lit(98.0)),
        geo.map_link(F.lit("a b"), F.lit("c")),
        money.price_asof(F.lit(None).cast("string")),
    ).first()
    assert list(row) == [
        24.6, 2, 0, 111.195, True, False,
        "https://www.google.com/maps/search/?api=1&query=a+b+c", "Jul 2026",
    ]
