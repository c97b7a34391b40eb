import json


from rxframe import schemas
from rxframe.operators import captures, quality


def bronze(spark, *documents):
    rows = [("run", f"{i:064x}", d) for i, d in enumerate(documents)]
    return spark.createDataFrame(
        rows, "pipeline_run_id string, source_file_hash string, raw_response string"
    )


def test_shapes_of_documents(spark):
    good = json.dumps({"medicines": [{"raw_text": "Tab A", "normalized_name": None, "confidence": "HIGH"}]})
    documents = [
        good, '{"a', "", "[1]", "null", "5", "{}", '{"medicines": []}', '{"medicines": null}',
        '{"medicines": "x"}', '{"medicines": ["x"]}', good + " trailing",
        '{"medicines": [{"raw_text": "", "normalized_name": "Syp B", "dosage": "5ml", "frequency": "x 3"}]}',
        '{"medicines": [{"raw_text": "A"}], "medicines": [{"raw_text": "B"}]}',
    ]
    rows = captures.parse_captures(bronze(spark, *documents)).collect()
    got = {}
    for r in rows:
        got.setdefault(int(r["source_file_hash"], 16), []).append(
            (r["drug_name_raw"], r["drug_name_normalized"], r["extraction_confidence"], r["rejection_reason"])
        )
    bad, wrong = "unparseable_bronze_json", "malformed_payload"
    assert got == {
        0: [("Tab A", "A", 0.95, None)],
        1: [("", "", 0.0, bad)],
        2: [("", "", 0.0, bad)],
        3: [("", "", 0.0, wrong)],
        4: [("", "", 0.0, wrong)],
        5: [("", "", 0.0, wrong)],
        8: [("", "", 0.0, wrong)],
        9: [("", "", 0.0, wrong)],
        10: [("", "", 0.0, wrong)],
        11: [("", "", 0.0, bad)],
        12: [("Syp B", "B", 0.5, None)],
        13: [("B", "B", 0.5, None)],
    }
    line = [r for r in rows if r["drug_name_raw"] == "Syp B"][0]
    assert (line["dosage_value"], line["dosage_unit"], line["quantity"]) == (5.0, "ml", 3)
    assert line["line_id"] == "000000000000-0"


def test_no_python_in_parsing(spark, plan):
    text = plan(quality.check(captures.parse_captures(bronze(spark, "{}"))))
    assert "Python" not in text and "Exchange" not in text


def line(**given):
    base = {
        "line_id": "l", "source_file_hash": "h", "drug_name_raw": "A", "drug_name_normalized": "A",
        "dosage_value": 5.0, "dosage_unit": "mg", "frequency": None, "quantity": None,
        "extraction_confidence": 0.9, "pipeline_run_id": "r", "processed_at": None, "rejection_reason": None,
    }
    return tuple({**base, **given}.values())


def test_expectations_in_order(spark):
    cases = [
        (line(), None),
        (line(rejection_reason="flagged", drug_name_normalized=""), "flagged"),
        (line(drug_name_normalized=" ", extraction_confidence=2.0), "empty_drug_name"),
        (line(drug_name_normalized=None), "empty_drug_name"),
        (line(extraction_confidence=1.1), "confidence_out_of_range"),
        (line(dosage_value=100000.0), None),
        (line(dosage_value=100000.1, dosage_unit="spoon"), "dosage_out_of_range"),
        (line(dosage_value=-1.0), "dosage_out_of_range"),
        (line(dosage_value=float("nan")), "dosage_out_of_range"),
        (line(dosage_value=None, dosage_unit="MG"), None),
        (line(dosage_unit="spoon"), "unknown_dosage_unit"),
    ]
    rows = spark.createDataFrame([c[0] for c in cases], schemas.SILVER)
    assert [r[0] for r in rows.select(quality.first_failure()).collect()] == [c[1] for c in cases]
    clean, rejected = quality.split(rows)
    assert (clean.count(), rejected.count()) == (3, 8)
    summary = quality.failure_summary(quality.check(rows)).first()[0]
    assert summary["empty_drug_name"] == 2 and "zero_rows" not in summary
    only_bad = quality.check(rows.filter("dosage_unit = 'spoon'"))
    assert quality.failure_summary(only_bad).first()[0]["zero_rows"] == 1
    assert quality.failure_summary(quality.check(rows.limit(0))).first()[0] == {"zero_rows": 1}


def test_guards(spark):
    names = spark.createDataFrame([(" a ",), ("  ",), (None,)], "name string")
    assert [r[0] for r in quality.given_names(names).collect()] == ["a"]
    docs = bronze(spark, '{"is_prescription": true}', '{"is_prescription": false}', "{}", "x")
    assert quality.prescriptions_only(docs).count() == 1
    trend = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("c", 3, 60)], "pipeline_run_id string, run_finished_at int, silver_rows int")
    got = quality.row_count_trend(trend, 2).orderBy("pipeline_run_id").collect()
    assert [r["trailing_average"] for r in got] == [None, 10.0, 15.0]
