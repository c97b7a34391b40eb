"""Readers of the reference files."""

import json

from rxframe import schemas
from rxframe.sources import files, stores


def test_offices_and_stores(spark, tmp_path):
    text = (
        "﻿CircleName,OfficeName,Pincode,Latitude,Longitude\n"
        'A,"Head\nOffice",110001,28.5,77.0\nA,"The ""old"" one", 110001 ,28.7,77.4\nA,x,110002,NA,77\nA,y,110003,0,0\n'
    )
    (tmp_path / "p.csv").write_text(text, encoding="utf-8")
    known = stores.pincode_centroids(files.offices(spark, str(tmp_path / "p.csv")))
    assert [tuple(r) for r in known.collect()] == [("110001", 28.6, 77.2)]
    store = {"code": "K1", "name": "n", "address": "a", "district": "d", "state": "s"}
    folder = tmp_path / "stores"
    folder.mkdir()
    (folder / "one.json").write_text(json.dumps({"110001": [store, store | {"code": "K2"}], "9": [store | {"code": "K3"}]}, indent=1))
    (folder / "bad.json").write_text('{"110001": [')
    read = files.documents(spark, str(folder))
    assert files.broken(read, stores.STORE_JSON).first()["broken"] == 1
    found = stores.explode_store_json(read)
    assert sorted(r["code"] for r in stores.locate(found, known).collect()) == ["K1", "K2"]
    report = stores.build_report(found, known).first()
    assert (report["located"], report["skipped"], report["centroids"]) == (2, 1, 1)


def test_rules_brands_and_notes(spark, tmp_path):
    rule = {"salts": ["a", "b"], "severity": "major", "effect": "e", "advice": "x"}
    (tmp_path / "i.json").write_text(json.dumps({"note": "n", "interactions": [rule, rule | {"effect": "f"}]}, indent=2))
    rows = files.interaction_rules(spark, str(tmp_path / "i.json")).orderBy("rule_pos").collect()
    assert [(r["rule_pos"], r["effect"], r["salts"]) for r in rows] == [(0, "e", ["a", "b"]), (1, "f", ["a", "b"])]
    dose = {"id": "p", "label": "P", "salts": ["p"], "type": "per_kg", "mg_per_kg_low": 10, "mg_per_kg_high": 15,
            "frequency": "often", "max_doses_per_day": 4, "syrups": [{"label": "s", "mg_per_ml": 24}]}
    (tmp_path / "d.json").write_text(json.dumps({"disclaimer": "c", "rules": [dose]}))
    read = files.dose_rules(spark, str(tmp_path / "d.json"))
    assert read.schema == spark.createDataFrame([], schemas.DOSE_RULES).schema
    row = read.first()
    assert (row["id"], row["mg_per_kg_low"], row["syrups"][0]["mg_per_ml"], row["fixed_doses"]) == ("p", 10.0, 24.0, None)
    brand = {"brand": "B", "aliases": ["b"], "salt": "S 5mg", "salt_keys": ["s"], "category": "C", "pack": "p",
             "brand_price": 9.5, "generic": {"name": "g", "price": 2}}
    (tmp_path / "m.json").write_text(json.dumps({"brands": [brand, brand | {"brand": "D", "price_asof": "May 2020"}]}))
    rows = files.curated(spark, str(tmp_path / "m.json")).orderBy("pos").collect()
    assert [(r["pos"], r["brand"], r["generic"]["price"], r["price_asof"]) for r in rows] == [(0, "B", 2.0, None), (1, "D", 2.0, "May 2020")]
    (tmp_path / "n.json").write_text(json.dumps({"s": {"uses": "u", "side_effects": "v"}}))
    assert tuple(files.ingredient_notes(spark, str(tmp_path / "n.json")).first()) == ("s", "u", "v")
