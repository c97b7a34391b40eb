"""Safety, dosing, stores, quota and reports on small tables worked by hand or by brute force."""

import itertools
import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from rxframe import schemas
from rxframe.operators import alternatives, curated, dosing, nearest, quota, reports, safety
from rxframe.sources import stores
from rxframe.streaming import quota as quota_stream

RULES = [
    (["Warfarin", "aspirin"], "major", "bleeding", "avoid", 0),
    (["aspirin", "ibuprofen"], "moderate", "stomach", "watch", 1),
    (["aspirin", "warfarin"], "moderate", "other way", "watch", 2),
    (["warfarin", "aspirin"], "moderate", "repeated", "watch", 3),
]
RULE_SCHEMA = "salts array<string>, severity string, effect string, advice string, rule_pos long"


def plain_pairs(a, b, seen, ignored=("multivitamin", "b-complex")):
    out = []
    sa, sb = {s.lower() for s in a[1]}, {s.lower() for s in b[1]}
    for salt in (sa & sb) - set(ignored):
        key = ("dup", salt, a[0], b[0])
        if key not in seen:
            seen.add(key)
            out.append((a[0], b[0], "moderate", salt))
    for salts, severity, effect, _, _ in RULES:
        r1, r2 = (s.lower() for s in salts)
        if (r1 in sa and r2 in sb) or (r1 in sb and r2 in sa):
            key = (r1, r2, a[0], b[0])
            if key not in seen:
                seen.add(key)
                out.append((a[0], b[0], severity, effect))
    return out


def shown(r):
    effect = r["effect"]
    if r["rule_pos"] == -1:
        effect = effect.split("contain ")[1].split(" —")[0].lower()
    return (r["brand_a"], r["brand_b"], r["severity"], effect)


def test_interactions_equal_all_pairs(spark):
    rng = random.Random(2)
    salts = ["warfarin", "aspirin", "ibuprofen", "Multivitamin", "iron", "b-complex"]
    kinds = [(f"B{i}", rng.sample(salts, rng.randint(1, 3))) for i in range(8)]
    baskets = {rx: [rng.choice(kinds) for _ in range(rng.randint(1, 9))] for rx in range(25)}
    rows = [(rx, i, b, s) for rx, meds in baskets.items() for i, (b, s) in enumerate(meds)]
    meds = spark.createDataFrame(rows, "rx_id int, position int, brand string, salt_keys array<string>")
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    got = {}
    for r in safety.interactions(meds, rules).collect():
        got.setdefault(r["rx_id"], []).append(shown(r))
    for rx, basket in baskets.items():
        seen, want = set(), []
        for a, b in itertools.combinations(basket, 2):
            want += plain_pairs(a, b, seen)
        assert sorted(got.get(rx, [])) == sorted(want), rx


def test_display_order(spark):
    meds = spark.createDataFrame(
        [(1, 0, "I", ["ibuprofen"]), (1, 1, "A", ["aspirin"]), (1, 2, "W", ["warfarin"])],
        "rx_id int, position int, brand string, salt_keys array<string>",
    )
    found = safety.interactions(meds, spark.createDataFrame(RULES, RULE_SCHEMA))
    rows = found.orderBy("rx_id", *safety.display_order()).collect()
    assert [(r["severity"], r["effect"], r["pos_a"], r["pos_b"]) for r in rows] == [
        ("major", "bleeding", 1, 2), ("moderate", "stomach", 0, 1), ("moderate", "other way", 1, 2),
    ]


def test_second_brand_stands_after_the_first(spark):
    """Basket B, A, B, C, B and a very long one: pos_b is the first place after pos_a."""
    rows = [(1, i, x, [s]) for i, (x, s) in enumerate([("B", "s"), ("A", "s"), ("B", "s"), ("C", "s"), ("B", "s")])]
    rows += [(2, i, f"x{i % 7}", ["t"]) for i in range(5000)]
    meds = spark.createDataFrame(rows, "rx_id int, position int, brand string, salt_keys array<string>")
    found = safety.interactions(meds, spark.createDataFrame([], RULE_SCHEMA))
    got = [(r["brand_a"], r["brand_b"], r["pos_a"], r["pos_b"]) for r in found.filter("rx_id = 1").orderBy(*safety.display_order()).collect()]
    assert [g for g in got if g[0] != g[1]] == [
        ("B", "A", 0, 1), ("B", "C", 0, 3), ("A", "B", 1, 2), ("A", "C", 1, 3), ("C", "B", 3, 4),
    ] and ("B", "B", 0, 2) in got
    assert found.filter("rx_id = 2").count() == 49


def test_cross_interactions_skip_the_same_brand(spark):
    scanned = [(1, 7, 0, "Asp", ["aspirin"]), (1, 7, 1, "Asp", ["aspirin"]), (2, 8, 0, "W", ["warfarin"])]
    saved = [(7, "ASP", ["aspirin"]), (7, "War", ["warfarin"]), (8, "Other", ["warfarin"]), (9, "A", ["aspirin"])]
    found = safety.cross_interactions(
        spark.createDataFrame(scanned, "scan_id int, user_id int, position int, brand string, salt_keys array<string>"),
        spark.createDataFrame(saved, "user_id int, brand string, salt_keys array<string>"),
        spark.createDataFrame(RULES, RULE_SCHEMA),
    ).collect()
    assert sorted((r["scan_id"], r["saved_med"], r["rule_pos"], r["pos_a"]) for r in found) == [
        (1, "War", 0, 0), (1, "War", 2, 0), (2, "Other", -1, 0),
    ]


DOSES = [
    ("p", "P", ["para"], "per_kg", 10.0, 15.0, "q6h", 4, 500.0, 3, [("S", 24.0)], None, "n", 0),
    ("c", "C", ["para", "ibu"], "per_kg", 1.0, 2.0, "q8h", None, None, None, None, None, None, 1),
    ("z", "Z", ["zinc"], "fixed", None, None, "od", 1, None, 24, None, [("2y", 10.0, "half")], "", 2),
    ("p2", "P2", ["para"], "per_kg", 1.0, 1.0, "x", None, 0.0, 0, None, None, None, 3),
]


def test_dosing(spark):
    rules = spark.createDataFrame(DOSES, schemas.DOSE_RULES + ", rule_pos int")
    meds = spark.createDataFrame(
        [(1, ["Para"]), (2, ["ibu", "PARA", "x"]), (3, ["ibu"]), (4, ["zinc"]), (5, [])], "id int, salt_keys array<string>"
    )
    matched = {r["id"]: r["rule_id"] for r in dosing.match_rules(meds, rules).collect()}
    assert matched == {1: "p", 2: "c", 3: None, 4: "z", 5: None}
    asked = spark.createDataFrame(
        [(1, "p", 8.0), (2, "p", 40.0), (3, "p", 60.5), (4, "z", 10.0), (5, "none", 10.0), (6, "c", 2.5), (7, "p", None)],
        "n int, rule_id string, weight_kg double",
    )
    got = {r["n"]: r for r in dosing.dose_table(asked, rules).collect()}
    one = got[1]
    assert (one["dose_mg_low"], one["dose_mg_high"], one["capped"]) == (80.0, 120.0, False)
    # 80 / 24 = 3.33 ml -> 3.25, 120 / 24 = 5 ml -> halves
    assert [tuple(s) for s in one["syrups"]] == [("S", 3.25, 5.0)]
    assert one["cautions"] == ["Not for children below 3 month(s) without a doctor's advice."]
    assert (got[2]["dose_mg_low"], got[2]["dose_mg_high"]) == (400.0, 500.0)
    assert got[2]["cautions"][1] == "Dose capped at the child maximum of 500 mg per dose."
    assert got[3]["error"].startswith("Weight must be between 2.5 and 60.0 kg.") and got[3]["label"] is None
    assert got[4]["fixed_doses"][0]["dose_text"] == "half" and got[4]["dose_mg_low"] is None
    assert got[4]["cautions"] == ["Not for children below 2 year(s) without a doctor's advice."]
    assert got[5]["error"] == "No paediatric dosing data for 'none'."
    assert got[6]["error"] is None and got[6]["cautions"] == [] and got[6]["max_doses_per_day"] is None
    assert got[7]["error"] is not None
    ml = spark.createDataFrame([(0.125,), (0.375,), (4.99,), (5.25,), (5.75,)], "m double")
    assert [r[0] for r in ml.select(dosing.round_ml(F.col("m"))).collect()] == [0.0, 0.5, 5.0, 5.0, 6.0]


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("k", [1, 4, 25])
def test_nearest_equals_brute_force(spark, k):
    rng = random.Random(k)
    places = [(rng.uniform(8, 36), rng.uniform(69, 97)) for _ in range(40)]
    places += [(19.0 + rng.uniform(0, 0.05), 73.0 + rng.uniform(0, 0.05)) for _ in range(60)]
    places += [(28.6, 77.2)] * 50
    rows = [(f"{i:04d}", "n", "a", "d", "s", "p", *ll) for i, ll in enumerate(places)]
    table = spark.createDataFrame(rows, "code string, name string, address string, district string, state string, pincode string, lat double, lng double")
    probes = [(rng.uniform(8, 36), rng.uniform(69, 97)) for _ in range(30)]
    probes += [(19.02, 73.02), (28.6, 77.2), (0.0, 0.0), (40.7, -74.0), (71.0, 25.0), (-33.9, 151.2), (20.0, 179.9)]
    asked = spark.createDataFrame([(i, *ll) for i, ll in enumerate(probes)], "probe int, lat double, lng double")
    got = {}
    for r in nearest.nearest_stores(asked, table, k).collect():
        got.setdefault(r["probe"], {})[r["rank"]] = (r["code"], r["distance_km"])
    for i, ll in enumerate(probes):
        ranked = sorted((round(km(ll, s), 9), f"{n:04d}") for n, s in enumerate(places))[:k]
        assert [got[i][n + 1][0] for n in range(k)] == [c for _, c in ranked], ll
        assert got[i][1][1] == pytest.approx(round(ranked[0][0], 1), abs=0.051)


def test_fewer_stores_than_asked(spark):
    table = spark.createDataFrame([("1", "n", "a", "d", "s", "p", 20.0, 70.0)], "code string, name string, address string, district string, state string, pincode string, lat double, lng double")
    asked = spark.createDataFrame([(0, 20.0, 70.0), (1, 30.0, 90.0)], "probe int, lat double, lng double")
    assert nearest.nearest_stores(asked, table, 10).count() == 2


def test_store_build(spark):
    offices = spark.createDataFrame(
        [(" 1", "10", "70"), ("1", "11", "71"), ("1", "NA", "70"), ("1", "0", "70"), ("2", "90", "70")],
        "pincode string, latitude string, longitude string",
    )
    centre = stores.pincode_centroids(offices)
    assert [tuple(r) for r in centre.collect()] == [("1", 10.5, 70.5)]
    docs = spark.createDataFrame([('{"1": [{"code": "a", "name": "n"}, {"code": "b"}], "2": [{"code": "c"}]}',)], "value string")
    all_stores = stores.explode_store_json(docs)
    assert sorted(r["code"] for r in stores.locate(all_stores, centre).collect()) == ["a", "b"]
    assert tuple(stores.build_report(all_stores, centre).first()) == (2, 1, 1)
    asked = spark.createDataFrame([(1, " 1 "), (2, "9")], "probe int, pincode string")
    assert [r["probe"] for r in nearest.resolve_pincodes(asked, centre).collect()] == [1]


def plain_quota(hits, limit, window):
    recent, out = {}, {}
    for event, client, at in sorted(hits, key=lambda h: (h[2], h[0])):
        q = recent.setdefault(client, deque())
        while q and q[0] < at - window:
            q.popleft()
        out[event] = len(q) < limit
        if out[event]:
            q.append(at)
    return out


@pytest.mark.parametrize("limit,window", [(1, 10), (6, 3600), (3, 60)])
def test_quota_equals_one_by_one(spark, limit, window):
    rng = random.Random(limit)
    hits = [(i, rng.choice("aaaab"), rng.randrange(0, 20000) if i % 3 else rng.randrange(0, 300)) for i in range(900)]
    log = spark.createDataFrame(hits, "event_id long, client string, s int").selectExpr(
        "event_id", "client", "timestamp_seconds(s) AS ts"
    )
    got = {r["event_id"]: r["admitted"] for r in quota.admissions(log, limit, window).collect()}
    assert got == plain_quota(hits, limit, window)


def test_quota_on_a_stream(spark, tmp_path):
    hits = [(i, "a" if i % 4 else "b", 1000 + i * 7) for i in range(200)]
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (hits[:120], hits[120:]):
        spark.createDataFrame(part, "event_id long, client string, s int").selectExpr(
            "event_id", "client", "timestamp_seconds(s) AS ts"
        ).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("event_id long, client string, ts timestamp").parquet(folder)
        (
            quota_stream.admissions(stream, 3, 60)
            .writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
            .start().awaitTermination()
        )
    got = {r["event_id"]: r["admitted"] for r in spark.read.parquet(out).collect()}
    assert got == plain_quota(hits, 3, 60)


def test_alternatives(spark, plan):
    rows = [
        (1, "Aa", 5.0, "s"), (2, "aA", 3.0, "s"), (3, "B", 3.0, "s"), (4, "C", 1.0, "s"), (5, "D", 9.0, "s"), (6, "E", 1.0, "t"),
    ]
    items = spark.createDataFrame([(p, n, "pk", x, g) for p, n, x, g in rows], "pos long, name string, pack string, price double, signature string")
    own = items.select("pos", F.col("name").alias("brand"), "signature")
    found = alternatives.with_alternatives(own, items, 2)
    got = {r["pos"]: [a["brand"] for a in r["alternatives"]] for r in found.collect()}
    assert got == {1: ["C", "B"], 2: ["C", "B"], 3: ["C", "aA"], 4: ["aA", "B"], 5: ["C", "aA"], 6: []}
    assert "WindowGroupLimit" in plan(found)


def test_curated_merge(spark):
    schema = "pos long, brand string, category string, aliases array<string>"
    base = spark.createDataFrame([(1, "Dolo", "Pain", ["d"])], schema)
    more = spark.createDataFrame(
        [(1, "DOLO", "Pain", []), (2, "Pan-40", "Acid", ["PP"]), (3, "pan-40", "Acid", [])],
        "pos long, brand string, category string, extra_aliases array<string>",
    )
    got = curated.merge_brands(base, more).orderBy(*curated.category_order()).collect()
    assert [(r["brand"], r["aliases"]) for r in got] == [("Pan-40", ["pan", "pp"]), ("Dolo", ["d"])]
    rules = spark.createDataFrame([(["a", "B"], 1)], "salts array<string>, rule_pos long")
    new = spark.createDataFrame([(["b", "A"], 2), (["c", "a"], 3), (["A", "c"], 4)], "salts array<string>, rule_pos long")
    assert sorted(r["rule_pos"] for r in curated.merge_rules(rules, new).collect()) == [1, 3]


def test_reports_on_empty_tables(spark):
    health = reports.pipeline_health(spark.createDataFrame([], schemas.METRICS), spark.createDataFrame([], schemas.GOLD)).collect()
    assert len(health) == 1 and health[0]["status"] == "no_runs"
    empty = spark.createDataFrame([], "verdict string, matched_brand string")
    assert reports.feedback_stats(empty).first().asDict() == {"total": 0, "correct": 0, "wrong": 0, "accuracy_pct": None}
    assert reports.match_stats(spark.createDataFrame([], schemas.GOLD)).first()["match_rate"] == 0.0
    assert reports.mean_confidence(spark.createDataFrame([], schemas.SILVER)).first()["mean_confidence"] == 0.0


def test_history(spark, plan):
    rows = [(i, 1, "scan", i, '{"medicines":[{"brand":"","query":"q"}],"totals":{"saving":1.25}}') for i in range(7)]
    rows.append((9, 2, "scan", 9, "{}"))
    scans = spark.createDataFrame(rows, "id long, user_id long, source string, created_at long, result string")
    history = reports.scan_history(scans, 3)
    got = history.orderBy("id").collect()
    assert [r["id"] for r in got] == [4, 5, 6, 9]
    assert (got[0]["medicines"], got[0]["saving"], got[0]["warnings"]) == (["q"], 1.25, 0)
    assert (got[3]["medicines"], got[3]["saving"]) == ([], 0.0)
    assert "WindowGroupLimit" in plan(history)
    totals = {r["user_id"]: r["total_saving"] for r in reports.lifetime_saving(scans).collect()}
    assert totals == {1: 8.75, 2: 0.0}


@pytest.mark.parametrize("k", [1, 7])
def test_nearest_at_poles_and_date_line(spark, plan, k):
    rng = random.Random(k)
    places = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)]
    places += [(rng.uniform(-17, -16), rng.choice([179.9, -179.9, 180.0, -180.0])) for _ in range(20)]
    places += [(90.0, 10.0), (89.99, -170.0), (-90.0, 0.0), (-89.5, 45.0)]
    rows = [(f"{i:04d}", "n", "a", "d", "s", "p", *ll) for i, ll in enumerate(places)]
    table = spark.createDataFrame(rows, "code string, name string, address string, district string, state string, pincode string, lat double, lng double")
    probes = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(25)]
    probes += [(90.0, 0.0), (-90.0, 90.0), (89.9, 179.0), (-16.5, 180.0), (-16.5, -180.0), (-16.5, 179.99), (0.0, -179.99)]
    asked = spark.createDataFrame([(i, *ll) for i, ll in enumerate(probes)] + [(99, None, 1.0)], "probe int, lat double, lng double")
    found = nearest.nearest_stores(asked, table, k)
    got = {(r["probe"], r["rank"]): r["code"] for r in found.collect()}
    for i, ll in enumerate(probes):
        ranked = sorted((round(km(ll, s), 9), f"{n:04d}") for n, s in enumerate(places))[:k]
        assert [got[i, n + 1] for n in range(k)] == [c for _, c in ranked], ll
    assert len(got) == k * len(probes) and "CartesianProduct" not in plan(found) and "NestedLoop" not in plan(found)


def test_quota_state_expires(spark, tmp_path):
    """Clients idle for a window leave the state; a hit behind the watermark gives no row."""
    folder, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    parts = [[(i, f"c{i % 40}", 1000 + i) for i in range(80)], [(100, "late", 1005), (101, "x", 10_000), (102, "c1", 10_001)], [(103, "x", 10_002)], [(104, "x", 10_003)]]
    for part in parts:
        spark.createDataFrame(part, "event_id long, client string, s int").selectExpr("event_id", "client", "timestamp_seconds(s) AS ts").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema("event_id long, client string, ts timestamp").parquet(folder)
        writer = quota_stream.admissions(stream, 3, 60, late_seconds=0).writeStream.format("parquet").option("path", out)
        writer.option("checkpointLocation", cp).trigger(availableNow=True).start().awaitTermination()
    got = {r["event_id"]: r["admitted"] for r in spark.read.parquet(out).collect()}
    assert set(got) == {*range(80), 101, 102, 103, 104} and all(got.values())
    left = {r["key"]["client"] for r in spark.read.format("statestore").load(cp).collect()}
    assert left == {"x", "c1"}
