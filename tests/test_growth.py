"""What keeps figures of large tables in proportion: files of bounded size, few shuffles, patterns matched once."""

import glob
import os
import re
import time
import uuid

from pyspark.sql import functions as F

from checks import fixtures as X
from checks import queries as Q
from rxframe import session
from rxframe.functions import text
from rxframe.operators import matching, quality, safety
from rxframe.operators.captures import parse_captures
from rxframe.plans import lookup
from rxframe.sinks import upsert as U
from rxframe.sources import catalogue, landing

RULES = "salts array<string>, severity string, effect string, advice string, rule_pos long"


def test_landing_files_do_not_grow_with_a_partition(spark, tmp_path):
    docs = spark.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    files = landing.scan(spark, Q._landing_folder(spark, str(tmp_path))).select("length").collect()
    assert len(files) == -(-1500 // Q.LANDING_RECORDS)
    assert sum(f.length for f in files) == sum(2 * n + 1 for n in range(1500)) + 2  # the empty text is written as ""


def _medicines(spark):
    rows = [("r", 0, "A", ["p", "q"]), ("r", 1, "B", ["q"]), ("r", 2, "A", ["p", "q"]), ("r", 3, "A", ["z"]), (None, 0, "A", ["p"]), (None, 1, "B", ["p"]), ("s", 0, "C", [None, "p"]), ("s", 1, "D", [None, "q"])]
    return spark.createDataFrame(rows, "rx_id string, position int, brand string, salt_keys array<string>")


def test_warnings_meet_rules_without_a_shuffle_of_pairs(spark, plan):
    rules = spark.createDataFrame([(["p", "q"], "major", "e", "v", 0)], RULES)
    found = safety.interactions(_medicines(spark), rules, keep=session.settle)
    rows = sorted((r.rx_id, r.brand_a, r.brand_b, r.rule_pos, r.pos_a, r.pos_b) for r in found.collect())
    assert rows == [
        ("r", "A", "A", -1, 0, 2), ("r", "A", "A", -1, 0, 2), ("r", "A", "A", 0, 0, 2), ("r", "A", "B", -1, 0, 1), ("r", "A", "B", 0, 0, 1),
        ("r", "B", "A", -1, 1, 2), ("r", "B", "A", 0, 1, 2), ("s", "C", "D", 0, 0, 1),
    ]
    dealt = _medicines(spark).repartition(4, "rx_id")
    text = plan(safety.interactions(dealt, rules, keep=session.settle))
    assert "SortMergeJoin" not in text and len(re.findall(r"Exchange hashpartitioning\(rx_id", text)) == 1


def test_cross_warnings_stay_with_their_scan(spark, plan):
    rules = spark.createDataFrame([(["p", "q"], "major", "e", "v", 0)], RULES)
    scanned = _medicines(spark).withColumnRenamed("rx_id", "scan_id").withColumn("user_id", F.lit(1)).repartition(4, "scan_id")
    saved = spark.createDataFrame([(1, "D", ["q"]), (1, "a", ["p"]), (2, "E", ["q"])], "user_id int, brand string, salt_keys array<string>")
    found = safety.cross_interactions(scanned, saved, rules, keep=session.settle)
    rows = sorted((r.scan_id, r.brand_a, r.saved_med, r.rule_pos) for r in found.filter("scan_id = 's'").collect())
    assert rows == [("s", "C", "D", 0), ("s", "C", "a", -1), ("s", "D", "a", 0)]
    assert not re.search(r"Exchange hashpartitioning\([^)]*(brand|user_id[^)]*salt|rule_pos)", plan(found))


def test_captures_deal_their_lines_once_by_prescription(spark, small, plan):
    text = plan(X.captures(spark, small))
    assert "hashpartitioning(l_orderkey" not in text
    assert len(re.findall(r"Exchange hashpartitioning\(rx_id", text)) == 2  # lines and orders


def test_patterns_of_a_line_are_matched_once(spark, small, plan):
    kept = quality.check(parse_captures(X.captures(spark, small), X.processed_at())).filter("rejection_reason IS NULL")
    text = plan(kept.select("line_id", "drug_name_normalized", "dosage_value", "dosage_unit"))
    assert text.count("regexp_extract") == 2 and text.count("(?i)^(tab") == 1


def test_upsert_in_one_shuffle_keeps_rows_whose_key_is_null(spark, tmp_path):
    kind, keys, order, path = "a string, b int, v int", ["a", "b"], [F.col("v").desc()], f"{tmp_path}/t"
    U.upsert(spark.createDataFrame([("x", 1, 1), (None, 1, 2), ("y", None, 3)], kind), path, keys, order, 2)
    U.upsert(spark.createDataFrame([("x", 1, 0), (None, 1, 1), (None, 1, 5), ("y", None, 3)], kind), path, keys, order, 2)
    found = sorted(map(tuple, U.read_table(spark, path).collect()), key=str)
    assert found == sorted([("x", 1, 0), (None, 1, 2), (None, 1, 5), ("y", None, 3), ("y", None, 3)], key=str)
    rows = U._merged(spark.range(5).selectExpr("id AS k", "id AS v"), spark.range(9).selectExpr("id AS k", "id AS v"), ["k"], [F.col("v")], F.lit(0))
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_lines_of_a_document_lie_together(spark, tmp_path):
    kind, keys, order = "h string, l string, v int", ["h", "l"], [F.col("v").desc()]
    rows = [(f"{i % 40:064x}", f"{i}", 0) for i in range(400)] + [(None, "1", 0), (None, "2", 0)]
    first = spark.createDataFrame(rows, kind).repartition(3)
    again = first.filter("h IS NOT NULL AND CAST(l AS int) < 50").withColumn("v", F.lit(1)).unionByName(first.filter("h IS NULL").withColumn("v", F.lit(2)))
    places = {}
    for near in (None, ["h"]):
        path = f"{tmp_path}/{near and near[0]}"
        U.upsert(first, path, keys, order, 4, near=near)
        U.upsert(again, path, keys, order, 4, near=near)
        places[near and near[0]] = sorted(map(str, U.read_table(spark, path).collect()))
    assert places[None] == places["h"]
    found = U.read_table(spark, path).withColumn("file", F.regexp_extract(F.input_file_name(), f"{U.BUCKET}=[0-9]+/[^/]*$", 0))
    assert found.groupBy("h").agg(F.countDistinct("file").alias("n")).filter("n > 1").count() == 0
    # A table dealt by other keys is written anew, and no row is found twice.
    path = f"{tmp_path}/None"
    U.upsert(again, path, keys, order, 4, near=["h"])
    assert U.current(spark, path).near == ["h"]
    again_read = U.read_table(spark, path)
    assert again_read.filter("h IS NOT NULL").groupBy("h", "l").count().filter("count > 1").count() == 0


def test_few_distinct_names_leave_the_lines_where_they_are(spark, plan):
    products = spark.createDataFrame([("red ring", 1.0, 0, "s", "s", "red", "red ring")], "name string, price double, pos long, salt string, signature string, block_key string, name_norm string")
    groups = spark.createDataFrame([("s", "red ring", 1.0)], "signature string, generic_name string, generic_price double")
    lines = spark.createDataFrame([("1", "h", "red rin", "r")], "line_id string, source_file_hash string, drug_name_normalized string, pipeline_run_id string")
    text = plan(matching.match_lines(lines, products, groups, "edit", keep=session.settle))
    assert "Exchange hashpartitioning(q_norm" not in text


ODD = ["Tab. A  b", " Tab A", "tab", "T. x-ray", "A-b - c", "a\tb", " Cap x ", "Tab y", "café  au", "\x1ca\x85", "drops x", "Drop. y", "Tab  Tab z", "", " ", "a ", "-", "- a", "Kelvin x", None, "Tab-x", "inj.", "C \x0b", "plain name 12"]


def test_texts_without_odd_blanks_skip_the_patterns_and_stay_the_same(spark, plan):
    names = spark.createDataFrame([(t,) for t in ODD], "t string")
    c, some = F.col("t"), text.K.FORM_PREFIXES_SHORT
    stripped = F.trim(F.coalesce(c, F.lit("")), F.lit(text.BLANKS))
    pairs = {
        "strip": (text.strip(c), stripped),
        "norm": (text.norm(c), text._norm(c)),
        "clean": (text.clean_name(c), F.trim(text._blanks(text.strip_form_prefix(stripped)))),
        "term": (text.query_term(c), text._norm(text.strip_form_prefix(stripped))),
        "short": (text.query_term(c, some), text._norm(text.strip_form_prefix(stripped, some))),
    }
    for name, (fast, slow) in pairs.items():
        for row in names.select("t", fast.alias("fast"), slow.alias("slow")).collect():
            assert row.fast == row.slow, (name, row)
    # The pattern is one branch only, and a missing quantity is null before the cast, which would fail on ''.
    for c in (text.norm(c), text.clean_name(c), text.query_term(c)):
        assert "octet_length(" in plan(names.select(c))
    said = plan(names.select(text.quantity(F.col("t"))))
    assert ")) null else try_cast(" in said


def test_captures_are_dealt_by_a_number(spark, small, plan):
    # A bigint is shown with an L.
    assert len(re.findall(r"Exchange hashpartitioning\(rx_id#\d+L", plan(X.captures(spark, small)))) == 2


def _catalogue(spark, rows):
    kind = "pos long, name string, price string, is_discontinued string, pack string, short_composition1 string, short_composition2 string"
    return spark.createDataFrame(rows, kind).coalesce(1)


def test_a_catalogue_in_one_file_is_parsed_by_many_tasks(spark, plan):
    rows = [(i, f"drug {i % 5} tablet", "9.5", " true " if i == 1 else "FALSE", "p", f"x ({i % 3}mg)", None) for i in range(64)]
    rows += [(100, "a", None, "FALSE", "p", "x", None), (101, "b", "0", "FALSE", "p", "x", None), (102, "c", "1", "FALSE", "p", " , ", ""),
             (103, "d", " 1 ", "FALSE", "p", None, " y 5mg,"), (104, "e", "1", None, "p", "x", None), (105, "f", "1", "no", "p", None, None)]
    items = catalogue.import_products(_catalogue(spark, rows), {})
    read = plan(items).split("Exchange", 1)[1]
    assert "trim" not in read and "Filter" not in read
    assert sorted(r.pos for r in items.collect()) == [0, *range(2, 64), 103, 104]
    assert items.select(F.spark_partition_id()).distinct().count() > 4


def test_terms_of_one_name_are_stripped_once(spark, plan):
    rows = [(i, "drug tablet", "1", "FALSE", "p", "x", None) for i in (7, 3, 5)] + [(4, "drug", "1", "FALSE", "p", "x", None), (None, "odd", "1", "FALSE", "p", "x", None), (1, "odd", "1", "FALSE", "p", "x", None)]
    none = spark.createDataFrame([], "pos long, brand string, aliases array<string>, salt string")
    found = matching.term_index(none, catalogue.import_products(_catalogue(spark, rows), {}))
    assert sorted((r.term, r.tier, r.pos, r.variant) for r in found.filter("pos IS NOT NULL").collect()) == [("drug", 1, 3, 1), ("drug tablet", 1, 3, 0)]
    assert [r.term for r in found.filter("pos IS NULL").collect()] == ["odd"]
    text = plan(found)
    assert re.search(r"Generate posexplode.*\n(.*\n)*?.*HashAggregate\(keys=\[name_norm", text)


def test_products_of_a_reference_are_parsed_once(spark, small, plan):
    ref = X.reference(spark, small)
    for rows in (ref.terms, ref.entries.filter("tier = 1"), ref.products):
        assert not [f for f in rows.inputFiles() if "part.parquet" in f]
    found = lookup.match_requests(lookup.names_as_requests(X.rx_lines(spark, small).select("rx_id", "position", "name")), ref, keep=session.settle)
    assert [f for f in found.inputFiles() if "/entries/" in f] and "BroadcastHashJoin [tier" in plan(found)


def test_captures_need_no_numbers_of_their_lines(spark, tmp_path, plan):
    when = F.lit("1997-01-02").cast("timestamp")
    lines = [(5, 2, 5, 1, 1.0, 1.0, "A"), (5, 1, 5, 1, 1.0, 1.0, "A"), (5, 1, 5, 1, 1.0, 1.0, "A"), (5, 9, 5, None, 1.0, 1.0, "A"), (5, 2, 5, None, None, 2.0, None), (None, 1, 5, 1, 1.0, 1.0, "N")]
    parts = [(1, "pale bolt", 3), (1, "dark bolt", 3), (2, "red nut", 4), (None, "odd", 5)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string"
    spark.createDataFrame(lines, columns).withColumn("l_shipdate", when).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(5,), (4,)], "o_orderkey long").withColumn("o_orderdate", when).write.parquet(f"{tmp_path}/orders.parquet")
    found = X.captures(spark, str(tmp_path))
    assert "Window" not in plan(found)
    spoken = [re.findall(r'"raw_text":"Tab ([^"]*)"', r.raw_response) for r in found.collect()]
    # Both parts of a key stand beside each other, once for every line; the line without a number comes first.
    assert sorted(spoken) == [[], ["red nut 4", "dark bolt 3", "pale bolt 3", "dark bolt 3", "pale bolt 3", "red nut 4"]]


def test_requests_number_their_lines_before_they_meet_the_parts(spark, small, plan):
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(X.requests(spark, small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    by_part = text.index("Exchange hashpartitioning(l_partkey")
    assert by_part < text.index("Window ") < text.index("Exchange hashpartitioning(rx_id")
    assert "l_extendedprice" not in text[by_part:].split("\n", 2)[1]
    numbered = X.rx_lines(spark, small).select("rx_id", "position", F.concat(F.lit("Tab "), "name").alias("n"))
    asked = X.requests(spark, small).filter("raw_text <> ' '").select("rx_id", "position", F.col("raw_text").alias("n"))
    kept = numbered.filter("CAST(rx_id AS bigint) % 50 <> 3")
    assert asked.exceptAll(kept).count() == 0 and kept.exceptAll(asked).count() == 0


def test_a_lookup_deals_its_lines_once(spark, plan):
    terms = spark.createDataFrame([("red", 1, 0, 0), ("blue", 1, 1, 0)], "term string, tier int, pos long, variant int")
    items = spark.createDataFrame([(0, "red", ["p", "q"], "s"), (1, "blue", ["q"], "s")], "pos long, name string, salt_keys array<string>, signature string")
    items = items.withColumns({"price": F.lit(2.0), "pack": F.lit("x"), "name_norm": F.col("name")})
    entries = items.select(
        F.lit(1).alias("tier"), "pos", F.col("name").alias("brand"), F.lit("p").alias("salt"), "salt_keys", F.lit("c").alias("category"), "pack",
        F.col("price").alias("brand_price"), F.lit("red").alias("generic_name"), F.lit(1.0).alias("generic_price"), F.lit("d").alias("price_asof"), "signature",
        F.lit(2).alias("same_salt_brands"),
    )
    rules = spark.createDataFrame([(["p", "q"], "major", "e", "v", 0)], RULES)
    asked = spark.createDataFrame([("r", 0, "red"), ("r", 1, "blue"), (None, 0, "red"), (None, 1, "blue")], "rx_id string, position int, name string")
    found = lookup.lookup(lookup.names_as_requests(asked), lookup.Reference(terms, entries, items, rules))
    assert len(re.findall(r"Exchange hashpartitioning\(rx_id", plan(found.interactions))) == 1
    assert [f for f in found.medicines.inputFiles() if "/cheapest/" in f]
    assert sorted((r.rx_id, r.brand_a, r.brand_b, r.rule_pos) for r in found.interactions.collect()) == [("r", "red", "blue", -1), ("r", "red", "blue", 0)]
    assert found.medicines.count() == 4


def _shuffles(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_shuffle_files_of_a_packed_table_go(spark):
    before = _shuffles(spark)
    rows = session.pack(spark.range(1000).repartition(5, "id"), "numbers")
    until = time.time() + 20
    while _shuffles(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not _shuffles(spark) - before
    assert rows.count() == 1000 and spark.conf.get(session.SWEEP) == "false"
    with session.passing() as keep:
        path = keep(rows, "numbers").inputFiles()[0]
        assert U.exists(spark, path)
    assert not U.exists(spark, path)


def test_an_upsert_in_slices_gives_the_same_rows(spark, tmp_path, monkeypatch):
    kind, keys, order = "h string, l string, v int", ["h", "l"], [F.col("v").desc()]
    first = session.settle(spark.createDataFrame([(f"{i % 40}", f"{i}", 0) for i in range(400)] + [(None, "1", 0)], kind))
    again = session.settle(spark.createDataFrame([(f"{i % 40}", f"{i}", v) for i in range(0, 400, 7) for v in (1, 2)] + [(None, "1", 1), ("7", None, 1)], kind))
    found, jobs = {}, []
    merged = U._merged
    monkeypatch.setattr(U, "_merged", lambda *a: jobs.append(1) or merged(*a))
    for most in (U.SLICE, 1):
        monkeypatch.setattr(U, "SLICE", most)
        path = f"{tmp_path}/{most}"
        U.upsert(first, path, keys, order, 4, stored=True, near=["h"])
        U.upsert(again, path, keys, order, 4, stored=True, near=["h"])
        found[most] = (sorted(map(str, U.read_table(spark, path).collect())), len(jobs), sorted(U.current(spark, path).holders))
    whole, cut = found.values()
    assert (whole[0], whole[2]) == (cut[0], cut[2]) and (whole[1], cut[1]) == (2, 10)


def _left(spark, small, query, tmp_path, monkeypatch) -> set[str]:
    """What a query leaves in the scratch folder beside its layers."""
    monkeypatch.setattr(session, "scratch_root", lambda spark: f"{tmp_path}/rxframe-{uuid.uuid4().hex}")
    assert Q.QUERIES[query](spark, small).count() > 5000
    found = {os.path.basename(f) for f in glob.glob(f"{tmp_path}/rxframe-*/*")}
    assert {"bronze", "silver", "gold", "quarantine"} < found
    return found - {"bronze", "silver", "gold", "quarantine", "products", "checkpoint"}


def test_a_replay_leaves_its_layers_only(spark, small, tmp_path, monkeypatch):
    assert not _left(spark, small, "replay_lines", tmp_path, monkeypatch)


def test_a_micro_batch_leaves_its_layers_only(spark, small, tmp_path, monkeypatch):
    assert not _left(spark, small, "incremental_refine", tmp_path, monkeypatch)
