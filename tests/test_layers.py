"""Upserts, stored layers, whole runs, replay, streams, landing files."""

import os

import pytest
from pyspark.sql import functions as F

from checks import fixtures as X
from rxframe import schemas
from rxframe.plans import pipeline
from rxframe.session import settle
from rxframe.sinks import upsert as U
from rxframe.sinks.layers import Layers
from rxframe.sources import catalogue, landing
from rxframe.streaming import ingest

ROW = "k long, at long, v string"


def newest():
    return [F.col("at").desc(), F.col("v").desc()]


def content(rows):
    return sorted(tuple(r) for r in rows.collect())


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (2, 2, "c")], ROW)
    U.upsert(first, path, ["k"], newest(), 4)
    assert content(U.read_table(spark, path)) == [(1, 1, "a"), (2, 2, "c")]
    more = spark.createDataFrame([(2, 1, "older wins too"), (3, 1, "d")], ROW)
    for _ in range(2):  # again changes nothing
        U.upsert(more, path, ["k"], newest(), 4)
        assert content(U.read_table(spark, path)) == [(1, 1, "a"), (2, 1, "older wins too"), (3, 1, "d")]
    U.upsert(more.limit(0), path, ["k"], newest(), 4)
    assert U.read_table(spark, path).count() == 3
    merged = U.merge(first.filter("at = 1"), more, ["k"], newest())
    assert content(merged) == [(1, 1, "a"), (2, 1, "older wins too"), (3, 1, "d")]


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(200).selectExpr("id AS k", "0L AS at", "'x' AS v")
    U.upsert(rows, path, ["k"], newest(), 8)

    def files():
        return {os.path.join(r, f) for r, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}

    before = files()
    U.upsert(spark.createDataFrame([(5, 1, "y")], ROW), path, ["k"], newest(), 8)
    assert len(files() - before) == 1 and not before - files()  # the version before stays readable
    assert U.read_table(spark, path).count() == 200
    assert U.read_table(spark, path).filter("k = 5").first()["v"] == "y"


def test_upsert_lost_half_way(spark, tmp_path, monkeypatch):
    """A job that stops before the pointer is written leaves the old rows, and running it again gives the new ones."""
    path = str(tmp_path / "t")
    U.upsert(spark.range(100).selectExpr("id AS k", "0L AS at", "'x' AS v"), path, ["k"], newest(), 4)
    more = spark.range(50, 150).selectExpr("id AS k", "1L AS at", "'y' AS v")

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(U, "_point", stop)
        with pytest.raises(KeyboardInterrupt):
            U.upsert(more, path, ["k"], newest(), 4)
    assert U.read_table(spark, path).filter("v = 'x'").count() == U.read_table(spark, path).count() == 100
    U.upsert(more, path, ["k"], newest(), 4)
    assert U.read_table(spark, path).groupBy("v").count().orderBy("v").collect() == [("x", 50), ("y", 100)]
    version = U.current(spark, path)
    with pytest.raises(RuntimeError):
        U._point(spark, path, version)


def test_another_bucket_count_keeps_keys_apart(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(100).selectExpr("id AS k", "0L AS at", "'x' AS v")
    for buckets in (8, 64, 3):
        U.upsert(rows, path, ["k"], newest(), buckets)
        assert U.read_table(spark, path).count() == 100 and U.current(spark, path).buckets == buckets
    for _ in range(3):
        U.upsert(rows, path, ["k"], newest(), 3)
    assert len(os.listdir(f"{path}/data")) == 2  # older copies are gone


def test_last_wins_limits_before_the_shuffle(spark, plan):
    rows = spark.range(100).selectExpr("id % 3 AS k", "id AS at", "'x' AS v")
    assert "WindowGroupLimit" in plan(U.last_wins(rows, ["k"], newest()))


def test_bronze_by_run_and_date(spark, tmp_path, plan):
    layers = Layers(str(tmp_path / "lake"), buckets=2)
    rows = spark.createDataFrame(
        [("r1", "h1", "{}", "m", "p", "v", None, "2026-01-01"), ("r2", "h2", "{}", "m", "p", "v", None, "2026-01-02")],
        "pipeline_run_id string, source_file_hash string, raw_response string, model_name string, model_provider string, "
        "prompt_version string, ingested_at timestamp, ingest_date string",
    ).withColumn("ingest_date", F.to_date("ingest_date"))
    assert layers.append_bronze(rows.limit(0)) == 0 and layers.read_bronze(spark).count() == 0
    assert layers.append_bronze(rows) == 2
    assert layers.append_bronze(rows.filter("pipeline_run_id = 'r1'")) == 1
    assert layers.read_bronze(spark, "r1").count() == 2
    dated = layers.read_bronze(spark, first_date="2026-01-02", last_date="2026-01-02")
    assert dated.count() == 1
    text = plan(dated)
    assert "PartitionFilters: [isnotnull(ingest_date" in text


@pytest.fixture(scope="module")
def run_inputs(spark, small):
    captures = settle(X.captures(spark, small).filter("ingest_date < '1996-01-01'"))
    return captures, settle(X.products(spark, small))


def lines_of(layers, spark, name):
    rows = layers.read(spark, name)
    return content(rows.drop("processed_at", "matched_at", "pipeline_run_id"))


def test_run_replay_and_backfill(spark, tmp_path, run_inputs):
    captures, products = run_inputs
    layers = Layers(str(tmp_path / "lake"), buckets=4)
    twice = captures.unionByName(captures)  # the same files captured twice
    metrics = pipeline.run(spark, twice, products, layers, "sched:2026-01-01T00.00+00").first()
    assert metrics["pipeline_run_id"] == "sched2026-01-01T000000"
    assert metrics["bronze_rows"] == 2 * captures.count() and metrics["status"] == "success"
    silver, gold = lines_of(layers, spark, "silver"), lines_of(layers, spark, "gold")
    ids = layers.read(spark, "silver").select("line_id")
    assert ids.count() == ids.distinct().count() == len(gold)
    assert metrics["silver_rows"] + metrics["quarantine_rows"] == 2 * (
        len(silver) + pipeline.quarantine_view(layers.read(spark, "quarantine")).count()
    )
    assert set(metrics["stage_durations_sec"]) == {"bronze", "normalize", "silver", "match", "gold", "load"}
    assert sum(metrics["validation_failures"].values()) == metrics["quarantine_rows"]
    served = layers.read(spark, "serving")
    assert served.count() == len(gold)
    assert layers.read(spark, "serving_metrics").first()["validation_failures"].startswith("{")
    # a replay rebuilds the same rows and adds no captures
    pipeline.replay(spark, products, layers)
    assert (lines_of(layers, spark, "silver"), lines_of(layers, spark, "gold")) == (silver, gold)
    assert spark.read.parquet(layers.bronze).count() == 2 * captures.count()
    layers.register(spark, "lake")
    assert spark.table("lake.gold").count() == len(gold)
    assert spark.table("lake.bronze").count() == 2 * captures.count()
    # a fresh root filled window by window ends with the same rows
    other = Layers(str(tmp_path / "other"), buckets=4)
    other.append_bronze(captures)
    for first, last in (("1995-07-01", "1995-12-31"), ("1995-01-01", "1995-06-30"), ("1995-05-01", "1995-08-01")):
        pipeline.replay(spark, products, other, first, last)
    assert (lines_of(other, spark, "silver"), lines_of(other, spark, "gold")) == (silver, gold)


def test_broken_run_leaves_a_status(spark, tmp_path, run_inputs):
    captures, products = run_inputs
    layers = Layers(str(tmp_path / "lake"), buckets=2)
    with pytest.raises(Exception):
        pipeline.run(spark, captures, products.drop("signature"), layers, "r")
    row = spark.read.parquet(layers.metrics).first()
    assert (row["status"], row["pipeline_run_id"]) == ("match_failed", "r")
    assert layers.read(spark, "serving_metrics").first()["status"] == "match_failed"


def test_stream_of_captures(spark, tmp_path, run_inputs):
    captures, products = run_inputs
    layers, batches = Layers(str(tmp_path / "lake"), buckets=2), []

    def go():
        ingest.refine_new_captures(
            spark, layers, products, str(tmp_path / "cp"), after=batches.append
        ).awaitTermination()

    layers.append_bronze(captures.filter("ingest_date < '1995-04-01'"))
    go()
    first = layers.read(spark, "silver").count()
    go()
    assert layers.read(spark, "silver").count() == first and len(batches) == 1
    layers.append_bronze(captures.filter("ingest_date >= '1995-04-01'"))
    go()
    assert len(batches) == 2 and layers.read(spark, "silver").count() > first


def test_batch_that_runs_twice(spark, tmp_path, run_inputs):
    """A micro-batch that fails after its appends is run again and leaves what one run leaves; so does a batch of metrics."""
    captures, products = run_inputs
    layers, calls = Layers(str(tmp_path / "lake"), buckets=2), []

    def fail_once(number):
        calls.append(number)
        if len(calls) == 1:
            raise RuntimeError("lost")

    layers.append_bronze(captures)
    go = lambda: ingest.refine_new_captures(spark, layers, products, str(tmp_path / "cp"), after=fail_once).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        go()
    first = sorted(map(str, layers.read(spark, "quarantine").drop("processed_at").collect()))
    go()
    assert calls == [0, 0] and len(first) > 0
    assert sorted(map(str, layers.read(spark, "quarantine").drop("processed_at").collect())) == first
    rows = spark.createDataFrame([("r", 1)], "pipeline_run_id string, bronze_rows int")
    for batch, n in (("a", 1), ("a", 1), ("b", 2)):
        layers.append_metrics(rows, batch)
        assert spark.read.parquet(layers.metrics).count() == n


def test_landing_files(spark, tmp_path):
    folder = tmp_path / "in"
    assert landing.scan(spark, str(folder)).count() == 0
    folder.mkdir()
    for name, data in (("a.png", b"1"), ("b.JPG", b"22"), ("c.txt", b"333"), ("d.webp", b"1")):
        (folder / name).write_bytes(data)
    rows = landing.lineage(landing.scan(spark, str(folder)), "r").orderBy("source_path").collect()
    assert [(os.path.basename(r["source_path"]), r["media_type"], r["size_bytes"]) for r in rows] == [
        ("a.png", "image/png", 1), ("b.JPG", "image/jpeg", 2), ("d.webp", "image/webp", 1),
    ]
    assert rows[0]["source_file_hash"] == rows[2]["source_file_hash"] != rows[1]["source_file_hash"]
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def go():
        ingest.ingest_new_files(spark, str(folder), out, cp, "r").awaitTermination()
        return spark.read.parquet(out).count()

    assert (go(), go()) == (3, 3)
    (folder / "e.gif").write_bytes(b"5")
    assert go() == 4


def test_stream_takes_every_name(spark, tmp_path):
    folder, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    folder.mkdir()

    def go(*names):
        for name in names:
            (folder / name).write_bytes(name.encode())
        ingest.ingest_new_files(spark, str(folder), out, cp, "r", files_per_batch=1).awaitTermination()
        return sorted(r["source_path"].rsplit("/", 1)[1] for r in spark.read.parquet(out).collect())

    assert go("a.png", "_x.png", "_x.txt", ".z.PNG") == [".z.PNG", "_x.png", "a.png"]
    assert go(".y.png") == [".y.png", ".z.PNG", "_x.png", "a.png"]
    assert go() == [".y.png", ".z.PNG", "_x.png", "a.png"]
    scanned = landing.lineage(landing.scan(spark, str(folder)), "r").collect()
    assert {r["source_file_hash"] for r in scanned} == {r["source_file_hash"] for r in spark.read.parquet(out).collect()}


def test_landing_takes_every_name(spark, tmp_path):
    for name in ("_b.png", ".c.PNG", "d e.png", "_x.txt"):
        (tmp_path / name).write_bytes(name.encode())
    rows = landing.lineage(landing.scan(spark, str(tmp_path)), "r").collect()
    assert sorted(r["size_bytes"] for r in rows) == [6, 6, 7] and len({r["source_file_hash"] for r in rows}) == 3


def test_catalogue_file(spark, tmp_path):
    text = (
        "id,name,price(₹),Is_discontinued,type,pack_size_label,short_composition1,short_composition2\n"
        "1,Augmentin 625 Duo Tablet,223.42,FALSE,x,strip of 10 tablets,Amoxycillin  (500mg) , Clavulanic Acid (125mg)\n"
        "2,Gone,1.0,TRUE,x,p,A (1mg),\n"
        "3,Free,0,FALSE,x,p,A (1mg),\n"
        "4,Odd,N/A,FALSE,x,p,A (1mg),\n"
        "5,None,5,FALSE,x,p,,\n"
        '6,"Moxclav, 625",100,FALSE,x,p,Clavulanic Acid (125mg),Amoxicillin (500 mg)\n'
        '7,"The ""best"" syrup",9,FALSE,x,"a bottle\nof 60 ml",Zinc (10mg),\n'
    )
    (tmp_path / "c.csv").write_text(text, encoding="utf-8")
    items = catalogue.import_products(catalogue.read_csv(spark, str(tmp_path / "c.csv")))
    rows = items.orderBy("pos").collect()
    assert [r["name"] for r in rows] == ["Augmentin 625 Duo Tablet", "Moxclav, 625", 'The "best" syrup']
    assert rows[2]["pack"] == "a bottle\nof 60 ml"
    assert rows[0]["salt"] == "Amoxicillin (500mg) + Clavulanic Acid (125mg)"
    assert rows[0]["salt_keys"] == ["amoxicillin", "clavulanic acid"] and rows[0]["block_key"] == "aug"
    path = str(tmp_path / "catalogue")
    catalogue.store_catalogue(items, path)
    _, groups = catalogue.load_catalogue(spark, path)
    group = groups.orderBy("generic_name").collect()
    assert [(g["generic_name"], g["generic_price"], g["product_count"]) for g in group] == [("Moxclav, 625", 100.0, 2), ('The "best" syrup', 9.0, 1)]


def test_layouts_match_the_writers(spark, small):
    from rxframe.operators.captures import parse_captures

    lines = parse_captures(X.captures(spark, small))
    want = spark.createDataFrame([], schemas.SILVER)
    assert [(f.name, f.dataType) for f in lines.schema] == [(f.name, f.dataType) for f in want.schema]
