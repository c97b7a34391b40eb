"""Mixing, packing, the archive writer, the classifier, the registered queries and the pipeline."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from checks import compare
from rxframe.llm import exact_dedup, mixing, packing, quality, queries, warc
from rxframe.llm.oracle import ORACLE
from rxframe.session import scratch_root
from tests.llm import plain


def test_mix_meets_targets(documents, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_PART", 7)
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randrange(1, 30)), s) for i, s in enumerate(["b"] * 300 + ["a"] * 20 + ["é"] * 40 + [None] * 60 + ["z"] * 3)]
    rows += [(1000, None, "a"), (1001, " ", "empty"), (None, "one two", "a")]
    found = mixing.mix(mixing.numbered(mixing.sizes(documents(rows)))).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets, taken = plain.fill(sizes), {}
    assert len(found) == len(rows)
    for x in found:
        assert x.size == len(next(t or "" for i, t, s in rows if i == x.doc_id).split())
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(targets[x.source])
        assert x.size == 0 == x.taken or x.taken % x.size == 0 and x.taken <= 3 * x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(abs(taken[s] - targets[s]) <= 30 for s in sizes) and sum(taken.values()) <= sum(sizes.values())
    again = mixing.mix(mixing.numbered(mixing.sizes(documents(rows[::-1])))).collect()
    assert {(x.doc_id, x.taken) for x in found} == {(x.doc_id, x.taken) for x in again}


def test_mixed_stream_is_fair_at_every_point(documents):
    rows = [(i, "a b c", f"s{i % 3}") for i in range(900)]
    stream = mixing.schedule(mixing.numbered(mixing.sizes(documents(rows)))).orderBy("start").collect()
    assert [x.start for x in stream] == list(range(0, 3 * len(stream), 3))
    assert [x.finish for x in stream] == sorted(x.finish for x in stream)
    shares = plain.fill({f"s{k}": 900 for k in range(3)})
    for n in (100, 450, 899):
        for s, t in shares.items():
            assert abs(sum(x.source == s for x in stream[:n]) - n * t / 2700) <= 2
    table = mixing.apply(documents(rows))
    assert table.columns == documents(rows).columns and table.count() == len(stream)
    assert mixing.apply(documents([])).count() == 0


def test_ids_equal_the_tokenizer(documents):
    odd = [
        "", None, " ", "It's I'LL don'T <|endoftext|>x <|startoftext|> a", "naïve ÀÉÎ ß ẞ İI ſs Σας ΟΔΟΣ", "tab\tx\x0bvt\x1cfs\x85nel\xa0nb",
        "x_y __ 1a2b ½ ² ٣ a1_2'sé", "日本語 テキスト 🤦🏼‍♂️", "é ́x", "a" * 3000, "<| endoftext |>", "¡hola! ¿qué?", "one two " * 9000,
    ]
    t = Tokenizer.from_file(packing.default_tokenizer())
    expected = {}
    for i, x in enumerate(odd):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        expected |= {(i, k): (s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))}
    found = packing.pieces(documents(list(enumerate(odd)))).collect()
    assert {(x.doc_id, x.piece): (x.start, x.length, x.ids_crc32) for x in found} == expected


def test_runs_equal_best_fit_one_by_one():
    r = random.Random(2)
    for capacity in (1, 7, 64, 100):
        for _ in range(25):
            lengths = [r.randrange(1, capacity + 1) for _ in range(r.randrange(0, 120))]
            lengths += [r.randrange(1, capacity + 1)] * r.randrange(0, 60)
            counts = {n: lengths.count(n) for n in set(lengths)}
            runs, sequences = packing.best_fit(counts, capacity)
            assert sequences == plain.best_fit_count(lengths, capacity) and len(runs) <= 24 * capacity + len(counts)
            inside = {}
            for length, rank, n, first, each, offset in runs.tolist():
                for k in range(n):
                    inside.setdefault(first + k // each, []).append((offset + k % each * length, length))
            assert sum(map(len, inside.values())) == len(lengths) and len(inside) == sequences
            for own in inside.values():
                own.sort()
                assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
                assert sum(n for _, n in own) <= capacity


def test_packed_sequences_hold_every_piece(documents, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_PART", 5)
    r = random.Random(6)
    rows = [(i, " ".join(["word"] * r.randrange(0, 90))) for i in range(150)] + [(None, "x"), (7, "twice"), (7, "twice"), (8, None)]
    found = packing.pack(documents(rows), capacity=64).collect()
    ends = {}
    for x in sorted(found, key=lambda x: (x.sequence_id, x.offset)):
        assert x.offset == ends.get(x.sequence_id, 0)
        ends[x.sequence_id] = x.offset + x.length
    lengths = [min(64, n - s) for _, t in rows for n in [len((t or "").split()) + 1] for s in range(0, n, 64)]
    assert sorted(x.length for x in found) == sorted(lengths) and len(ends) == plain.best_fit_count(lengths, 64)
    whole = packing.sequences(documents(rows), capacity=64).collect()
    assert sum(len(x.ids) for x in whole) == sum(lengths) and all(len(x.ids) <= 64 for x in whole) and len(whole) == len(ends)
    assert packing.pack(documents([])).count() == 0


def expected_records(rows):
    first, out = {}, {}
    for page, _, html in sorted(rows, key=lambda x: x[0]):
        payload = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        kind = ("revisit", first[digest]) if digest in first else ("response", None)
        first.setdefault(digest, page)
        out[page] = (len(payload), digest, *kind)
    return out


def test_archives_round_trip(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, f"http://x/{i}", r.choice(["same", "", None, f"<p>é{i}</p>" * 50, "x" * 200_000 if i == 5 else "y"])) for i in range(200)]
    rows += [(2**60 + 1, "http://a b\r\nc", "far"), (2**60 + 2, None, "far\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*x, "z") for x in rows], "page_id long, url string, html string, payload string").repartition(5)
    roots = [f"file://{tmp_path}/{n}" for n in "ab"]
    manifests = [warc.write(p, root, shard_bytes=5_000, roll_bytes=2_000).collect() for p, root in zip([pages, pages.orderBy("html")], roots, strict=True)]
    assert sorted(manifests[0]) == sorted(manifests[1]) and len(manifests[0]) > 8 and len({x.shard for x in manifests[0]}) > 3
    for x in manifests[0]:
        data = (tmp_path / "a" / x.name).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (x.bytes, x.sha256)
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert not (tmp_path / "a" / "_temporary").exists()
    found = warc.read(spark, roots[0], with_payload=True).collect()
    assert {x.page_id: (x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in found} == expected_records(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(x.payload) == html[x.page_id] for x in found if x.record_type == "response")
    ids = {x.page_id: x.record_id for x in found}
    assert all(x.refers_to_record == ids[x.refers_to] for x in found if x.record_type == "revisit")
    assert {x.url for x in found if x.page_id > 2**60} == {"http://a%20b%0D%0Ac", "about:blank"}


def test_archives_odd_tables(spark, tmp_path):
    rows = [(None, "u", "a"), (None, "v", "a"), (3, "w", "a"), (4, "w", "b"), (4, "w", "b"), (None, "u", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, f"{tmp_path}/n", shard_bytes=1)
    found = warc.read(spark, f"{tmp_path}/n").collect()
    assert sorted((str(x.page_id), x.record_type, x.refers_to) for x in found) == [
        ("3", "response", None), ("4", "response", None), ("4", "revisit", 4), ("None", "response", None), ("None", "revisit", 3), ("None", "revisit", 3)
    ]
    small = warc.records(pages, revisit_bytes=2).filter("revisit")
    assert small.count() == 0
    warc.write(pages.limit(0), f"{tmp_path}/e")
    assert warc.read(spark, f"{tmp_path}/e").count() == 0


def test_commit_can_be_repeated(spark, tmp_path):
    """A commit that stopped half-way goes on, and files of lost attempts are not read."""
    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    root = f"{tmp_path}/w"
    warc.write(pages, root)
    rows = [(x.shard, x.part, x.name, "_temporary/gone", x.bytes, x.records, x.sha256) for x in spark.read.parquet(f"{root}/manifest").collect()]
    (tmp_path / "w" / "pages-000009-0000.warc.gz").write_bytes(b"left behind")
    warc.commit(spark.createDataFrame(rows, warc.WRITTEN), root)
    assert warc.read(spark, root).count() == 2


def test_classifier_on_held_out_labels(given, spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, labels)
    found = {x.doc_id: x for x in quality.score(docs, model).collect()}
    known = [(x.quality, found[x.doc_id]) for x in labels.collect()]
    share = sum(q for q, x in known if not x.held_out) / sum(not x.held_out for _, x in known)
    assert abs(model.prior - share) < 0.08
    test = [(q, x) for q, x in known if x.held_out]
    assert sum(q == x.predicted for q, x in test) >= 0.95 * len(test)
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and x.predicted == (x.score >= 0.5) for i, x in found.items())
    flipped = labels.withColumn("quality", warc.F.when(quality.held_out(warc.F.col("doc_id")), 1 - warc.F.col("quality")).otherwise(warc.F.col("quality")))
    again = {x.doc_id: x.score for x in quality.score(docs, quality.fit(docs.repartition(7), flipped)).collect()}
    assert all(abs(found[i].score - s) < 1e-9 for i, s in again.items())
    left = quality.accepted(docs, model)
    assert {x.doc_id for x in left.collect()} == {i for i, x in found.items() if x.predicted} and left.columns == docs.columns


def test_classifier_odd_rows(spark, documents):
    docs = documents([(1, None), (2, ""), (None, "x y"), (3, "a" * 100_000), (3, "a")])
    labels = spark.createDataFrame([(2, 1, None), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    for model in (quality.fit(docs, labels), quality.fit(docs, labels.limit(0))):
        found = quality.score(docs, model).collect()
        assert len(found) == 5 and all(0 <= x.score <= 1 for x in found)
    assert quality.fit(docs.limit(0), labels) is None and quality.score(docs.limit(0), None).count() == 0
    assert quality.accepted(docs, None).count() == 5
    clashing = docs.selectExpr("*", "upper(text) AS _scored_text", "1 AS score", "2 AS held_out")
    kept = quality.accepted(clashing, lambda x: x[:, 0] * 0 + 1)
    assert kept.columns == clashing.columns and {x._scored_text for x in kept.collect()} == {None, "", "X Y", "A" * 100_000, "A"}


def test_missing_columns_are_errors(spark):
    docs = spark.createDataFrame([(1, "a")], "DOC_ID long, body string")
    assert exact_dedup.dedup(docs, text="body").count() == 1
    for run in (exact_dedup.dedup, packing.pack, lambda d: mixing.mix(mixing.sizes(d)), lambda d: quality.score(d, None)):
        with pytest.raises(ValueError, match="columns are named"):
            run(docs)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, small, name):
    _, found = compare.differences(spark, compare.connect(small), small, name)
    assert not found


def test_every_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and {*queries.QUERIES, "pipeline"} <= set(contract.queries())


def test_pipeline(spark, small, given):
    docs, at = given("documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        docs.write.parquet(path := f"{scratch_root(spark)}/p")
        docs = spark.read.parquet(path)
        at.append({"name": name, "rows": docs.collect()})
        assert name == "best-fit packing" or docs.columns == given("documents").columns
    every = {x.doc_id: x for x in given("documents").collect()}
    model = quality.fit(given("documents"), given("labels"))
    good = {x.doc_id for x in quality.score(given("documents"), model).collect() if x.predicted}
    assert {x.doc_id for x in at[0]["rows"]} == good
    exact = plain.exact_groups([(i, every[i].text) for i in good])
    one = {i for i, (k, _) in exact.items() if i == k}
    assert {x.doc_id for x in at[1]["rows"]} == one
    _, near = plain.near_components({i: every[i].text for i in one}, 5, 80)
    apart = {i for i, c in near.items() if i == c}
    assert {x.doc_id for x in at[2]["rows"]} == apart
    words = {i: len(plain.WORDS.findall(every[i].text)) for i in apart}
    sizes, taken = {}, {}
    for i, n in words.items():
        sizes[every[i].source] = sizes.get(every[i].source, 0) + n
    for x in at[3]["rows"]:
        taken[x.source] = taken.get(x.source, 0) + words[x.doc_id]
    targets = plain.fill(sizes)
    assert all(abs(taken.get(s, 0) - t) <= max(words.values()) for s, t in targets.items())
    t = Tokenizer.from_file(packing.default_tokenizer())
    lengths = [len(t.encode(x.text, add_special_tokens=False).ids) + 1 for x in at[3]["rows"]]
    pieces = [min(4096, n - s) for n in lengths for s in range(0, n, 4096)]
    assert sorted(x.length for x in at[4]["rows"]) == sorted(pieces)
    assert len({x.sequence_id for x in at[4]["rows"]}) == plain.best_fit_count(pieces, 4096)
    assert corpus_pipeline.run(spark, small).count() == len(pieces) and exact_dedup.ADDED
