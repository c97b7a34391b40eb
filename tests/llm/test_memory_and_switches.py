"""One Python step for byte pairs and back; vector labels of every size go through the passes."""

import numpy as np

from rxframe.llm import byte_pairs, embedding_dedup, queries


def test_round_trip_is_one_python_step(spark, tmp_path):
    texts = [None, "", "a", "x" * 9000, "caf\u00e9  one\ntwo 12345", "word " * 70_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    two = sorted(map(tuple, byte_pairs.decode(byte_pairs.encode(docs)).collect()))
    one = sorted(map(tuple, byte_pairs.round_trip(docs).collect()))
    assert one == two and [r[2] for r in one] == [(t or "").encode() for t in texts]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plan = queries.op12_byte_bpe(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_labels_of_every_size_are_planned(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1003, 16))
    x[500:520] = x[:20] + 0.02 * rng.standard_normal((20, 16))
    label = [0] * 900 + [1] * 100 + [2, 2, 3]
    rows = [(i, label[i], v) for i, v in enumerate(x.tolist())]
    table = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    known = embedding_dedup.classes(table, "vec_id", "embedding", "label")
    plans = embedding_dedup.planned(known, 0.93, 16, 64).collect()
    assert len(plans) == 4 and all(p.passes is not None for p in plans)
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(table).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    same = np.equal.outer(np.array(label), np.array(label))
    links = ((u @ u.T >= 0.93) & same).sum(1) - 1
    assert [found[i] for i in range(len(x))] == links.tolist() and links.sum() >= 40
