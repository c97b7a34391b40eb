"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxframe.llm import byte_pairs, embedding_dedup, exact_dedup, hard_negatives, licenses, line_dedup, mixing, near_dedup, packing, quality, quotations, turn_repair, warc
from rxframe.llm.common import lean, table
from rxframe.session import scratch_root, settle


def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = table(lean(spark), d, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, d, "labels")))


def op2_quotation_linking(spark: SparkSession, d: str) -> DataFrame:
    return quotations.conversations(table(lean(spark), d, "conversations"))


def op3_license_scan(spark: SparkSession, d: str) -> DataFrame:
    found = licenses.scan(table(lean(spark), d, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text_digest", F.array_join("licenses", ",").alias("licenses"), F.array_join("notices", ",").alias("notices"))


def op4_mixing(spark: SparkSession, d: str) -> DataFrame:
    sized = mixing.numbered(mixing.sizes(table(lean(spark), d, "documents")))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op5_minhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.near_duplicates(table(lean(spark), d, "documents"), width=3, percent=85)


def op6_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(lean(spark), d, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op7_warc(spark: SparkSession, d: str) -> DataFrame:
    root = f"{scratch_root(lean(spark))}/warc"
    warc.write(table(spark, d, "pages"), root)
    return warc.read(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = line_dedup.dedup(table(lean(spark), d, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_deleted", F.sha2("clean_text", 256).alias("clean_sha256"))


def op9_embedding_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(lean(spark), d, "embeddings"))


def op10_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(lean(spark), d, "documents")
    slim = settle(exact_dedup.fingerprints(docs).select("doc_id", "text_sha256", "text_length"), "fingerprints")
    return exact_dedup.mark(slim).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_turn_repair(spark: SparkSession, d: str) -> DataFrame:
    return turn_repair.repair_damaged(table(lean(spark), d, "conversations"))


def op12_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    coded = byte_pairs.round_trip(table(lean(spark), d, "documents"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(lean(spark), d, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.prepared(vectors, label=label))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_quotation_linking": op2_quotation_linking,
    "op3_license_scan": op3_license_scan,
    "op4_mixing": op4_mixing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_warc": op7_warc,
    "op8_line_dedup": op8_line_dedup,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_turn_repair": op11_turn_repair,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_hard_negatives": op13_hard_negatives,
}
