"""The numbered queries, one per operator, over whole tables; their SQL is in oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn, clustering, decontaminate, licenses, lm, mixing, ngram_join, pii, quality_rules, sharding, urls, warc, whitening
from .common import id_text, materialize, shared_dir, table
from .oracles import SQL  # noqa: F401


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = materialize(docs.select("doc_id", "source", mixing.mix_hash().alias("h"), mixing.n_words().alias("size")), "sizes")
    out = mixing.mix(rows, rows.select("source", "h", "size"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_copies", "n_links")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    out = quality_rules.quality_rules(docs.select("doc_id", "text"), model, keep_text=False)
    return out.select("doc_id", *quality_rules.STATS, "base_failed", "kept", "quality_score")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_chunks(spark, folder, with_payload=False).where("last and record_type <> 'warcinfo'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", sharding.byte_size().alias("size"), sharding.text_crc().alias("text_crc32"))
    out = sharding.interleave(docs, tie=("doc_id", "text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    ids = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest")


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(id_text().cast("binary")) % 5
    net = byte_cnn.train(docs, table(spark, sf_dir, "labels"), only=part != 0)
    out = byte_cnn.cnn_scores(docs.select("doc_id", "text"), net, keep_text=False)
    return out.select("doc_id", (part == 0).alias("held_out"), "score", "predicted")


def op8_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op10_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lm.split()
    out = lm.lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), part != 2)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustering.annulus_clusters(table(spark, sf_dir, "embeddings"), dim=64, k=8, rounds=10)
    stats = [(c, n, sum(found.inertia), digest) for c, (n, digest) in enumerate(zip(found.inertia, found.digests(), strict=True))]
    each = spark.createDataFrame(stats, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(each), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_rows(whitening.whiten(table(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100_000))


#: The places that the query judges, beside the usual patterns.
PLACES = [
    urls.place_rule("allow", "com", "/"), urls.place_rule("block", "example.com", "/en/"), urls.place_rule("allow", "www.example.com", "/en/"),
    urls.place_rule("block", "net", "/es/"), urls.place_rule("block", "net", "/fr/"),
]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.url_verdicts(pages, [*PLACES, *urls.PATTERNS]).select("page_id", "host", "path", "rule", "verdict", "pattern")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_warc": op4_warc,
    "op5_shards": op5_shards,
    "op6_decontamination": op6_decontamination,
    "op7_byte_cnn": op7_byte_cnn,
    "op8_licence_scans": op8_licence_scans,
    "op9_pseudonyms": op9_pseudonyms,
    "op10_log_bilinear_lm": op10_log_bilinear_lm,
    "op11_annulus_clusters": op11_annulus_clusters,
    "op12_whitening": op12_whitening,
    "op13_url_filters": op13_url_filters,
}
