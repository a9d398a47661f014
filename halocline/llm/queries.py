"""The training-data queries: one opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cotraining, html_main_text, jpeg_media, ngram_join, orc_tokens, packing, ppm_langid, source_schedule, warc, weak_supervision
from .common import scratch_path

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file on this machine; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, placed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, sf_dir, "documents"))


def op3_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg_media.digests(jpeg_media.store_media(table(spark, sf_dir, "documents")))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orc")
    orc_tokens.write_orc(table(spark, sf_dir, "documents"), path, vocabulary(WORD_BPE))
    return orc_tokens.digests(orc_tokens.read_orc(spark, path))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(table(spark, sf_dir, "pages")).where("NOT is_gap")
    header = lambda name: F.element_at("headers", name)
    page = lambda name: F.regexp_extract(header(name), "page:(-?[0-9]+)", 1).cast("long")
    return records.select(page("WARC-Record-ID").alias("page_id"), header("X-Payload-Length").cast("long").alias("payload_bytes"), F.substring(header("WARC-Payload-Digest"), 8, 64).alias("payload_digest"), header("WARC-Type").alias("record_type"), F.when(header("WARC-Type") == "revisit", page("WARC-Refers-To")).alias("refers_to"))


def op8_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = weak_supervision.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op9_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_schedule.mix(table(spark, sf_dir, "documents")).drop("source")


def op10_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {f.__name__: f for f in (op1_packing, op2_ngram_jaccard, op3_jpeg_media, op4_html_main_text, op5_cotraining, op6_orc_tokens, op7_warc, op8_weak_supervision, op9_source_schedule, op10_ppm_langid)}
ORACLE_SQL: dict[str, str] = {
    "op7_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        q AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM q)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > least THEN least END AS refers_to
        FROM g""",
}
