"""The operators' queries over whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import band_join, decontaminate, embeddings, html_extract, langid, lm_score, minhash, packing, quality_rules, sharding, token_count, warc, whitening
from .common import id_crc
from .oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_count.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=40)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    folder, manifest = warc.write_archives(pages, revisit_bytes=0)
    back = warc.read_archives(spark, folder, manifest)
    kind = pages.schema["page_id"].dataType
    return back.select(
        F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.find_contamination(docs, benchmark, window=13, percent=5)


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, id_crc() % 4 != 2)
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lm_score.fold_of("doc_id", 10, 0)
    scores = lm_score.score(_table(spark, sf_dir, "documents"), ~held_out, lm_score.fold_of("doc_id", 10, 1))
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors, components=8)
    rows = whitening.whiten(vectors, model, whitening.identity_errors(vectors, model))
    listed = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "c"))
    return listed.select(
        "vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error"
    )


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, _table(spark, sf_dir, "labels"), rows=20_000))


def op13_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_join.band_join(_table(spark, sf_dir, "sale_lines"), _table(spark, sf_dir, "items"), first=10, cents_apart=50, per_mille=5)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_token_count": op2_token_count,
    "op3_sharding": op3_sharding,
    "op4_warc": op4_warc,
    "op5_minhash": op5_minhash,
    "op6_html_text": op6_html_text,
    "op7_decontamination": op7_decontamination,
    "op8_embeddings": op8_embeddings,
    "op9_language_id": op9_language_id,
    "op10_lm_score": op10_lm_score,
    "op11_whitening": op11_whitening,
    "op12_quality_rules": op12_quality_rules,
    "op13_band_join": op13_band_join,
}


__all__ = ["ORACLES", "QUERIES"]
