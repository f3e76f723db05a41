"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed, langid, minhash, mixing, multihash, oracles, packing, substring, tokcount, tokenbin, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(warc.records_of(_table(spark, sf_dir, "pages")))
    return found.withColumn("headers", warc.listed(F.col("headers")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), max_repeats=4)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=5, num=85, den=100)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicated(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenbin.exported(_table(spark, sf_dir, "documents"), bpe.public_path("byte_bpe_50k.json"), end=2)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokcount.prefix_counts(_table(spark, sf_dir, "documents"), bpe.public_path("byte_bpe_50k.json"), limit=512, keep=False)
    return found.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multihash.fingerprints(_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed(_table(spark, sf_dir, "documents"), bpe.public_path("byte_bpe_50k.json"), end=1, with_ids=False)
    return found.drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_mixing": op2_mixing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_binary": op5_token_binary,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_document_fingerprints": op8_document_fingerprints,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op1_warc_revisits": warc.SQL,
    "op2_mixing": mixing.SQL,
    "op3_minhash_near_dedup": oracles.NEAR_DOCUMENTS,
    "op4_substring_dedup": oracles.REPEATED_WORDS,
    "op9_embedding_near_dedup": oracles.NEAR_VECTORS,
}
