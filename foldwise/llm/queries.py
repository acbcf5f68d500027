"""Registered queries of the training-data operators: each applies its operator to a whole table."""

from __future__ import annotations

import string

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import (ann, byte_bpe, decontaminate, jaccard, langid, lm, merkle, oracle, packing, quality, reversed_search, secret_scan,
               token_count, token_file)
from .common import crc_mod


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_mod(F.col("doc_id"), 5) == 0
    weights = quality.fit(docs, labels.where(~held))
    return quality.score(docs, weights).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_file.scratch_path(spark)
    token_file.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_file.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    joined = lambda kinds: F.array_join(F.transform(
        F.filter("found", lambda s: s["kind"].isin(*kinds)) if kinds else F.col("found"),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[n(k).alias(f"n_{k}") for k in secret_scan.BASE],
                        F.sha2(joined(secret_scan.BASE), 256).alias("base_sha256"), joined(()).alias("spans"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = merkle.leaf_hash([lower if c == "text" else F.col(c) for c in merkle.COLUMNS])
    manifest = merkle.build(docs, carry=F.when(crc_mod(F.col("doc_id"), 5) == 0, tampered))
    proofs = manifest.proofs().withColumn("given", F.coalesce("carried", "leaf"))
    hexed = lambda c: F.lower(F.hex(c))
    return merkle.folded(proofs, "given").select(
        F.col("id").alias("doc_id"), hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), hexed("root").alias("root"),
        F.sha2(hexed("siblings"), 256).alias("proof_sha256"), hexed("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path)
    return texts.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_quality": op2_quality,
    "op3_lm_score": op3_lm_score,
    "op4_permutation_index": op4_permutation_index,
    "op5_decontaminate": op5_decontaminate,
    "op6_language_id": op6_language_id,
    "op7_token_file": op7_token_file,
    "op8_packing": op8_packing,
    "op9_secret_scan": op9_secret_scan,
    "op10_token_count": op10_token_count,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_reversed_search": op12_reversed_search,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op1_jaccard_join": oracle.JACCARD_JOIN_SQL,
    "op11_merkle_manifest": oracle.MERKLE_SQL,
    "op12_reversed_search": oracle.SEARCH_SQL,
}
