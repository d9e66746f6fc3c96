"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm import (licenses, line_dedup, merkle, mixing, packing, pieces, pivot_search,
                             quality, secrets, sharding, simhash, spelling, tokens, vptree_search)
from murmuration.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
SEQUENCE_TOKENS = 1024


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, budget=2)
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"),
                        "component_id")


def packed_documents(docs: DataFrame, keep_ids: bool = False) -> DataFrame:
    """Placed pieces with a digest of their ids, and the ids themselves if asked for."""
    pieces = tokens.tokenize(docs, TOKENIZER, SEQUENCE_TOKENS)
    digests = pieces.withColumn("ids_crc32", F.crc32("ids"))
    return packing.pack(digests if keep_ids else digests.drop("ids"), SEQUENCE_TOKENS)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).drop("copies")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sharding.shard_table(table(spark, sf_dir, "documents"), 16)
            .withColumn("law", F.lit("key")))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, mask_col="mask")
    gone = F.filter(F.transform("mask", lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    return out.select("doc_id", F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce(F.array_join(gone.cast("array<string>"), ","), F.lit(""))
                      .alias("removed_lines"),
                      F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(table(spark, sf_dir, "documents"), PIECE_MODEL, decoded=True)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    fields = [lowered if c == "text" else F.col(c) for c in merkle.FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0,
                      merkle.leaf(fields))
    out = merkle.manifest(docs, carry={"tampered": tampered})
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    return out.select("doc_id", "leaf", "subroot", "root",
                      merkle.siblings_digest(F.col("proof")).alias("proof_sha256"),
                      folded.alias("folded_root")
                      ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_packing, op3_secrets, op4_licenses, op5_topk,
                            op6_quality, op7_mixing, op8_sharding, op9_ann, op10_line_dedup,
                            op11_spelling, op12_pieces, op13_merkle)}
ORACLE: dict[str, str] = {"op3_secrets": secrets.oracle(), "op5_topk": pivot_search.oracle(),
                          "op11_spelling": spelling.oracle(), "op13_merkle": merkle.oracle()}
