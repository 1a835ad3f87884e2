"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, fim, html_text, itq, jaccard, langid, mixing, pieces, postings, quality, secrets, sharding, structure
from .common import table


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return postings.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return structure.digest(turns, structure.repair_structure(structure.damaged(turns)))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_mixing": op2_mixing,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_quality_rules": op5_quality_rules,
        "op6_sharding": op6_sharding,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_html_extraction": op8_html_extraction,
        "op9_secret_scan": op9_secret_scan,
        "op10_language_id": op10_language_id,
        "op11_nearest_neighbours": op11_nearest_neighbours,
        "op12_structure_repair": op12_structure_repair,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": mixing.mix_oracle(),
        "op3_jaccard_join": jaccard.jaccard_oracle(),
        "op4_embedding_dedup": itq.near_duplicates_oracle(),
        "op5_quality_rules": quality.quality_oracle(),
        "op6_sharding": sharding.shard_oracle(),
        "op7_chat_formatting": chat.format_oracle(),
        "op12_structure_repair": structure.structure_oracle(),
        "op13_fill_in_middle": fim.fill_oracle(),
    }
