"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trisettle.llm import bytebpe, clustering, decontaminate, eliasfano, jaccard, language, lexical, neighbours, pii, quality, secrets, sharding, suffixes
from trisettle.llm.common import table


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(table(spark, sf_dir, "documents"))


def op4_elias_fano_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eliasfano.boundaries(eliasfano.write(table(spark, sf_dir, "documents")))


def op6_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.find(table(spark, sf_dir, "documents")))


def op5_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find(table(spark, sf_dir, "documents")))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", language.held_out().alias("held_out"), "text")
    return language.predict(rows, language.fold_model(docs), "doc_id", "held_out")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_combination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_elkan_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(table(spark, sf_dir, "embeddings"))


def op12_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"))


def op13_max_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op9_suffix_dedup": op9_suffix_dedup,
    "op2_token_combination_join": op2_token_combination_join,
    "op1_template_decontamination": op1_template_decontamination,
    "op3_language_mixture": op3_language_mixture,
    "op5_boosted_candidates": op5_boosted_candidates,
    "op8_randomness_battery": op8_randomness_battery,
    "op6_risk_controlled_rules": op6_risk_controlled_rules,
    "op4_elias_fano_ids": op4_elias_fano_ids,
    "op7_byte_bpe": op7_byte_bpe,
    "op10_rendezvous_sharding": op10_rendezvous_sharding,
    "op11_elkan_clustering": op11_elkan_clustering,
    "op12_graph_neighbours": op12_graph_neighbours,
    "op13_max_tree_search": op13_max_tree_search,
}
ORACLE_SQL = {"op11_elkan_clustering": clustering.oracle(), "op13_max_tree_search": lexical.oracle()}
