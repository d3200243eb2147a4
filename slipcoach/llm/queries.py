"""The queries over the text tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slipcoach.llm import blocknames, brown, crosstok, jaccard, langid, licenses, mixing, oracles, prefixtrie, quality, sharding, tiling, urlrules, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.score(table(spark, sf_dir, "documents")).select(names)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.manifest(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op5_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs = langid.languages(docs)
    return langid.identify(table(spark, sf_dir, "pages"), langid.fit(docs, langs=langs), langs=langs)


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_brown_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), urlrules.rule_table(spark))


def op9_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.cluster(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.rebuilt_nodes(table(spark, sf_dir, "conversations"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.align(table(spark, sf_dir, "documents"))


def op13_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocknames.classes(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_quality_divergence": op2_quality_divergence,
    "op3_license_scan": op3_license_scan,
    "op4_rendezvous_sharding": op4_rendezvous_sharding,
    "op5_language_evidence": op5_language_evidence,
    "op6_warc_index": op6_warc_index,
    "op7_brown_scoring": op7_brown_scoring,
    "op8_url_rules": op8_url_rules,
    "op9_benchmark_tiling": op9_benchmark_tiling,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_token_alignment": op12_token_alignment,
    "op13_block_names": op13_block_names,
}
ORACLE = {
    "op1_source_mixing": oracles.MIXING,
    "op2_quality_divergence": oracles.QUALITY,
    "op3_license_scan": oracles.LICENSES,
    "op4_rendezvous_sharding": oracles.SHARDING,
    "op6_warc_index": oracles.WARC,
    "op8_url_rules": oracles.URL_RULES,
    "op10_ngram_jaccard_join": oracles.JACCARD,
    "op11_prefix_trie": oracles.PREFIX_TRIE,
    "op13_block_names": oracles.BLOCK_NAMES,
}
