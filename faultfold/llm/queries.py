"""The registered queries of the operators: thin digests of their outputs over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultfold.llm import (
    ann,
    bpe,
    lexical,
    licenses,
    mixing,
    multiindex,
    quality,
    sharding,
    simhash,
    substring,
    toxicity,
    warc,
    whitening,
)
from faultfold.sources.tables import read_table


def op1_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    read = warc.warc_round_trip(pages, per_file=100_000)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op3_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(read_table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.byte_bpe(read_table(spark, sf_dir, "documents"))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_rules(read_table(spark, sf_dir, "documents"), with_text=False).drop("lost_share")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_license_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = licenses.files_of(read_table(spark, sf_dir, "documents"))
    return licenses.license_scan(files, "doc_id")


def op8_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.systematic_mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op9_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hash_tree_shards(read_table(spark, sf_dir, "documents"))


def op11_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_bloom_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(read_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_chain,
        op2_hnsw,
        op3_phrase_automata,
        op4_byte_bpe,
        op5_line_quality,
        op6_toxicity,
        op7_license_tfidf,
        op8_systematic_mix,
        op9_simhash_pivots,
        op10_hash_tree,
        op11_feast_whitening,
        op12_bloom_search,
        op13_multi_index,
    )
}
