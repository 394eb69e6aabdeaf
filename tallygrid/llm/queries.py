"""The registered queries of the training-data operators, with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import bpe, decontamination, extraction, language, mixing, ngramjoin, periodic, prefixtrie, quality, repetition, substrings, toxicity, urlfilter
from tallygrid.llm.common import table


def op1_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.link(table(spark, sf_dir, "documents"))


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.judge(table(spark, sf_dir, "documents"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select(*base, "n_span_words", (F.col("longest_repeat") > 50).alias("long_repeat"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"))).drop("evidence")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", urlfilter.stand_in_time(F.col("page_id")).alias("fetched"))
    return urlfilter.judge(captures, urlfilter.entries_frame(spark))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, packed=True, round_trip=True)
    n_tokens = (F.length("ids") / 4).cast("long")
    return coded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.detect(table(spark, sf_dir, "documents"), seed=F.crc32(F.col("doc_id").cast("string"))))


QUERIES = {
    "op1_extraction": op1_extraction,
    "op2_language": op2_language,
    "op3_ngram_join": op3_ngram_join,
    "op4_repetition": op4_repetition,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_url_filters": op7_url_filters,
    "op8_substrings": op8_substrings,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {
    "op3_ngram_join": ngramjoin.ORACLE,
    "op4_repetition": repetition.ORACLE,
    "op7_url_filters": urlfilter.ORACLE,
    "op8_substrings": substrings.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_decontamination": decontamination.ORACLE,
    "op11_prefix_trie": prefixtrie.ORACLE,
}
