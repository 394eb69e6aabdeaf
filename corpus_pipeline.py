"""From raw documents to a training mix, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns
of documents. Models and lists come from the tables in ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import decontamination, mixing, ngramjoin, quality, substrings
from tallygrid.llm.common import release, scratch_count, settle, table

#: Near copies: five-word shingles, a similarity of 80 percent.
SHINGLE, PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return docs.filter(quality.score_column(model, F.col("text")) >= 0.5)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies; rows of one id stay together."""
    linked = ngramjoin.link(docs, k=SHINGLE, percent=PERCENT)
    gone = linked.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(settle(gone, "pipeline-copies"), "doc_id", "left_anti").select(*docs.columns)


def cut_shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of fifty words or more that an earlier one has.

    A column n_chars, where there is one, counts the characters that are left.
    """
    cut = substrings.rewrite(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to a twentieth of their words."""
    judged = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = judged.filter("contaminated").select(F.col("doc_id").alias("g_id"), F.col("tag").alias("g_tag")).distinct()
    gone = settle(hit, "pipeline-contaminated")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["g_id"]) & (F.xxhash64(docs["text"]) == gone["g_tag"]), "left_anti")


def take_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of their copies.

    Columns of docs named size, source_size, target, copies or taken give way to the mix's.
    """
    return mixing.mix(docs, whole_rows=True).filter(F.col("copies") > 0)


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", keep_one_of_each),
    ("substring_dedup", cut_shared_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", take_mix),
]

#: The classifier can't be written in SQL; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix. A stage's scratch tables, and its input, go when its result is written."""
    docs, began = table(spark, sf_dir, "documents"), scratch_count()
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, began, but=f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
