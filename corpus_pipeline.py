"""Documents to a training mix: each stage takes (spark, docs, sf_dir) and its result is written and read again for the next.

Cases, for all stages: null and empty texts are documents like others (never toxic by a word, a copy or a leak; size 0 in the mix); rows with a null doc_id stay;
doc_id names a document, so where rows share one, a stage that rejects one of them rejects all; equal rows get equal decisions; columns that stages use for
themselves (kept, score, ...) may stand in the input and come out as they were; empty tables give empty tables. SQL cannot express the stages that learn or
sample signatures, so there is no SQL for the whole; the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.llm.common import Tables, broadcast_if_small
from wayfind.llm.decontaminate import find_leaks
from wayfind.llm.line_dedup import dedup_lines
from wayfind.llm.mixing import mix_sources
from wayfind.llm.near_dedup import near_dedup
from wayfind.llm.toxicity import rejected, score_toxicity


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    return docs.join(broadcast_if_small(gone.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more go. Without labels, all stay."""
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    gone = Tables(spark, "rejected").write(scored.where(rejected(F.col("score")) == 1).select("doc_id"), "toxic")
    return _without(docs, gone)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go. A document that would lose its last word keeps its text: of such copies, the next stage leaves one."""
    out = dedup_lines(docs)
    text = F.when((F.col("n_dropped") > 0) & F.col("kept").rlike("[^\\x20\\x09-\\x0D]"), F.col("kept")).otherwise(F.col("text"))
    return out.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity of 0.8)."""
    found = near_dedup(docs.select("doc_id", "text"), shingle=5, percent=80)
    gone = Tables(spark, "rejected").write(found.where("not kept").select("doc_id"), "copies")
    return _without(docs, gone)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, Tables(spark, "rejected").write(leaks.select("doc_id"), "leaks"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each document, its words, its source's words and target, and how many of its words the mix takes (repeats counted)."""
    return mix_sources(docs).taken()


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("minhash_near_dedup", near), ("decontamination", decontamination), ("mixing", mixing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), name)
        if before:
            tables.drop(before)
        before = name
    return docs
