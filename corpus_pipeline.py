"""From raw documents to packed training sequences: five stages, each a table in the shared folder.

A stage takes (spark, docs, sf_dir) and returns what it kept, with the columns of documents; the last returns pieces of
packed sequences. `run` writes each stage and reads it again, so a lost executor costs work of one stage at most. As a
stage begins, its predecessor's rows have been written: what that one left in the shared folder is removed."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import drop_scratch, table, written
from factloom.llm.decontaminate import decontaminate
from factloom.llm.lines import dedup_lines
from factloom.llm.minhash import one_of_each
from factloom.llm.packing import pack
from factloom.llm.quality_rules import good_documents
from factloom.llm.tokens import word_tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy keeps."""
    drop_scratch(spark, docs)
    return good_documents(docs, "text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; n_chars follows the text. Those that lose their last word go."""
    drop_scratch(spark, docs)
    done = dedup_lines(docs, "doc_id", "text").filter("_n_removed = 0 OR text RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    return done.select(*docs.columns).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    drop_scratch(spark, docs)
    return one_of_each(docs, "doc_id", "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    drop_scratch(spark, docs)
    return decontaminate(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids."""
    drop_scratch(spark, docs)
    return pack(docs, "doc_id", "text", word_tokenizer_path(), with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The stages tokenize, align and link; SQL cannot state them. tests/llm/test_pipeline.py holds each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
