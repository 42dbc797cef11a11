"""A training-data pipeline over `documents`: language ID, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns the columns
of documents; the last returns the packed sequences (bin_id, doc_ids, starts, lengths, used).

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra columns of any name: those are
kept by all but the last. What a stage does with them is in its docstring, in detail in that of the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisift.llm import jaccard_join, language_id, line_dedup, mixing, packing
from lexisift.llm.common import col, fresh_dir, remove, spare, table


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: null and empty texts, texts without an n-gram, and those in none of the languages of `lang`.

    The others stay as they are, null ids and repeated rows too. Without any label only texts without an n-gram go.
    """
    return language_id.filter_language(docs)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go, and documents of which no line is left; n_chars, if there is one, follows the text.

    Null and empty texts and null ids stay as they are; repeated rows are treated alike.
    """
    out = line_dedup.dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return out
    n = F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id stays, with all its repeated rows; null ids and texts without a word stay."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their tempered proportions, without repeats: the largest mix that all sources can give. A null source is one of its own."""
    clash = [c for c in docs.columns if c.lower() in ("shard", "position")]  # what the operator's columns are called
    away = dict(zip(clash, spare(docs, *clash)))
    return mixing.mix(docs.withColumnsRenamed(away)).select(*[col(away.get(c, c)).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each sequence of CAPACITY words; null and empty texts are in none, longer ones are cut, null ids and repeated rows are pieces like others."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_languages),
    ("line dedup", delete_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Bayes classification, hypergeometric draws and greedy packing have no SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written to the shared folder and read again, and deleted when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        out = fresh_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return STAGES[-1][1](spark, docs, sf_dir)
