"""A corpus pipeline: quality filter, boilerplate lines, near duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() writes each stage's result to the shared folder and reads it back, so a lost
executor costs at most one stage. Extra columns pass through unless their names are the stage's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm.line_dedup import without_boilerplate
from reelgrid.llm.near_dup import near_duplicates
from reelgrid.llm.packing import pack
from reelgrid.llm.quality import classified
from reelgrid.llm.suffixes import without_repeats
from reelgrid.llm.tables import documents, labels, written


def only(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id has a verdict to keep."""
    ids = verdicts.where("kept").select(F.col("doc_id").alias("kept_id")).distinct().hint("merge")
    return docs.join(ids, docs.doc_id.eqNullSafe(F.col("kept_id")), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return only(docs, classified(docs, labels(spark, sf_dir)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand on six sites and in six distinct texts or more."""
    out = without_boilerplate(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return only(docs, near_duplicates(docs, k=5, threshold=80))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 50 bytes that an earlier document has."""
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near), ("repeats", repeats), ("packing", packing)]
#: Trained models and tokens have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
