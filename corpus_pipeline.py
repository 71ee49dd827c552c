"""A corpus pipeline: quality rules, line dedup, SimHash near-dedup, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents; the last adds copy_no and mix_key.

Defined results: a null or empty text fails the quality rules and goes in the first stage; rows with a null doc_id are
documents of their own, told apart by their text, in every stage; of equal rows one stays (in near_dedup); rows with
one doc_id and differing texts are judged each on its own; a null source is a source; further columns, whatever their
names, are carried through; empty tables of documents, labels or benchmark items give an empty table, the default
line model, and no leaks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import decontaminate, line_dedup, mixing, quality_rules, simhash
from gridspark.llm.common import checkpoint_dir, delete, table, temporary_tables
from gridspark.sources.tables import spread


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    docs = spread(docs)
    model = quality_rules.fit_line_crf(docs, table(spark, sf_dir, "labels"))
    judged = quality_rules.quality_rules(docs, model, carry=docs.columns)
    return judged.where("kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line stays only in the first document that holds it; a document of which nothing is left goes."""
    return line_dedup.line_dedup(docs).where(r"text rlike '[^\\x20\\x09-\\x0D]'")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the one with the smallest doc_id."""
    return simhash.drop_near_copies(spread(docs))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(spread(docs), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated by their sources' target rates and shuffled."""
    return mixing.mix(docs, mixing.source_rates(docs))


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", cut_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written to the shared folder. A stage's own tables and its
    predecessor's result are deleted once it is written; the last result stays, as the caller reads it."""
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return docs


#: The fitted line model and 64-bit fingerprints have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
