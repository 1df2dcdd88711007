"""A cleaning and packing pipeline over the table ``documents``, stage by stage.

Every stage is written as Parquet in the shared folder and read again as the
next one's documents. All but the last return the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexfold.llm.common import written
from codexfold.llm.decontaminate import contained_items
from codexfold.llm.jaccard_forest import jaccard_components
from codexfold.llm.packing import best_fit_packing
from codexfold.llm.pii import pseudonymised
from codexfold.llm.toxicity import accepted


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text is scored toxic; every row is judged by its own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return accepted(docs, labels).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that with the smallest doc_id.

    Rows that share an id stay or go together; of those that stay and have the same
    text, one does. Rows without words are in no group and stay, as do rows without an
    id, which no result can name.
    """
    named = docs.where("doc_id is not null").select("doc_id", "text")
    found = jaccard_components(named).where("n_shingles > 0")
    first = (F.col("doc_id") == F.col("component_id")).cast("int")
    by_id = found.groupBy("doc_id").agg(F.max(first).alias("kept"), F.count("*").alias("rows"))
    by_id = written(by_id.where("kept = 0 or rows > 1"))
    rest = docs.join(by_id.select("doc_id"), "doc_id", "left_anti")
    again = docs.join(by_id.where("kept = 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.unionByName(again).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that contain a test item; a row without an id goes if its like is found."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = written(contained_items(docs, items).select(F.col("doc_id").alias("_id")).distinct())
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]), "left_anti").select(docs.columns)


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in ``text``; all rows and columns stay."""
    return pseudonymised(docs).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row for each piece of a document."""
    return best_fit_packing(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", pseudonymous),
    ("packing", packed),
]
ORACLE_SQL = None  # scores, links and token ids are beyond SQL; brute-force versions are in tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, applied to all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
