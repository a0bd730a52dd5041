"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

Stages 1 to 4 return the columns of `documents`; the last returns pieces of packed sequences. SQL cannot express the
classifier and the packing, so there is no ORACLE_SQL; tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import mixing, near_dup, packing, quality, suffix_dedup
from tilewright.llm.common import keep, table

#: Documents with a score below this go.
REJECT = 0.3


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.select_good(docs, quality.train(docs, table(spark, sf_dir, "labels")), REJECT)


def by_row(docs: DataFrame) -> DataFrame:
    """docs with their ids in __own_id and in doc_id a number of each row's own, in the order of ids, null ids last.

    Where ids name rows already they are the numbers; else the rows are sorted, those of one id by their content.
    """
    if docs.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        return docs.withColumn("__own_id", F.col("doc_id"))
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text"), *docs.columns]
    return keep(docs.orderBy(*order).withColumn("__own_id", F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id()), "rows")


def with_own_ids(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumn("doc_id", F.col("__own_id")).select(*columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the row with the smallest id. Rows that share an id or have none are judged each by its own text."""
    rows = by_row(docs)
    gone = near_dup.near_duplicates(rows, size=5, percent=80).filter("not kept").select("doc_id")
    return with_own_ids(rows.join(gone, "doc_id", "left_anti"), docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that an earlier document has; each row is a document."""
    return with_own_ids(suffix_dedup.remove_repeats(by_row(docs), length=50), docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document."""
    return mixing.resample(docs, mixing.label_weights(table(spark, sf_dir, "labels")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality", good_documents), ("near_dedup", one_of_near_copies), ("suffix_dedup", without_repeats), ("mixing", mixed), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
