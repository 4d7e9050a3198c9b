"""Parquet tables as documents and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import corpus


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


TASK_ROWS = 20_000  # rows of a task, about, where rows are dealt


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows over tasks where the file leaves them in few or in large ones.

    How many splits a file has says nothing: a split without the start of a row group is empty, and a file
    of one row group is read by one task however large it is.  So the rows of the splits are counted,
    which reads footers only.  Inputs that lie in tasks of fit size stay where they were read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    counts = df.groupBy(F.spark_partition_id()).count()
    most, rows = counts.agg(F.max("count"), F.sum("count")).first()
    if not rows or (most <= 2 * TASK_ROWS and most * cores <= 2 * rows):
        return df
    return df.repartition(max(cores, -(-rows // TASK_ROWS)), key)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The ``documents`` table in document form: whole texts, titles default to the id."""
    empty = F.lit("")
    rows = table(spark, folder, "documents").select("doc_id", "text")
    fields = spread(rows, "doc_id").select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("doc_id"),
        F.col("doc_id").alias("doc_seq"),
        empty.alias("path"),
        empty.alias("query"),
        empty.alias("title"),
        empty.alias("link"),
        empty.alias("snippet"),
        F.col("text").alias("body"),
    )
    return corpus.assemble(fields)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The ``benchmark`` passages as questions."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("qid"), F.col("text").alias("question")
    )
