"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are range-dealt by id into blocks and written narrow, with the block they fell into.  Block
totals, one row each, are summed up in block order; a row's global start is its block's start plus
the running sum inside the block.  The shard is where the row's middle byte falls among equal
targets, so shards follow the id order and differ from the target by less than one row at each end.
The place in a shard is counted the same way, from row counts of (block, shard).

Blocks are dealt by (id, checksum, size), so many rows of one id still spread.  Null texts have no
bytes and checksum 0; null ids come first; equal rows are interchangeable.  No rows give no shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import n_bytes, own, partitions
from factloom.session import stage

ROW_OVERHEAD = 8  # bytes that a row takes besides its text


def shard_by_bytes(
    df: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", blocks: int | None = None
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row."""
    spark = df.sparkSession
    blocks = blocks or partitions(spark)
    body = F.coalesce(F.col("text"), F.lit(""))
    narrow = own(df, doc_id=doc_id, text=text).select(
        "doc_id",
        (n_bytes(F.col("text")) + ROW_OVERHEAD).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    dealt = stage(
        narrow.repartitionByRange(blocks, "doc_id", "text_crc32", "size").withColumn("block", F.spark_partition_id()),
        "shard-rows",
    )
    # One row per block: at most `blocks` rows meet in this window and in the broadcasts below.
    totals = dealt.groupBy("block").agg(F.sum("size").alias("bytes"))
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "block",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("block_start"),
        F.sum("bytes").over(W.partitionBy()).alias("total"),
    )
    inside = W.partitionBy("block").orderBy("doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumns(
        {"run": F.coalesce(F.sum("size").over(inside), F.lit(0)), "place": F.count("*").over(inside)}
    ).join(F.broadcast(starts), "block")
    middle = "(2 * (block_start + run) + size)"
    cut = placed.withColumn("shard", F.expr(f"cast({middle} * {shards} div (2 * total) as int)"))
    counts = cut.groupBy("block", "shard").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    earlier = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    # Shards are contiguous, so there are fewer than blocks + shards pairs of them.
    offsets = counts.select(
        "block", "shard", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift")
    )
    return cut.join(F.broadcast(offsets), ["block", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("shift")).alias("slot")
    )
