"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words; every document of it the same fractional number of
copies, target / source size.  Whole copies are taken as they are; what remains of a document is a
share between none and all of its words.  Rounding pairs two shares and moves words at random from
one to the other until one document is empty or full: the expected number of copies of each document
stays what it was, and the words of the source stay the same at every step.  The residual of a block of
documents goes on to the next level of a tree of blocks, where the residuals of one source meet again;
the single one left over is rounded to the nearer end.  Of two documents the larger one stays open, so the
one left over may be the largest of its source; the words that its rounding adds or takes are settled by
giving or taking a copy of others: of a few documents for each power of two in size, the largest first
that do not exceed what is missing.  What remains is less than the smallest document that could be settled with.

Blocks come from a hash of id, text and the number among equal rows, random numbers from it and the level,
so reruns agree whatever the cluster.  A block has a bounded number of rows on average whatever its
sources are; a hot source, a null id or one row that is repeated spreads over all blocks.  Only id, source,
size and a hash of the text are shuffled.

Null texts have no words, null sources are one source, the last in order; documents without words
take none; equal rows are rounded each on their own.  No rows give no rows.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.llm.common import n_words, own, shuffled
from factloom.session import stage

BLOCK = 4096  # rows of a block at the first level
FAN_IN = 256  # blocks whose residuals meet at the next level


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Targets of a table (source, source_size), one row per source.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all
    words; no target exceeds ``most`` times its source, and the excess is reshared by weight.  So
    a target is the lesser of its cap and level * weight, with one level for all, found over the
    sources sorted by cap / weight.  The windows see one row per source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = F.array(*(F.lit(float(w)) for w in weights))
    capped = ranked.withColumns(
        {
            "weight": F.element_at(turn, (F.col("rank") % len(weights) + 1).cast("int")),
            "cap": F.col("source_size") * float(most),
        }
    )
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy()
    levels = capped.withColumns(
        {
            "left": F.sum("source_size").over(everyone) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)),
        }
    ).withColumn("level", F.col("left") / F.col("open"))
    # The first source, by ratio, that the level of its suffix does not fill sets the level.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    chosen = levels.withColumn("level", F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return chosen.select("source", "source_size", target.alias("target"))


def _pivot(rows: pd.DataFrame, level: int, last: bool) -> pd.DataFrame:
    """Round the shares of each source in one block; at most one per source stays open."""
    rows = rows.sort_values(["source", "size", "share", "salt"], ascending=[True, False, True, True], na_position="last", kind="stable")
    size, share = rows["size"].to_list(), rows["share"].to_list()
    source, salt = rows["source"].where(rows["source"].notna(), None).to_list(), rows["salt"].to_list()
    done = [False] * len(size)
    held: int | None = None
    for i in range(len(size)):
        if held is not None and source[held] != source[i]:
            held = None
        if share[i] <= 0 or share[i] >= size[i]:
            done[i] = True
            continue
        if held is None:
            held = i
            continue
        gain = min(size[held] - share[held], share[i])  # held may take, or give
        loss = min(share[held], size[i] - share[i])
        if random.Random(f"{salt[held]}/{salt[i]}/{level}").random() * (gain + loss) < loss:
            full = size[held] - share[held] <= share[i]
            share[held], share[i] = (size[held], share[i] - gain) if full else (share[held] + gain, 0.0)
        else:
            empty = share[held] <= size[i] - share[i]
            share[held], share[i] = (0.0, share[i] + loss) if empty else (share[held] - loss, size[i])
        ended = [share[k] <= 0 or share[k] >= size[k] for k in (held, i)]
        done[held], done[i] = ended
        held = None if all(ended) else i if ended[0] else held
    if last:
        for k in range(len(size)):
            if not done[k]:
                share[k], done[k] = size[k] if 2 * share[k] >= size[k] else 0.0, True
    return rows.assign(share=[float(x) for x in share], done=done)


def _step(level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda rows: _pivot(rows, level, last)


def mix(
    df: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block: int = BLOCK,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies * size) for every row."""
    rows = own(df, doc_id=doc_id, source=source, text=text).select(
        "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")
    )
    # Equal rows are counted before they are dealt and then numbered, so that they spread.
    equal = rows.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("times"))
    numbered = equal.withColumn("number", F.explode(F.expr("sequence(1L, times)")))
    rows = numbered.select("doc_id", "source", "size", F.xxhash64("doc_id", "text_hash", "number").alias("salt"))
    rows = stage(rows.withColumn("rid", F.monotonically_increasing_id()), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = stage(sizes, "mix-sources")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most)
    named = targets.select(F.col("source").alias("_source"), "source_size", "target")
    blocks = -(-max(total, 1) // block)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(F.col("rate")).cast("long")
    open_rows = (
        rows.join(named, rows["source"].eqNullSafe(named["_source"]))
        .drop("_source")
        .withColumn("rate", rate)
        .select(
            "doc_id",
            "source",
            "size",
            "source_size",
            "target",
            whole.alias("whole"),
            ((F.col("rate") - whole) * F.col("size")).alias("share"),
            "salt",
            "rid",
            F.pmod("salt", F.lit(blocks)).alias("block"),
            F.lit(False).alias("done"),
        )
    )
    shape, level, finished = open_rows.schema, 0, []
    while True:
        last = blocks == 1
        rounded = stage(open_rows.groupBy("block").applyInPandas(_step(level, last), shape), f"mix-level-{level}")
        finished.append(rounded.where("done"))
        if last:
            break
        blocks, level = -(-blocks // fan_in), level + 1
        # At most one open row per source and block; a group of the next level has fan_in blocks of them.
        open_rows = rounded.where("not done").withColumn("block", F.pmod(F.col("block"), F.lit(blocks)))
    result = finished[0]
    for part in finished[1:]:
        result = result.unionByName(part)
    extra = (F.col("share") >= F.col("size")).cast("long") * (F.col("size") > 0).cast("long")
    settled = result.withColumn("extra", extra)
    flips = stage(_flips(settled.withColumn("open", F.col("target") / F.col("source_size") > F.col("whole"))), "mix-flips")
    copies = F.col("whole") + F.when(F.col("flip"), 1 - F.col("extra")).otherwise(F.col("extra"))
    return settled.join(flips, "rid", "left").select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


PER_CLASS = 64  # documents of a source, a power of two in size and a direction that may be settled with


def _flips(rows: DataFrame) -> DataFrame:
    """(rid, flip) of the documents that give or get a copy, so that each source comes near its target.

    A source has at most ``PER_CLASS`` candidates for each power of two, so its list is bounded.
    """
    taken = F.sum((F.col("whole") + F.col("extra")) * F.col("size"))
    missing = rows.groupBy(F.col("source").alias("of")).agg((F.first("target") - taken).alias("missing")).where("abs(missing) >= 1")
    able = rows.where(F.col("open") & (F.col("size") > 0)).select(
        "source", "size", "salt", "rid", (F.col("extra") == 0).alias("gets"), F.floor(F.log2("size")).alias("class")
    )
    few = W.partitionBy("source", "gets", "class").orderBy("size", "salt", "rid")
    listed = (
        able.withColumn("place", F.row_number().over(few))
        .where(F.col("place") <= PER_CLASS)
        .groupBy("source")
        .agg(F.sort_array(F.collect_list(F.struct("size", "salt", "rid", "gets")), asc=False).alias("able"))
    )
    wanted = listed.join(missing, listed["source"].eqNullSafe(missing["of"]))
    none = F.array().cast("array<bigint>")
    start = F.struct(F.abs("missing").alias("rest"), none.alias("rids"))

    def settle(held: Column, row: Column) -> Column:
        fits = (row["gets"] == (F.col("missing") > 0)) & (row["size"] <= held["rest"])
        return F.when(
            fits, F.struct((held["rest"] - row["size"]).alias("rest"), F.concat(held["rids"], F.array(row["rid"])).alias("rids"))
        ).otherwise(held)

    settled = wanted.select(F.aggregate("able", start, settle)["rids"].alias("rids"))
    return settled.select(F.explode("rids").alias("rid"), F.lit(True).alias("flip"))


def repeated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it.

    Rows of one id, source and size share their copies evenly, the first texts in order getting one more.
    """
    copies = mix(df, doc_id=doc_id, text=text, source=source, **how)
    copies = copies.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    # The caller's row travels as one column, so no name of it can clash.
    rows = df.select(F.struct("*").alias("row"))
    row = F.col("row")
    keyed = rows.select("row", row[doc_id].alias("row_id"), row[source].alias("row_source"), n_words(row[text]).alias("words"))
    same = (
        keyed["row_id"].eqNullSafe(copies["doc_id"]) & keyed["row_source"].eqNullSafe(copies["source"]) & (keyed["words"] == copies["size"])
    )
    joined = keyed.join(shuffled(copies), same).select("row", "doc_id", "source", "size", "copies", "rows")
    # Only rows that share their key are ordered by text; the others take all copies of the key.
    place = F.row_number().over(W.partitionBy("doc_id", "source", "size").orderBy(row[text])) - 1
    several = joined.where("rows > 1").withColumn("place", place)
    mine = several.select("row", F.expr("copies div rows + if(place < copies % rows, 1, 0)").alias("mine"))
    counted = joined.where("rows = 1").select("row", F.col("copies").alias("mine")).unionByName(mine)
    return counted.where("mine > 0").select(F.explode(F.expr("array_repeat(row, cast(mine as int))")).alias("row")).select("row.*")
