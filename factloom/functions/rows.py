"""Row shapes that keep expensive expressions from being evaluated twice.

A filter on a computed column is pushed below the projection that computes it and then evaluates the
expression again, and an explode of a computed array infers such a filter by itself.  The output of
a generator is a barrier for both: a filter on it stays above, filters on other columns still move
down to the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row."""
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def unnest(df: DataFrame, keep: list, array: Column, pos: str, item: str) -> DataFrame:
    """``keep`` plus one row per array element with its position, from 0."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(
        F.col(pos).isNotNull()
    )


def beside(items: DataFrame, asked: DataFrame, name: str, portion: int = 1_000) -> DataFrame:
    """Each row of ``items`` beside each row of ``asked``, which has ``qid``, as a struct ``name``.

    For sets of questions: they travel to the items in arrays of about ``portion``, so items are
    scanned once per portion where they lie, and only what is kept of a pair may be shuffled.
    """
    portions = max(1, -(-asked.count() // portion))
    spread = F.pmod(F.xxhash64("qid"), F.lit(portions))
    parts = [asked.where(spread == i) for i in range(portions)] if portions > 1 else [asked]
    return reduce(
        DataFrame.unionByName,
        (
            items.select(
                "*",
                F.explode(part.agg(F.collect_list(F.struct(*part.columns))).scalar()).alias(name),
            )
            for part in parts
        ),
    )
