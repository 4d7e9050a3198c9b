"""Extracted triples: JSON replies, coercion, the extraction cache and the work estimate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import fixed_values as fv
from factloom.functions import text as tx
from factloom.functions.rows import once, unnest

# Leaves are read as text and coerced afterwards, because replies mix types.
TRIPLE = (
    "struct<source:string,relation:string,target:string,source_type:string,target_type:string,"
    "evidence:string,confidence:string>"
)
TRIPLES = f"array<{TRIPLE}>"
REPLY_SCHEMA = f"triples {TRIPLES}"
CACHE_SCHEMA = f"key string, triples {TRIPLES}"


def parse_replies(replies: DataFrame) -> DataFrame:
    """Parse ``reply`` as a JSON object, or the outermost braces inside it; ``malformed`` marks others.

    Columns other than ``reply`` are kept.
    """
    keep = [c for c in replies.columns if c != "reply"]
    parsed = once(replies, "parsed", F.from_json(tx.json_object(F.col("reply")), REPLY_SCHEMA))
    empty = F.array().cast(TRIPLES)
    return parsed.select(
        *keep,
        F.coalesce(F.filter("parsed.triples", lambda t: t.isNotNull()), empty).alias("triples"),
        F.col("parsed").isNull().alias("malformed"),
    )


def coerce_triples(parsed: DataFrame) -> DataFrame:
    """Raw triples to clean ones; without both ends, or with equal ends, they are dropped.

    ``parsed`` needs ``doc_id, doc_seq, title, link, chunk_index, triples``.  The order in the
    reply is kept as ``triple_ord``.
    """
    keep = ["doc_id", "doc_seq", "title", "link", "chunk_index"]
    rows = unnest(parsed, keep, F.col("triples"), "triple_ord", "t")

    def field(name: str, missing: str) -> Column:
        return tx.clean_text(F.coalesce(F.col(f"t.{name}"), F.lit(missing)))

    # The filter below reads both ends several times.
    rows = once(rows, "ends", F.struct(field("source", "").alias("source"), field("target", "").alias("target")))
    fields = rows.select(
        *keep,
        "triple_ord",
        "ends.source",
        tx.relation_name(F.coalesce("t.relation", F.lit(""))).alias("relation"),
        "ends.target",
        field("source_type", "Entity").alias("source_type"),
        field("target_type", "Entity").alias("target_type"),
        field("evidence", "").alias("evidence"),
        F.coalesce(F.expr("try_cast(t.confidence as double)"), F.lit(0.75)).alias("confidence"),
    )

    def cut(name: str, size: int, empty: Column) -> Column:
        text = F.substring(name, 1, size)
        return F.when(text == "", empty).otherwise(text).alias(name)

    # NaN counts as no confidence; greatest and least would take it for the largest number.
    confidence = F.when(F.isnan("confidence"), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.col("confidence"), F.lit(1.0)))
    )
    usable = (
        (F.col("source") != "")
        & (F.col("target") != "")
        & (F.lower("source") != F.lower("target"))
    )
    return fields.where(usable).select(
        *keep,
        "triple_ord",
        F.substring("source", 1, 120).alias("source"),
        "relation",
        F.substring("target", 1, 160).alias("target"),
        cut("source_type", 40, F.lit("Entity")),
        cut("target_type", 40, F.lit("Entity")),
        cut("evidence", 700, F.col("title")),
        confidence.alias("confidence"),
    )


def latest_entries(cache_lines: DataFrame) -> DataFrame:
    """Cache lines ``(line_no, key, triples)`` to one entry per key: the last line wins."""
    return cache_lines.groupBy("key").agg(
        F.max_by(F.coalesce("triples", F.array().cast(TRIPLES)), "line_no").alias("triples")
    )


def split_by_cache(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks with their cached triples, and the chunks still to be extracted."""
    return chunks.join(cache, "key"), chunks.join(cache, "key", "left_anti")


def cached_form(coerced: DataFrame, chunks: DataFrame) -> DataFrame:
    """Coerced triples back in cache form, one row per chunk, chunks without triples included."""
    item = F.struct(
        "triple_ord",
        *(
            F.col(c).cast("string").alias(c)
            for c in (
                "source", "relation", "target", "source_type", "target_type", "evidence",
                "confidence",
            )
        ),
    )
    per_chunk = coerced.groupBy("doc_id", "chunk_index").agg(
        F.array_sort(F.collect_list(item)).alias("items")
    )
    slim = F.transform(
        "items", lambda t: F.struct(*(t[c].alias(c) for c in (
            "source", "relation", "target", "source_type", "target_type", "evidence", "confidence",
        )))
    )
    return (
        chunks.select("doc_id", "chunk_index", "key")
        .join(per_chunk, ["doc_id", "chunk_index"], "left")
        .select("key", F.coalesce(slim, F.array().cast(TRIPLES)).alias("triples"))
    )


def work_estimate(
    chunks: DataFrame,
    cache: DataFrame,
    questions: int,
    seconds_per_call: float = fv.SECONDS_PER_CALL,
) -> DataFrame:
    """Chunks total, cached and to extract, calls and seconds, as one row."""
    marked = chunks.select("key").join(
        cache.select("key", F.lit(True).alias("hit")), "key", "left"
    )
    counts = marked.agg(
        F.count("*").cast("double").alias("total_chunks"),
        F.count("hit").cast("double").alias("cached_chunks"),
    )
    calls = questions * fv.CALLS_PER_QUESTION
    uncached = F.col("total_chunks") - F.col("cached_chunks")
    return counts.select(
        "total_chunks",
        "cached_chunks",
        uncached.alias("uncached_chunks"),
        F.lit(float(calls)).alias("benchmark_calls"),
        (uncached + calls).alias("total_llm_calls"),
        F.lit(float(seconds_per_call)).alias("seconds_per_call"),
        ((uncached + calls) * seconds_per_call).alias("estimated_seconds"),
    )
