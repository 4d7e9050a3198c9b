"""A graph that grows: fold states of parts of a corpus, stored and folded on without their documents.

A state keeps of every edge what a fold needs and no more: sums, least ordinals, the first four evidence
texts with digest and ordinal, and its documents as rows.  Folding states is associative and does not
depend on their order, since facts carry the ordinals of their documents: an evidence text that is among
the first four of all parts is among the first four of its own.  So the fold of two stored parts is the
fold of all their facts, and a part costs what its own documents cost; reading folds rows of edges.

A part is stored under a name.  Storing it again replaces it; it counts once its mark is written, which is
done last, so a part that failed is not there.  Parts have to be of different documents.  Many small parts
are put together by storing what ``read_state`` gives as one part of another path.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.graph import EDGE_KEY, EVIDENCE_PER_EDGE, Graph, source_rows
from factloom.session import discard_path

WEIGHT = "decimal(28,6)"  # of a sum of decimal(18,6)
TABLES = ("nodes", "edges", "evidence", "sources")


@dataclass(frozen=True)
class State:
    """Partial folds: one row per node, edge, (edge, evidence digest) and (edge, document) of each part."""

    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    sources: DataFrame

    def union(self, other: State) -> State:
        return State(*(getattr(self, t).unionByName(getattr(other, t)) for t in TABLES))


def state_of(facts: DataFrame, adds: DataFrame) -> State:
    """State of facts and node adds, as ``graph.triple_parts`` gives them."""
    first = F.struct("type", "label", "title", "link")
    rows = State(
        adds.select("node", first.alias("first"), F.lit(1).cast("bigint").alias("adds"), F.col("ord").alias("first_ord")),
        facts.select(*EDGE_KEY, F.col("weight").cast(WEIGHT).alias("weight"), "title", F.col("ord").alias("first_ord")),
        facts.where("evidence <> ''").select(*EDGE_KEY, F.md5("evidence").alias("digest"), "ord", "evidence"),
        source_rows(facts),
    )
    return folded(rows)


def folded(rows: State) -> State:
    """Rows of one or more states as one row per key; sums and minima go before the shuffles."""
    nodes = rows.nodes.groupBy("node").agg(
        F.min_by("first", "first_ord").alias("first"),
        F.sum("adds").alias("adds"),
        F.min("first_ord").alias("first_ord"),
    )
    edges = rows.edges.groupBy(*EDGE_KEY).agg(
        F.sum("weight").cast(WEIGHT).alias("weight"),
        F.min_by("title", "first_ord").alias("title"),
        F.min("first_ord").alias("first_ord"),
    )
    # Spark ranks in each partition before the shuffle too, so a hot edge sends four rows from each.
    ranked = Window.partitionBy(*EDGE_KEY).orderBy("ord")
    firsts = rows.evidence.groupBy(*EDGE_KEY, "digest").agg(
        F.min_by("evidence", "ord").alias("evidence"), F.min("ord").alias("ord")
    )
    evidence = firsts.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= EVIDENCE_PER_EDGE)
    return State(nodes, edges, evidence.select(*rows.evidence.columns), rows.sources.distinct())


def graph_of(state: State) -> Graph:
    """The graph of a folded state."""
    nodes = state.nodes.select("node", "first.*", (F.col("adds") - 1).alias("mentions"), "first_ord")
    documents = state.sources.groupBy(*EDGE_KEY).agg(
        F.min("doc_id").alias("first_source"), F.count("doc_id").alias("n_sources")
    )
    texts = (
        state.evidence.groupBy(*EDGE_KEY)
        .agg(F.array_sort(F.collect_list(F.struct("ord", "evidence"))).alias("ranked"))
        .select(*EDGE_KEY, F.col("ranked.evidence").alias("evidence"))
    )
    edges = (
        state.edges.join(documents, EDGE_KEY)
        .join(texts, EDGE_KEY, "left")
        .select(
            *EDGE_KEY,
            "weight",
            "title",
            "first_source",
            "n_sources",
            "first_ord",
            F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"),
        )
    )
    return Graph(nodes, edges, state.sources)


# --- stored states ---------------------------------------------------------------------------------


def parts(spark: SparkSession, path: str) -> list[str]:
    """Names of the parts that are complete."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done/part=*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks)
    return sorted(f.getPath().getParent().getName().removeprefix("part=") for f in found or [])


def store_part(state: State, path: str, part: str) -> None:
    """Write a state as a part, in place of an earlier one of that name."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", part):
        raise ValueError(f"not a name for a part: {part!r}")
    spark = state.nodes.sparkSession
    discard_path(spark, f"{path}/done/part={part}")
    for table in TABLES:
        getattr(state, table).write.mode("overwrite").parquet(f"{path}/{table}/part={part}")
    spark.range(1).write.parquet(f"{path}/done/part={part}")


def read_state(spark: SparkSession, path: str) -> State:
    """All complete parts, folded."""
    names = parts(spark, path)
    if not names:
        raise FileNotFoundError(f"no complete part of a graph under {path}")
    stored = (State(*(spark.read.parquet(f"{path}/{t}/part={name}") for t in TABLES)) for name in names)
    return folded(reduce(State.union, stored))
