"""Facts folded into a weighted graph with provenance, and the reads over it.

The graph is three tables.  ``edges`` has one row per (source, relation, target) with bounded
columns only; the documents behind an edge, which for a hot edge may be a third of the corpus, stay
rows of ``edge_sources`` and are joined to a cell of text only where a file format asks for it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import fixed_values as fv
from factloom.functions import text as tx
from factloom.functions.rows import unnest
from factloom.operators import corpus
from factloom.operators.corpus import ordinal
from factloom.operators.entities import (
    EntityDictionary,
    node_type,
    resolve_names,
    with_entities,
)
from factloom.operators.rules import RULE_FACT_TYPE, RuleSet, rule_facts
from factloom.session import discard, stage

EDGE_KEY = ["source", "relation", "target"]
EVIDENCE_PER_EDGE = 4


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    edge_sources: DataFrame

    def staged(self) -> StagedGraph:
        return StagedGraph(self)


class StagedGraph:
    """The tables of a graph, each staged when first asked for, so a read of one does not make the others."""

    def __init__(self, built: Graph) -> None:
        self._built = built

    @cached_property
    def nodes(self) -> DataFrame:
        return stage(self._built.nodes, "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return stage(self._built.edges, "edges")

    @cached_property
    def edge_sources(self) -> DataFrame:
        return stage(self._built.edge_sources, "edge-sources")


# --- facts -----------------------------------------------------------------------------------------


def linked_sentences(documents: DataFrame, dictionary: EntityDictionary) -> DataFrame:
    """Sentences that name an entity, with their entities in the order found."""
    linked = with_entities(corpus.sentence_table(documents), "sentence", dictionary)
    return linked.where(F.size("entities") > 0)


def co_occurrence_pairs(entities: Column) -> Column:
    """Alphabetic pairs of the entities of one sentence.

    A sentence has at most 700 characters, so the pairs of a row are few; no rows meet in a join.
    """
    names = F.array_sort(F.transform(entities, lambda e: e["entity"]))
    return tx.let(
        names,
        lambda sorted_names: F.flatten(
            F.transform(
                sorted_names,
                lambda left, i: F.transform(
                    F.slice(sorted_names, i + 2, F.size(sorted_names)),
                    lambda right: F.struct(left.alias("left"), right.alias("right")),
                ),
            )
        ),
    )


def sentence_facts(sentences: DataFrame, rules: RuleSet) -> DataFrame:
    """Co-occurrence facts, then rule facts of every linked sentence."""
    together = F.transform(
        co_occurrence_pairs(F.col("entities")),
        lambda p: F.struct(
            p["left"].alias("source"),
            F.lit(fv.CO_OCCURS_WITH).alias("relation"),
            p["right"].alias("target"),
            F.lit(fv.CO_OCCURRENCE_WEIGHT).cast("decimal(18,6)").alias("weight"),
        ),
    ).cast(RULE_FACT_TYPE)
    ruled = rule_facts(F.col("sentence"), F.col("entities"), rules)
    keep = ["doc_id", "title", "doc_seq", "sent_idx", F.col("sentence").alias("evidence")]
    return unnest(sentences, keep, F.concat(together, ruled), "sub", "fact").select(
        "fact.*",
        "evidence",
        "doc_id",
        "title",
        ordinal(F.col("doc_seq"), F.col("sent_idx"), F.col("sub")).alias("ord"),
    )


def document_mentions(documents: DataFrame, dictionary: EntityDictionary) -> DataFrame:
    """A fact from every entity of a document to the document."""
    linked = with_entities(
        documents.select("doc_id", "doc_seq", "title", "text"), "text", dictionary
    )
    keep = ["doc_id", "doc_seq", "title"]
    return unnest(linked, keep, F.col("entities"), "pos", "link").select(
        F.col("link.entity").alias("source"),
        F.lit(fv.MENTIONED_IN).alias("relation"),
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("target"),
        F.lit(fv.DOCUMENT_MENTION_WEIGHT).cast("decimal(18,6)").alias("weight"),
        F.col("title").alias("evidence"),
        "doc_id",
        "title",
        ordinal(F.col("doc_seq"), F.lit(-1), F.col("pos") + 1).alias("ord"),
    )


def triple_facts(triples: DataFrame) -> DataFrame:
    """Extracted triples with resolved names: the fact and a mention of each end."""
    def entry(sub: int, source: str, relation: Column, target: Column, weight: Column, evidence: str):
        return F.struct(
            F.col(source).alias("source"),
            relation.alias("relation"),
            target.alias("target"),
            weight.cast("decimal(18,6)").alias("weight"),
            F.col(evidence).alias("evidence"),
            ordinal(F.col("doc_seq"), F.col("chunk_index"), F.col("triple_ord") * 3 + sub).alias(
                "ord"
            ),
        )

    doc_node = F.concat(F.lit("doc:"), F.col("doc_id"))
    mention, light = F.lit(fv.MENTIONED_IN), F.lit(fv.EXTRACTED_MENTION_WEIGHT)
    weight = F.greatest(F.lit(fv.MIN_TRIPLE_WEIGHT), F.col("confidence"))
    facts = F.array(
        entry(0, "source", F.col("relation"), F.col("target"), weight, "evidence"),
        entry(1, "source", mention, doc_node, light, "title"),
        entry(2, "target", mention, doc_node, light, "title"),
    )
    return triples.select("doc_id", "title", F.explode(facts).alias("fact")).select(
        "fact.source",
        "fact.relation",
        "fact.target",
        "fact.weight",
        "fact.evidence",
        "doc_id",
        "title",
        "fact.ord",
    )


# --- folds -----------------------------------------------------------------------------------------


def source_rows(facts: DataFrame) -> DataFrame:
    return facts.select(*EDGE_KEY, "doc_id").distinct()


def first_evidence(facts: DataFrame, limit: int = EVIDENCE_PER_EDGE) -> DataFrame:
    """The first distinct evidence texts of each edge, as ``(edge, rank, evidence)``.

    Repeats are removed and ranks decided on digests and ordinals, partially before each shuffle;
    texts are fetched only for the few ordinals that won.
    """
    firsts = (
        facts.where("evidence <> ''")
        .groupBy(*EDGE_KEY, F.md5("evidence").alias("digest"))
        .agg(F.min("ord").alias("ord"))
    )
    ranked = Window.partitionBy(*EDGE_KEY).orderBy("ord")
    won = (
        firsts.withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= limit)
        .drop("digest")
    )
    return facts.select(*EDGE_KEY, "ord", "evidence").join(won, [*EDGE_KEY, "ord"]).drop("ord")


def fold_edges(facts: DataFrame) -> DataFrame:
    """Facts of equal (source, relation, target) become one edge.

    Weights are decimals, so their sum does not depend on the order rows arrive in.
    """
    base = facts.groupBy(*EDGE_KEY).agg(
        F.sum("weight").alias("weight"),
        F.min_by("title", "ord").alias("title"),
        F.min("doc_id").alias("first_source"),
        F.count_distinct("doc_id").alias("n_sources"),
        F.min("ord").alias("first_ord"),
    )
    evidence = (
        first_evidence(facts)
        .groupBy(*EDGE_KEY)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "evidence"))).alias("ranked"))
        .select(*EDGE_KEY, F.col("ranked.evidence").alias("evidence"))
    )
    return base.join(evidence, EDGE_KEY, "left").withColumn(
        "evidence", F.coalesce("evidence", F.array().cast("array<string>"))
    )


def fold_nodes(adds: DataFrame) -> DataFrame:
    """The first add of a node sets its attributes, each later one counts as a mention."""
    return (
        adds.groupBy("node")
        .agg(
            F.min_by(F.struct("type", "label", "title", "link"), "ord").alias("first"),
            (F.count("*") - 1).alias("mentions"),
            F.min("ord").alias("first_ord"),
        )
        .select("node", "first.*", "mentions", "first_ord")
    )


def entity_mentions(sentences: DataFrame) -> DataFrame:
    """Sentences naming each entity."""
    return (
        sentences.select(F.explode("entities.entity").alias("node"))
        .groupBy("node")
        .agg(F.count("*").alias("in_sentences"))
    )




def _null(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def document_adds(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("node"),
        F.lit("Document").alias("type"),
        F.col("doc_id").alias("label"),
        "title",
        "link",
        ordinal(F.col("doc_seq"), F.lit(-1), F.lit(0)).alias("ord"),
    )


def build_by_rules(documents: DataFrame, dictionary: EntityDictionary, rules: RuleSet) -> Graph:
    """Graph from linking, co-occurrence and sentence rules."""
    spark = documents.sparkSession
    sentences = stage(linked_sentences(documents, dictionary), "linked-sentences")
    from_sentences = sentence_facts(sentences, rules)
    facts = stage(
        document_mentions(documents, dictionary).unionByName(from_sentences), "facts"
    )
    entities = dictionary.node_table(spark).select(
        "node",
        "type",
        F.col("node").alias("label"),
        _null("title"),
        _null("link"),
        ordinal(F.lit(-1), F.lit(-1), F.col("def_ord")).alias("ord"),
    )
    metrics = facts.where(F.col("target").startswith("metric:")).select(
        F.col("target").alias("node"),
        F.lit("Metric").alias("type"),
        F.replace("target", F.lit("metric:"), F.lit("")).alias("label"),
        _null("title"),
        _null("link"),
        "ord",
    )
    adds = entities.unionByName(document_adds(documents)).unionByName(metrics)
    nodes = (
        fold_nodes(adds)
        .join(entity_mentions(sentences), "node", "left")
        .withColumn("mentions", F.col("mentions") + F.coalesce("in_sentences", F.lit(0)))
        .drop("in_sentences")
    )
    return Graph(nodes, fold_edges(facts), source_rows(facts))


def triple_parts(triples: DataFrame, dictionary: EntityDictionary) -> tuple[DataFrame, DataFrame]:
    """Facts and node adds of coerced triples ``(doc_id, doc_seq, title, link, chunk_index, triple_ord, ...)``."""
    resolved = stage(resolve_names(triples, ["source", "target"], dictionary), "triples")
    facts = triple_facts(resolved)

    def add(sub: int, node: Column, kind: Column, label: Column, title: Column, link: Column):
        return F.struct(
            node.alias("node"),
            kind.alias("type"),
            label.alias("label"),
            title.alias("title"),
            link.alias("link"),
            ordinal(F.col("doc_seq"), F.col("chunk_index"), F.col("triple_ord") * 3 + sub).alias(
                "ord"
            ),
        )

    doc_node = F.concat(F.lit("doc:"), F.col("doc_id"))
    none = F.lit(None).cast("string")
    ends = [
        add(i, F.col(e), node_type(F.col(e), F.col(f"{e}_type"), dictionary), F.col(e), none, none)
        for i, e in ((1, "source"), (2, "target"))
    ]
    document = add(0, doc_node, F.lit("Document"), F.col("doc_id"), F.col("title"), F.col("link"))
    return facts, resolved.select(F.inline(F.array(document, *ends)))


def build_from_triples(triples: DataFrame, dictionary: EntityDictionary) -> Graph:
    """Graph from coerced triples, see ``triple_parts``."""
    facts, adds = triple_parts(triples, dictionary)
    return Graph(fold_nodes(adds), fold_edges(facts), source_rows(facts))


# --- reads -----------------------------------------------------------------------------------------


def with_edge_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``edge_ord``, the order of a walk over nodes, neighbours and parallel edges.

    Each level is ordered by first appearance.
    """
    pairs = edges.groupBy("source", "target").agg(F.min("first_ord").alias("pair_ord"))
    node_ords = nodes.select(F.col("node").alias("source"), F.col("first_ord").alias("node_ord"))
    return (
        edges.join(pairs, ["source", "target"])
        .join(node_ords, "source", "left")
        .withColumn("edge_ord", F.struct("node_ord", "pair_ord", "first_ord"))
        .drop("node_ord", "pair_ord")
    )


def without_documents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between nodes that are not documents.

    The bulk is recognised by name; only nodes typed as documents under another name need a join.
    """
    named = edges.where(
        ~F.col("source").startswith("doc:") & ~F.col("target").startswith("doc:")
    )
    others = nodes.where((F.col("type") == "Document") & ~F.col("node").startswith("doc:"))
    for end in ("source", "target"):
        named = named.join(others.select(F.col("node").alias(end)), end, "left_anti")
    return named


def simple_graph(graph: Graph, include_documents: bool = False) -> DataFrame:
    """Undirected edges ``(left, right, weight, relations)``: parallel edges merged.

    ``relations`` keeps the order of first appearance; a pair has few relation names.
    """
    edges = graph.edges if include_documents else without_documents(graph.edges, graph.nodes)
    ordered = with_edge_order(edges, graph.nodes)
    merged = ordered.groupBy(
        F.least("source", "target").alias("left"), F.greatest("source", "target").alias("right")
    ).agg(
        F.sum("weight").alias("weight"),
        F.array_sort(F.collect_list(F.struct("edge_ord", "relation"))).alias("ranked"),
    )
    return merged.select(
        "left",
        "right",
        "weight",
        F.array_join(F.array_distinct(F.col("ranked.relation")), "|").alias("relations"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Ends of edges per node, parallel edges and both ends of a loop counted."""
    ends = edges.select(
        F.explode(F.array("source", "target")).alias("node"), F.col("weight").alias("weight")
    )
    return ends.groupBy("node").agg(
        F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree")
    )


def both_ways(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Neighbour pairs ``(node, neighbor)`` in both directions, once each, loops dropped."""
    pair = F.array(
        F.struct(F.col(source).alias("node"), F.col(target).alias("neighbor")),
        F.struct(F.col(target).alias("node"), F.col(source).alias("neighbor")),
    )
    return edges.where(F.col(source) != F.col(target)).select(F.inline(pair)).distinct()


def bounded_walk(neighbors: DataFrame, seeds: DataFrame, max_hops: int = 2) -> DataFrame:
    """Least number of hops from any seed, for all questions at once.

    ``seeds (qid, node)`` to ``(qid, node, dist)``; each hop is one join and an anti join against
    the nodes already reached.
    """
    reached = seeds.select("qid", "node").distinct().withColumn("dist", F.lit(0))
    frontier = reached
    for hop in range(1, max_hops + 1):
        fresh = (
            frontier.join(neighbors, "node")
            .select("qid", F.col("neighbor").alias("node"))
            .distinct()
            .join(reached, ["qid", "node"], "left_anti")
            .withColumn("dist", F.lit(hop))
        )
        frontier = stage(fresh, f"hop-{hop}") if hop < max_hops else fresh
        reached = reached.unionByName(frontier)
    return reached


def connected_components(neighbors: DataFrame) -> DataFrame:
    """Least node name of every component, by alternating large-star and small-star rounds.

    Both rounds are an aggregation and a join on the node, so a hub is pre-aggregated before the
    shuffle and its rows can be split by the adaptive skew join.  The edges of every round are
    staged, which keeps the lineage short; the rounds end when one leaves the edges as they were.
    """
    all_nodes = neighbors.select("node").distinct()
    edges = stage(neighbors.select("node", "neighbor"), "components")
    settled = False
    while not settled:
        after = stage(_small_star(_large_star(edges)), "components")
        # Both are sets, so equal sizes and no edge that is new make them equal.
        settled = after.count() == edges.count() and after.join(edges, ["node", "neighbor"], "left_anti").isEmpty()
        discard(edges)
        edges = after
    labels = edges.groupBy("node").agg(F.min("neighbor").alias("component"))
    return all_nodes.join(labels, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    both = both_ways(edges, "node", "neighbor")
    least = both.groupBy("node").agg(F.min("neighbor").alias("least"))
    least = least.withColumn("least", F.least("least", "node"))
    return (
        both.where("neighbor > node")
        .join(least, "node")
        .select(F.col("neighbor").alias("node"), F.col("least").alias("neighbor"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(
        F.greatest("node", "neighbor").alias("node"), F.least("node", "neighbor").alias("neighbor")
    ).where("node <> neighbor")
    least = down.groupBy("node").agg(F.min("neighbor").alias("least"))
    moved = (
        down.join(least, "node")
        .where("neighbor <> least")
        .select(F.col("neighbor").alias("node"), F.col("least").alias("neighbor"))
    )
    kept = least.select("node", F.col("least").alias("neighbor"))
    return moved.unionByName(kept).distinct()


def relation_histogram(edges: DataFrame, limit: int = 12) -> DataFrame:
    return (
        edges.groupBy("relation")
        .agg(F.count("*").alias("edges"))
        .orderBy(F.desc("edges"), "relation")
        .limit(limit)
    )
