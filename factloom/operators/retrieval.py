"""Flat and graph-guided retrieval for many questions in one plan, keyed by ``qid``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import fixed_values as fv
from factloom.functions import text as tx
from factloom.functions.rows import beside, once
from factloom.operators import corpus, graph as g, matching, tfidf
from factloom.operators.entities import EntityDictionary, with_entities
from factloom.session import release_shuffles, stage

CHUNK_KEY = ["doc_id", "doc_seq", "chunk_ix"]
EDGE_KEY = g.EDGE_KEY


@dataclass(frozen=True)
class ChunkIndex:
    """Chunks, the fitted model and the sparse vectors of the chunks.

    ``chunks`` has ``doc_id, doc_seq, title, chunk_ix, text, text_key`` and ``vectors`` the chunk key
    with ``vec`` and, for graph-guided retrieval, ``text_key``, ``terms`` and ``marks``; both are staged, so
    each question reads only the columns it needs.
    """

    chunks: DataFrame
    model: tfidf.TfidfModel
    vectors: DataFrame

    def query_vectors(self, questions: DataFrame) -> DataFrame:
        return self.model.vectors(questions, "question", ["qid"])


def build_index(
    chunks: DataFrame,
    name: str,
    max_features: int,
    stop_words: Sequence[str] | None = None,
    guided: bool = False,
) -> ChunkIndex:
    """``guided`` adds the content terms and possible markers of each chunk to its vector."""
    chunks = stage(chunks, f"{name}-chunks")
    model = tfidf.fit(chunks, "text", max_features, stop_words)
    release_shuffles(chunks.sparkSession)
    vectors = model.vectors(chunks, "text", [*CHUNK_KEY, "text_key", "text"] if guided else CHUNK_KEY)
    if guided:
        vectors = once(vectors, "terms", tx.term_set(F.col("text")))
        vectors = once(vectors, "marks", tx.marker_candidates(F.col("text"))).drop("text")
    return ChunkIndex(chunks, model, stage(vectors, f"{name}-vectors"))


def flat_index(documents: DataFrame, stop_words: Sequence[str] | None = None) -> ChunkIndex:
    return build_index(corpus.flat_chunks(documents), "flat", fv.FLAT_MAX_FEATURES, stop_words)


def guided_index(documents: DataFrame, stop_words: Sequence[str] | None = None) -> ChunkIndex:
    return build_index(
        corpus.guided_chunks(documents), "guided", fv.GUIDED_MAX_FEATURES, stop_words, guided=True
    )


# --- flat retrieval ----------------------------------------------------------------------------------


def flat_search(
    questions: DataFrame, index: ChunkIndex, k: int = 5, score_mode: str = "cosine"
) -> DataFrame:
    """The ``k`` best chunks per question: ``(qid, rank, source_id, title, text, score)``.

    ``score_mode`` is ``cosine`` or ``distance``, the latter as 1 / (1 + squared distance).  A
    question always gets ``k`` chunks: the ones without a common term all score alike, so the first
    ``k`` of the corpus stand for them.
    """
    if score_mode not in ("cosine", "distance"):
        raise ValueError(f"unknown score mode {score_mode!r}")
    queries = index.query_vectors(questions)
    vectors = index.vectors

    def similar(f: matching.Found, _: matching.Portion) -> matching.Found:
        f.extra["score"] = f.sim()
        return f.where(f.extra["score"] > 0)

    # Each task hands on its best matches of a question.
    matched = matching.best(
        queries, vectors.select(*CHUNK_KEY, "vec"), CHUNK_KEY, ["doc_seq", "chunk_ix"], {"vec": "vec"}, similar, k
    ).withColumnRenamed("score", "sim")
    # Chunks in corpus order stand for all those without a common term.  By distance, chunks
    # without any vocabulary term are nearer than other strangers, so both kinds are kept.
    empty = F.size("vec") == 0
    kinds = [~empty, empty] if score_mode == "distance" else [F.lit(True)]
    firsts = [vectors.where(kind).orderBy("doc_seq", "chunk_ix").limit(k) for kind in kinds]
    fill = reduce(DataFrame.unionByName, firsts)
    listed = fill.agg(F.collect_list(F.struct(*CHUNK_KEY, empty.alias("empty"))).alias("fill"))
    fillers = (
        queries.select("qid", F.explode(listed.scalar()).alias("c"))
        .select("qid", "c.*")
        .withColumn("sim", F.lit(0.0))
    )
    # Only the best matches meet the fillers.  A filler that matches but is not among them stays
    # behind all k of them, so its zero does no harm.
    by_sim = Window.partitionBy("qid").orderBy(F.desc("sim"), "doc_seq", "chunk_ix")
    matches = (
        matched.withColumn("place", F.row_number().over(by_sim))
        .where(F.col("place") <= k)
        .drop("place")
        .withColumn("empty", F.lit(False))
    )
    candidates = (
        matches.unionByName(fillers)
        .groupBy("qid", *CHUNK_KEY)
        .agg(F.max("sim").alias("sim"), F.max("empty").alias("empty"))
    )
    if score_mode == "distance":
        norms = queries.select("qid", (F.size("vec") > 0).cast("double").alias("norm"))
        distance = F.col("norm") + F.when(F.col("empty"), 0.0).otherwise(1.0) - 2 * F.col("sim")
        candidates = candidates.join(norms, "qid").withColumn("score", 1 / (1 + distance))
    else:
        candidates = candidates.withColumn("score", F.col("sim"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_seq", "chunk_ix")
    # The few candidates are known before the chunks are read, so these need no shuffle.
    top = stage(candidates, "flat-candidates").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(index.chunks, CHUNK_KEY).select(
        "qid", "rank", F.col("doc_id").alias("source_id"), "title", "text", "score"
    )


def nearest_vectors(
    queries: DataFrame, items: DataFrame, k: int, portion: int = 1_000
) -> DataFrame:
    """Exact nearest dense vectors: ``queries (qid, vec)``, ``items (item_id, vec)``.

    Every item meets every query, as in an exact vector store, beside the item's row (see
    ``beside``); each partition hands on its best ``k`` per query.  Norms are taken once per vector.
    """

    def product(a: Column, b: Column) -> Column:
        terms = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)

    def with_norm(df: DataFrame, key: str) -> DataFrame:
        return once(df.select(key, "vec"), "norm", product(F.col("vec"), F.col("vec")))

    pairs = beside(with_norm(items, "item_id"), with_norm(queries, "qid"), "q", portion)
    scored = once(pairs, "dot", product(F.col("vec"), F.col("q.vec"))).select(
        "q.qid",
        "item_id",
        F.round(F.col("dot") / F.sqrt(F.col("norm") * F.col("q.norm")), 9).alias("cosine"),
        F.round(1 / (1 + (F.col("norm") + F.col("q.norm") - 2 * F.col("dot"))), 9).alias("score"),
    )
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "item_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


# --- seeds -------------------------------------------------------------------------------------------


def is_generic(node: Column, generic: Sequence[str] = fv.GENERIC_NODES) -> Column:
    return F.lower(node).isin([name.lower() for name in generic])


def question_terms(questions: DataFrame) -> DataFrame:
    return questions.select("qid", F.explode(tx.term_set(F.col("question"))).alias("term"))


def linked_seeds(
    questions: DataFrame, nodes: DataFrame, dictionary: EntityDictionary
) -> DataFrame:
    """Entities named in a question that are nodes of the graph: ``(qid, node, type, pos)``."""
    linked = with_entities(questions.select("qid", "question"), "question", dictionary)
    named = linked.select("qid", F.posexplode("entities").alias("pos", "link")).select(
        "qid", "pos", F.col("link.entity").alias("node")
    )
    return named.join(nodes.select("node", "type"), "node").select("qid", "node", "type", "pos")


def fallback_seeds(
    questions: DataFrame,
    graph: g.Graph,
    limit: int,
    generic: Sequence[str] = fv.GENERIC_NODES,
) -> DataFrame:
    """Nodes whose label shares terms with the question, best first: ``(qid, node, type, pos)``."""
    labels = graph.nodes.where("type <> 'Document'").select(
        "node", "type", "label", F.explode(tx.term_set(F.col("label"))).alias("term")
    )
    shared = (
        labels.join(question_terms(questions), "term")
        .groupBy("qid", "node", "type", "label")
        .agg(F.count("*").alias("shared"))
    )
    wanted = shared.select("node").distinct()
    degree = (
        graph.edges.select(F.explode(F.array("source", "target")).alias("node"))
        .join(wanted, "node", "left_semi")
        .groupBy("node")
        .agg(F.count("*").alias("degree"))
    )
    score = (
        F.col("shared")
        - F.when(is_generic(F.col("label"), generic), 0.75).otherwise(0.0)
        - F.least(F.lit(1.25), F.coalesce("degree", F.lit(0)) * 0.006)
    )
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("node"))
    return (
        shared.join(degree, "node", "left")
        .withColumn("score", score)
        .withColumn("pos", F.row_number().over(best))
        .where(F.col("pos") <= limit)
        .select("qid", "node", "type", "pos")
    )


def primary_seeds(
    questions: DataFrame,
    graph: g.Graph,
    dictionary: EntityDictionary,
    generic: Sequence[str] = fv.GENERIC_NODES,
    not_specific: Sequence[str] = fv.NOT_SPECIFIC_SEEDS,
) -> DataFrame:
    """Start nodes of each question in order: ``(qid, node, pos)``.

    Linked entities, or two fallback nodes where nothing is linked; of these the specific ones, else
    those that are no region, else all; if only regions remain, up to four fallback nodes join.
    """
    linked = stage(linked_seeds(questions, graph.nodes, dictionary), "linked-seeds")
    own = linked.groupBy("qid").agg((F.min((F.col("type") == "Region").cast("int")) == 1).alias("regional"))
    needy = (
        questions.join(own, "qid", "left")
        .where(F.col("regional").isNull() | F.col("regional"))
        .select("qid", "question")
    )
    fallback = stage(fallback_seeds(needy, graph, 4, generic), "fallback-seeds")
    unlinked = fallback.where("pos <= 2").join(linked, "qid", "left_anti")
    seeds = linked.unionByName(unlinked)
    tier = (
        F.when(F.col("type") == "Region", 3)
        .when(F.col("node").isin(list(not_specific)), 2)
        .otherwise(1)
    )
    ranked = seeds.withColumn("tier", tier)
    best = ranked.groupBy("qid").agg(F.min("tier").alias("best"))
    primary = ranked.join(best, "qid").where("tier = best")
    joined = fallback.join(best.where("best = 3"), "qid", "left_semi").join(
        primary, ["qid", "node"], "left_anti"
    )
    return primary.select("qid", "node", "pos").unionByName(
        joined.select("qid", "node", (F.col("pos") + 1_000_000).alias("pos"))
    )


# --- graph facts -------------------------------------------------------------------------------------


def is_document(node: Column) -> Column:
    return node.startswith("doc:")


def edges_in_reach(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges a question may use: ``(qid, edge, dist, source_seed, target_seed)``.

    The walk of two hops runs over documents too, yet a usable fact touches a node at most one hop away,
    and that is not by way of a document.  So one hop gives the same facts.  Facts that have a document
    as an end may also touch it one mention away from a seed: of the mentions only those of such documents
    are walked, so the document hub is never expanded.
    """
    facts = edges.where(F.col("relation") != fv.MENTIONED_IN).select(*EDGE_KEY)
    ends = facts.select(F.explode(F.array("source", "target")).alias("doc"))
    told = ends.where(is_document(F.col("doc"))).distinct()
    mentions = edges.where(F.col("relation") == fv.MENTIONED_IN).select("source", F.col("target").alias("doc"))
    start = seeds.select("qid", "node", F.lit(0).alias("dist"))
    near = (
        start.drop("dist")
        .join(g.both_ways(facts), "node")
        .select("qid", F.col("neighbor").alias("node"), F.lit(1).alias("dist"))
    )
    mentioned = (
        mentions.join(told, "doc")
        .join(start.select("qid", F.col("node").alias("source")), "source")
        .select("qid", F.col("doc").alias("node"), F.lit(1).alias("dist"))
    )
    reach = start.unionByName(near).unionByName(mentioned).groupBy("qid", "node").agg(F.min("dist").alias("dist"))

    def touching(end: str) -> DataFrame:
        seed = F.col("dist") == 0
        return facts.join(reach.withColumnRenamed("node", end), end).select(
            "qid",
            *EDGE_KEY,
            "dist",
            (seed & F.lit(end == "source")).alias("source_seed"),
            (seed & F.lit(end == "target")).alias("target_seed"),
        )

    return (
        touching("source")
        .unionByName(touching("target"))
        .groupBy("qid", *EDGE_KEY)
        .agg(
            F.min("dist").alias("dist"),
            F.max("source_seed").alias("source_seed"),
            F.max("target_seed").alias("target_seed"),
        )
    )


def scored_facts(
    questions: DataFrame,
    seeds: DataFrame,
    graph: g.Graph,
    generic: Sequence[str] = fv.GENERIC_NODES,
) -> DataFrame:
    """Facts around the seeds with their score before documents are weighed in."""
    reach = edges_in_reach(seeds, graph.edges)
    facts = graph.edges.where(F.col("relation") != fv.MENTIONED_IN)
    wide = g.with_edge_order(facts, graph.nodes).select(
        *EDGE_KEY, "weight", "title", "first_source", "evidence", "edge_ord"
    )
    row_text = F.concat_ws(
        " ", "source", "relation", "target", F.array_join("evidence", " || ")
    )
    wide = once(wide, "row_text", row_text)
    wide = once(wide, "row_terms", tx.term_set(F.col("row_text")))
    asked = once(questions.select("qid", "question"), "q_terms", tx.term_set(F.col("question")))
    asked = once(asked, "markers", tx.query_markers(F.col("question"))).drop("question")
    measured = reach.join(wide, EDGE_KEY).join(asked, "qid")
    measured = once(measured, "shared", tx.overlap(F.col("q_terms"), F.col("row_terms")))
    touches = F.col("dist") == 0
    loose = (F.col("shared") == 0) & (F.col("relation") == fv.CO_OCCURS_WITH) & ~touches
    lone_generic = sum(
        (is_generic(F.col(end), generic) & ~F.col(f"{end}_seed")).cast("int")
        for end in ("source", "target")
    )
    score = (
        F.when(touches, 5.0).otherwise(0.0)
        + F.greatest(F.lit(0.0), 2.4 - 0.8 * F.col("dist"))
        + F.when(F.col("relation").isin(list(fv.WEAK_RELATIONS)), 0.35).otherwise(1.8)
        + F.least(F.lit(2.0), 0.08 * F.col("weight").cast("double"))
        + 1.45 * F.col("shared")
        + 1.6 * tx.marker_hits(F.col("markers"), F.col("row_text"))
        - 1.2 * lone_generic
    )
    scored = once(measured.where(~loose), "base_score", score)
    return scored.select(
        "qid", *EDGE_KEY, "base_score", "title", "first_source", "evidence", "edge_ord", "q_terms",
        "row_terms",
    )


def source_votes(facts: DataFrame, edge_sources: DataFrame) -> DataFrame:
    """Votes of the facts for the documents behind them: ``(qid, doc_id, votes)``."""
    vote = F.greatest(F.lit(1), F.bround("base_score", 0).cast("bigint"))
    return (
        facts.select("qid", *EDGE_KEY, vote.alias("vote"))
        .join(edge_sources, EDGE_KEY)
        .groupBy("qid", "doc_id")
        .agg(F.sum("vote").alias("votes"))
    )


def with_document_boost(
    facts: DataFrame, edge_sources: DataFrame, relevance: DataFrame
) -> DataFrame:
    """Add the best relevance among the documents of each fact to its score."""
    boost = (
        facts.select("qid", *EDGE_KEY)
        .join(edge_sources, EDGE_KEY)
        .join(relevance, ["qid", "doc_id"])
        .groupBy("qid", *EDGE_KEY)
        .agg(F.max("relevance").alias("boost"))
    )
    return facts.join(boost, ["qid", *EDGE_KEY], "left").withColumn(
        "score", F.col("base_score") + F.coalesce("boost", F.lit(0.0))
    )


def fact_evidence(facts: DataFrame) -> DataFrame:
    """Each evidence sentence once per question, under the first fact that has it."""
    split = facts.select(
        "qid",
        *EDGE_KEY,
        "base_score",
        "title",
        "first_source",
        "edge_ord",
        "q_terms",
        F.posexplode("evidence").alias("pos", "raw"),
    )
    sentence = once(split, "sentence", tx.strip(F.col("raw"))).where(
        F.length("sentence") >= fv.SENTENCE_MIN_CHARS
    )
    score = F.col("base_score") + 0.6 * tx.overlap(
        F.col("q_terms"), tx.term_set(F.col("sentence"))
    )
    text = F.concat(
        F.lit("Graph fact: "),
        tx.edge_text(F.col("source"), F.col("relation"), F.col("target")),
        F.lit(". Supporting extraction: "),
        F.col("sentence"),
    )
    item = F.struct(
        "edge_ord",
        "pos",
        F.col("first_source").alias("source_id"),
        "title",
        text.alias("text"),
        score.alias("score"),
    )
    return (
        sentence.groupBy("qid", F.md5("sentence").alias("digest"))
        .agg(F.min(item).alias("item"))
        .select("qid", "digest", "item.*")
    )


# --- guided chunks -----------------------------------------------------------------------------------


def asked_questions(questions: DataFrame, index: ChunkIndex) -> DataFrame:
    """``qid`` with the vector, terms and markers of each question, as chunks are held against them."""
    asked = once(index.query_vectors(questions), "q_vec", F.col("vec")).drop("vec").withColumnRenamed("q_vec", "vec")
    texts = once(questions.select("qid", "question"), "terms", tx.term_set(F.col("question")))
    texts = once(texts, "marks", tx.query_markers(F.col("question"))).drop("question")
    return asked.join(texts, "qid")


SIGNALS = {"vec": "vec", "terms": "terms", "marks": "marks"}


def chunk_signals(questions: DataFrame, index: ChunkIndex) -> DataFrame:
    """Similarity, shared terms and marker hits of every question and chunk that have any.

    For a look at all of them; searches keep what they need beside the chunk, see ``combine``.
    """

    def values(f: matching.Found) -> dict:
        counts = {c: f.sums[k].astype("int64") for c, k in (("shared", "terms"), ("markers", "marks"))}
        return {"sim": f.sim(), **counts}

    asked = asked_questions(questions, index)
    kinds = {"sim": "double", "shared": "bigint", "markers": "bigint"}
    found = matching.pairs(asked, index.vectors, CHUNK_KEY, SIGNALS, values, **kinds)
    return found.where("sim > 0 or shared > 0 or markers > 0")


def voted_documents(votes: DataFrame) -> DataFrame:
    """``(doc_id, voted)``: the questions that have votes for a document, with the votes."""
    return votes.groupBy("doc_id").agg(F.collect_list(F.struct("qid", "votes")).alias("voted"))


def voted_vectors(index: ChunkIndex, votes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` of the vectors of documents with votes, and ``voted``.

    A vector travels as two arrays of numbers, which take less than half of an array of structs.
    """
    parts = [F.col("vec.idx").alias("_idx"), F.col("vec.w").alias("_w")]
    narrow = index.vectors.select(*(c for c in columns if c != "vec"), *parts)
    vec = F.arrays_zip(F.col("_idx").alias("idx"), F.col("_w").alias("w")).alias("vec")
    return narrow.join(voted_documents(votes), "doc_id").select(*(vec if c == "vec" else c for c in columns), "voted")


def with_votes(found: matching.Found, part: matching.Portion) -> matching.Found:
    """The pairs whose document the question has votes for; ``extra`` has the votes."""
    lists, n = found.rows.column("voted"), len(part.qids)
    row = np.repeat(np.arange(len(lists)), matching.list_sizes(lists))
    pairs = lists.flatten()
    question = np.asarray(pc.index_in(pairs.field(0), value_set=part.qids).fill_null(-1))
    key, votes = row * n + question, np.asarray(pairs.field(1))
    known = np.flatnonzero(question >= 0)
    if not len(known):
        return found.where(np.zeros(len(found.row), bool))
    known = known[np.argsort(key[known], kind="stable")]
    wanted = found.row * n + found.question
    at = np.minimum(np.searchsorted(key[known], wanted), len(known) - 1)
    hit = key[known][at] == wanted
    found.extra["votes"] = votes[known][at]
    return found.where(hit)


def document_relevance(asked: DataFrame, index: ChunkIndex, votes: DataFrame | None = None) -> DataFrame:
    """Best chunk score per question and document, at most 10: ``(qid, doc_id, relevance)``.

    With ``votes`` only documents that the question has votes for are scored.
    """

    with_vote = votes is not None

    def score(f: matching.Found, part: matching.Portion) -> matching.Found:
        f = with_votes(f, part) if with_vote else f
        f = f.where(f.sim() > 0)
        f.extra["score"] = np.minimum(10.0, 18.0 * f.sim() + 0.7 * f.sums["terms"] + 1.4 * f.sums["marks"])
        return f

    columns = ["doc_id", *SIGNALS.values()]
    items = voted_vectors(index, votes, columns) if with_vote else index.vectors.select(*columns)
    return matching.group_best(asked, items, "doc_id", SIGNALS, score).withColumnRenamed("score", "relevance")


def guided_chunk_evidence(
    asked: DataFrame,
    seeds: DataFrame,
    top_rows: DataFrame,
    votes: DataFrame,
    facts_seen: DataFrame,
    index: ChunkIndex,
    k: int = 8,
) -> DataFrame:
    """Best supporting chunks per question, repeats of a text once: ``(qid, rank, ...)``.

    Documents without a vote are out, unless the question has no votes at all.  The votes travel to the
    chunks of their documents, which are scored there, and each task hands on the best few of a
    question: ``k``, and as many more as the question has facts with the text of a chunk.
    """
    graph_terms = top_rows.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("row_terms"))).alias("graph_terms"))
    seen = facts_seen.select("qid", F.col("digest").alias("text_key"))
    shown = seen.join(index.chunks.select("text_key"), "text_key", "left_semi").groupBy("qid").agg(F.countDistinct("text_key").alias("more"))
    none = F.array().cast("array<string>")
    asked = stage(
        asked.join(seeds.select("qid").distinct(), "qid")
        .join(graph_terms, "qid", "left")
        .join(shown, "qid", "left")
        .join(votes.select("qid", F.lit(True).alias("has_votes")).distinct(), "qid", "left")
        .withColumns({"graph_terms": F.coalesce("graph_terms", none), "more": F.coalesce("more", F.lit(0))}),
        "asked-guided",
    )
    sources = {**SIGNALS, "graph_terms": "terms"}

    def scored(with_vote: bool) -> Callable[[matching.Found, matching.Portion], matching.Found]:
        def score(f: matching.Found, part: matching.Portion) -> matching.Found:
            f = with_votes(f, part) if with_vote else f
            f = f.where((f.sim() > 0) | (f.sums["terms"] > 0) | (f.sums["graph_terms"] >= 2))
            own = 20.0 * f.sim() + 1.25 * f.sums["terms"] + 0.25 * f.sums["graph_terms"] + 2.2 * f.sums["marks"]
            f.extra["score"] = own + 2.2 + np.minimum(2.0, 0.05 * f.extra["votes"]) if with_vote else own
            return f

        return score

    def top(of: DataFrame, items: DataFrame, with_vote: bool) -> DataFrame:
        return matching.best(
            of.drop("has_votes"), items, [*CHUNK_KEY, "text_key"], ["doc_seq", "chunk_ix"], sources, scored(with_vote), k, "text_key"
        )

    columns = [*CHUNK_KEY, "text_key", *SIGNALS.values()]
    known = top(asked.where("has_votes"), voted_vectors(index, votes, columns), True)
    free = top(asked.where("has_votes is null"), index.vectors.select(*columns), False)
    # One copy per text: the best score, the earliest chunk among equals.
    copies = known.unionByName(free).groupBy("qid", "text_key").agg(
        F.min(F.struct((-F.col("score")).alias("neg"), "doc_seq", "chunk_ix", "doc_id")).alias("c")
    )
    unseen = copies.join(seen, ["qid", "text_key"], "left_anti")
    by_score = Window.partitionBy("qid").orderBy("c.neg", "c.doc_seq", "c.chunk_ix")
    picked = (
        unseen.withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k)
        .select("qid", "rank", (-F.col("c.neg")).alias("score"), "c.doc_id", "c.doc_seq", "c.chunk_ix")
    )
    picked = stage(picked, "picked-chunks")
    release_shuffles(picked.sparkSession)
    # The few that were picked are known before the chunks are read, so these need no shuffle.
    return picked.join(index.chunks, CHUNK_KEY).select(
        "qid",
        "rank",
        F.col("doc_id").alias("source_id"),
        "title",
        F.concat(F.lit("Graph-guided supporting chunk: "), F.col("text")).alias("text"),
        "score",
    )


# --- the whole question ------------------------------------------------------------------------------


@dataclass(frozen=True)
class GraphAnswerInputs:
    """``seeds (qid, node, pos)``, ``evidence (qid, rank, source_id, title, text, score)`` and
    ``rows (qid, rank, source, relation, target, score)``."""

    seeds: DataFrame
    evidence: DataFrame
    rows: DataFrame


def graph_search(
    questions: DataFrame,
    graph: g.Graph,
    index: ChunkIndex,
    dictionary: EntityDictionary,
    top_k: int = 10,
    generic: Sequence[str] = fv.GENERIC_NODES,
    not_specific: Sequence[str] = fv.NOT_SPECIFIC_SEEDS,
    documents: DataFrame | None = None,
) -> GraphAnswerInputs:
    """Facts and chunks for all questions.

    ``documents`` limits votes to known documents, for graphs read back from a file.
    """
    seeds = stage(primary_seeds(questions, graph, dictionary, generic, not_specific), "seeds")
    facts = stage(scored_facts(questions, seeds, graph, generic), "scored-facts")
    return combine(questions, seeds, facts, graph, index, top_k, documents)


def combine(
    questions: DataFrame,
    seeds: DataFrame,
    facts: DataFrame,
    graph: g.Graph,
    index: ChunkIndex,
    top_k: int = 10,
    documents: DataFrame | None = None,
) -> GraphAnswerInputs:
    """Weigh documents into the facts, pick supporting chunks, and merge both by score.

    The documents behind the facts of a question are its votes; only their chunks are scored.
    """
    asked = stage(asked_questions(questions, index), "asked-questions")
    votes = stage(source_votes(facts, graph.edge_sources), "votes")
    boosted = with_document_boost(facts, graph.edge_sources, document_relevance(asked, index, votes))
    by_score = Window.partitionBy("qid").orderBy(F.desc("score"), "edge_ord")
    rows = stage(
        boosted.withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= max(30, top_k))
        .select("qid", "rank", *EDGE_KEY, "score", "row_terms"),
        "top-rows",
    )
    release_shuffles(rows.sparkSession)
    from_facts = stage(fact_evidence(facts), "fact-evidence")
    if documents is not None:
        votes = votes.join(documents.select("doc_id"), "doc_id", "left_semi")
    from_chunks = guided_chunk_evidence(asked, seeds, rows, votes, from_facts, index)
    evidence = merge_evidence(from_facts, from_chunks, top_k)
    return GraphAnswerInputs(seeds, evidence, rows.where(F.col("rank") <= top_k).drop("row_terms"))


def merge_evidence(from_facts: DataFrame, from_chunks: DataFrame, top_k: int) -> DataFrame:
    """Facts and chunks by score; among equals facts first, each kind in its own order."""
    no_ord = F.lit(None).cast(from_facts.schema["edge_ord"].dataType)
    columns = ["qid", "source_id", "title", "text", "score"]
    merged = from_facts.select(
        *columns, F.lit(0).alias("kind"), "edge_ord", F.col("pos").alias("at")
    ).unionByName(
        from_chunks.select(
            *columns, F.lit(1).alias("kind"), no_ord.alias("edge_ord"), F.col("rank").alias("at")
        )
    )
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "kind", "edge_ord", "at")
    return (
        merged.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top_k)
        .select("qid", "rank", "source_id", "title", "text", "score")
    )
