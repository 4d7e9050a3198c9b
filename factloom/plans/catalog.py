"""Every operator as a query over the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import fixed_values as fv
from factloom.functions import text as tx
from factloom.functions.rows import once
from factloom.operators import answers, corpus, entities, retrieval as r, triples as tr, visual
from factloom.operators import graph as g, growing, stored_index, tfidf
from factloom.plans import testbed as tb
from factloom.operators.vector_index import VectorIndex, exact_nearest, recall
from factloom.session import shared_folder, shared_path, stage
from factloom.sources import files, tables

STYLE = visual.VisualStyle(
    anchors=("Eriner", "License", "Thon", "Anon"),
    hubs=("Than", "Inner"),
    generic=tb.GENERIC,
    metric_terms=("SALES", "DELIVER", "REVENUE", "SHARE"),
)

VECTOR_LISTS = 16


class Bed:
    """The shared tables of one data folder, each built when first asked for and staged once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.folder, name)

    @cached_property
    def documents(self) -> DataFrame:
        # Without a title and a snippet the content is the text before a second cleaning; no query reads it.
        return stage(tables.documents(self.spark, self.folder).drop("content"), "documents")

    @cached_property
    def questions(self) -> DataFrame:
        return tables.questions(self.spark, self.folder)

    @cached_property
    def graph(self) -> g.Graph:
        return g.build_by_rules(self.documents, tb.DICTIONARY, tb.RULES).staged()

    @cached_property
    def flat_index(self) -> r.ChunkIndex:
        return r.flat_index(self.documents, fv.STOP_WORDS)

    @cached_property
    def guided_index(self) -> r.ChunkIndex:
        return r.guided_index(self.documents, fv.STOP_WORDS)

    @cached_property
    def flat_evidence(self) -> DataFrame:
        return stage(r.flat_search(self.questions, self.flat_index), "flat-evidence")

    @cached_property
    def seeds(self) -> DataFrame:
        seeds = r.primary_seeds(
            self.questions, self.graph, tb.DICTIONARY, tb.GENERIC, tb.NOT_SPECIFIC
        )
        return stage(seeds, "seeds")

    @cached_property
    def facts(self) -> DataFrame:
        return stage(
            r.scored_facts(self.questions, self.seeds, self.graph, tb.GENERIC), "scored-facts"
        )

    @cached_property
    def signals(self) -> DataFrame:
        """Relevance of every document that shares a term with a question."""
        asked = r.asked_questions(self.questions, self.guided_index)
        return stage(r.document_relevance(asked, self.guided_index), "signals")

    @cached_property
    def vector_index(self) -> VectorIndex:
        items, _ = vector_items(self)
        return VectorIndex.build(items, shared_path(self.spark, "vector-index"), VECTOR_LISTS)

    @cached_property
    def search(self) -> r.GraphAnswerInputs:
        found = r.combine(self.questions, self.seeds, self.facts, self.graph, self.guided_index)
        return r.GraphAnswerInputs(found.seeds, stage(found.evidence, "evidence"), found.rows)

    @cached_property
    def star_triples(self) -> DataFrame:
        """The star schema as triples: customers and suppliers in nations, nations in regions,
        suppliers supplying parts by the number of line items."""
        supplies = self.table("lineitem").groupBy("l_suppkey", "l_partkey").agg(
            F.count("*").alias("n")
        )

        def rows(df: DataFrame, source: str, relation: str, target: str, weight: str = "1"):
            return df.selectExpr(
                f"{source} as source",
                f"'{relation}' as relation",
                f"{target} as target",
                f"cast({weight} as decimal(18,6)) as weight",
            )

        parts = [
            rows(self.table("customer"), "concat('c', c_custkey)", "IN_NATION", "concat('n', c_nationkey)"),
            rows(self.table("supplier"), "concat('s', s_suppkey)", "IN_NATION", "concat('n', s_nationkey)"),
            rows(self.table("nation"), "concat('n', n_nationkey)", "IN_REGION", "concat('r', n_regionkey)"),
            rows(supplies, "concat('s', l_suppkey)", "SUPPLIES", "concat('p', l_partkey)", "n"),
        ]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    @cached_property
    def replies(self) -> DataFrame:
        """Reply texts with triples as JSON, made from orders: some in prose, some broken."""
        orders = tables.spread(self.table("orders"), "o_orderkey")
        item = F.to_json(
            F.struct(
                F.concat(F.lit("Cust "), F.col("o_custkey")).alias("source"),
                F.concat(F.lit(" placed-in "), F.col("o_orderpriority")).alias("relation"),
                F.concat(
                    F.when(F.col("o_orderkey") % 11 == 0, F.lit("CUST ")).otherwise(F.lit("Order ")),
                    F.when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey")).otherwise(
                        F.col("o_orderkey")
                    ),
                ).alias("target"),
                F.when(F.col("o_orderkey") % 3 == 0, F.lit("Company")).alias("source_type"),
                F.lit("Metric").alias("target_type"),
                F.when(
                    F.col("o_orderkey") % 5 != 0,
                    F.concat(F.lit("Order  status "), F.col("o_orderstatus")),
                ).alias("evidence"),
                F.expr(
                    "case o_orderkey % 7 when 0 then 'abc' when 1 then 'NaN' when 2 then '-1' "
                    "when 3 then '2' when 4 then '0.5' end"
                ).alias("confidence"),
            )
        )
        body = F.concat(F.lit('{"triples": ['), item, F.lit("]}"))
        reply = (
            F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("Here: "), body, F.lit(" done.")))
            .when(F.col("o_orderkey") % 17 == 0, F.lit("no json at all"))
            .otherwise(body)
        )
        return orders.select(
            F.concat(F.lit("doc_"), F.col("o_custkey")).alias("doc_id"),
            F.col("o_custkey").alias("doc_seq"),
            F.concat(F.lit("Customer "), F.col("o_custkey")).alias("title"),
            F.lit("").alias("link"),
            F.col("o_orderkey").alias("chunk_index"),
            reply.alias("reply"),
        )

    @cached_property
    def coerced(self) -> DataFrame:
        return stage(tr.coerce_triples(tr.parse_replies(self.replies)), "coerced")

    @cached_property
    def chunks(self) -> DataFrame:
        return stage(corpus.char_chunks(self.documents, max_chunks=None), "char-chunks")

    @cached_property
    def cache(self) -> DataFrame:
        """Chunks of labelled documents count as extracted before."""
        done = self.table("labels").select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"))
        return self.chunks.join(done.distinct(), "doc_id", "left_semi").select("key")

    @cached_property
    def judgements(self) -> DataFrame:
        """Judge replies made from events."""
        events = self.table("events")
        winner = F.expr(
            "case event_type when 'click' then 'GraphRAG' when 'view' then 'FlatRAG' else 'Tie' end"
        )
        reply = F.concat(
            F.when(F.col("event_id") % 10 == 0, F.lit("Verdict: ")).otherwise(F.lit("")),
            F.to_json(
                F.struct(
                    F.when(F.col("event_id") % 6 != 0, F.col("value").cast("string")).alias(
                        "flat_score"
                    ),
                    (F.col("event_id") % 13).alias("graphrag_score"),
                    winner.alias("winner"),
                    (F.col("event_id") % 4 == 0).alias("flat_hallucination"),
                    F.when(F.col("event_id") % 9 == 0, F.lit("true"))
                    .otherwise(F.lit("false"))
                    .alias("graphrag_hallucination"),
                    F.concat(F.lit("user  "), F.col("user_id")).alias("reason"),
                )
            ),
        )
        return answers.parse_judgements(events.select(F.col("event_id").alias("qid"), reply.alias("reply")))


_BEDS: dict[tuple[str, str], Bed] = {}


def bed(spark: SparkSession, folder: str) -> Bed:
    key = (spark.sparkContext.applicationId, folder)
    return _BEDS.setdefault(key, Bed(spark, folder))


# --- text ------------------------------------------------------------------------------------------------


def clean_text(b: Bed) -> DataFrame:
    text = once(b.table("documents").select("doc_id", "text"), "c", tx.clean_text(F.col("text")))
    return text.select("doc_id", F.length("c").alias("n_chars"), F.md5("c").alias("digest"))


def garbage_filter(b: Bed) -> DataFrame:
    return b.table("pages").select("page_id", F.col("html").alias("body")).unionByName(
        b.table("documents").select((-F.col("doc_id") - 1).alias("page_id"), F.col("text").alias("body"))
    ).select("page_id", tx.is_garbage(F.col("body")).cast("int").alias("garbage"))


def header_fields(b: Bed) -> DataFrame:
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    raw = F.concat(
        F.lit("Query: page "), F.col("page_id"), F.lit("\r\nTitle: "), title,
        F.lit("\r\nLink: "), F.col("url"),
        F.when(F.col("page_id") % 3 == 0, F.lit("\r\nSnippet: \r\n\r\n")).otherwise(
            F.concat(F.lit("\r\nSnippet:  about "), title, F.lit("\r\n\r\n"))
        ),
        F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(F.lit("Full Content:\r\n")),
        F.col("html"),
    )
    pages = b.table("pages").select(
        F.concat(F.lit("page_"), F.col("page_id")).alias("doc_id"),
        F.col("page_id").alias("doc_seq"),
        F.col("url").alias("path"),
        raw.alias("raw"),
    )
    return corpus.parse_raw(pages, max_chars=None).select(
        "doc_id", "query", "title", "link", "snippet",
        F.length("content").alias("content_chars"), F.md5("text").alias("text_digest"),
    )


def sentence_split(b: Bed) -> DataFrame:
    return corpus.sentence_table(b.documents).select(
        "doc_id", "sent_idx", F.length("sentence").alias("n_chars"), F.md5("sentence").alias("digest")
    )


def content_term_freq(b: Bed) -> DataFrame:
    return (
        b.documents.select("doc_seq", F.explode(tx.content_terms(F.col("text"))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("uses"), F.count_distinct("doc_seq").alias("docs"))
    )


def number_extraction(b: Bed) -> DataFrame:
    texts = b.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text").unionByName(
        b.table("pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
    )
    found = once(texts, "n", tx.numbers(F.col("text")))
    return found.where(F.size("n") > 0).select(
        "id", F.size("n").alias("found"), F.array_join("n", "|").alias("numbers")
    )


def metric_and_relation_names(b: Bed) -> DataFrame:
    name = F.concat(F.lit("  "), F.col("p_name"), F.lit("\t:  "), F.col("p_type"), F.lit(", 12%-off "))
    return b.table("part").select(
        "p_partkey",
        tx.metric_node(F.concat(name, name, name)).alias("metric"),
        tx.relation_name(name).alias("relation"),
        tx.relation_name(F.col("p_size").cast("string")).alias("size_relation"),
        tx.relation_name(F.lit("%%")).alias("no_relation"),
    )


def query_markers(b: Bed) -> DataFrame:
    turns = b.table("conversations").select(
        "conv_id", "turn",
        F.concat("text", F.lit(" sales in Q"), F.col("turn") % 5, F.lit(" 20"), F.col("conv_id") % 100,
                 F.lit(" by "), F.col("turn") % 7, F.lit(".5%")).alias("text"),
    )
    marked = once(turns, "m", tx.query_markers(F.col("text")))
    following = marked.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    # A last turn has none after it and no hits.
    return marked.join(following, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.array_join(F.array_sort("m"), "|").alias("markers"),
        tx.marker_hits(F.col("m"), F.coalesce("next", F.lit(""))).alias("hits"),
    )


def evidence_lines(b: Bed) -> DataFrame:
    return answers.evidence_text(b.flat_evidence, max_items=5).select(
        "qid", F.length("evidence_text").alias("n_chars"), F.md5("evidence_text").alias("digest")
    )


def durations(b: Bed) -> DataFrame:
    seconds = F.col("o_totalprice") / 10 + 0.03
    return b.table("orders").select(
        "o_orderkey", tx.format_duration(seconds).alias("duration"),
        tx.estimated_tokens(F.col("o_orderkey")).alias("tokens"),
    )


# --- chunks ----------------------------------------------------------------------------------------------


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "doc_id", "chunk_ix", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), "text_key"
    )


def flat_chunks(b: Bed) -> DataFrame:
    return _chunk_rows(corpus.flat_chunks(b.documents))


def guided_chunks(b: Bed) -> DataFrame:
    return _chunk_rows(corpus.guided_chunks(b.documents))


def char_chunks(b: Bed) -> DataFrame:
    return b.chunks.select("doc_id", "chunk_index", "key")


def char_chunks_small(b: Bed) -> DataFrame:
    return corpus.char_chunks(b.documents, 900, None).select("doc_id", "chunk_index", "key")


# --- entities --------------------------------------------------------------------------------------------


def entity_links_documents(b: Bed) -> DataFrame:
    linked = entities.with_entities(b.documents.select("doc_id", "text"), "text", tb.DICTIONARY)
    return linked.select("doc_id", F.posexplode("entities").alias("pos", "e")).select(
        "doc_id", "pos", "e.entity", "e.alias_rank"
    )


def entity_links_sentences(b: Bed) -> DataFrame:
    return (
        g.linked_sentences(b.documents, tb.DICTIONARY)
        .select("doc_id", F.explode("entities.entity").alias("entity"))
        .groupBy("doc_id", "entity")
        .agg(F.count("*").alias("sentences"))
    )


def entity_links_by_join(b: Bed) -> DataFrame:
    linked = entities.link_by_join(b.documents.select("doc_id", "text"), "text", tb.DICTIONARY)
    return linked.select("doc_id", F.explode("entities").alias("e")).select(
        "doc_id", "e.entity", "e.alias_rank"
    )


def entity_resolution(b: Bed) -> DataFrame:
    words = F.regexp_extract_all(F.col("text"), F.lit("[A-Z][A-Za-z.]+"), F.lit(0))
    names = b.documents.select(F.explode(words).alias("name")).distinct().withColumn("given", F.col("name"))
    resolved = entities.resolve_names(names, ["name"], tb.DICTIONARY)
    return resolved.select(
        "given", "name", entities.node_type(F.col("name"), F.lit("Entity"), tb.DICTIONARY).alias("type")
    )


# --- graph -----------------------------------------------------------------------------------------------


def cooccurrence_edges(b: Bed) -> DataFrame:
    return _edge_rows(b.graph.edges.where(F.col("relation") == fv.CO_OCCURS_WITH))


def _edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select(
        "source", "relation", "target", F.col("weight").cast("double").alias("weight"), "n_sources",
        "first_source", "title", F.size("evidence").alias("n_evidence"),
        F.md5(F.array_join("evidence", " || ")).alias("evidence_digest"),
    )


def pattern_facts(b: Bed) -> DataFrame:
    facts = g.sentence_facts(g.linked_sentences(b.documents, tb.DICTIONARY), tb.RULES)
    return (
        facts.where(F.col("relation") != fv.CO_OCCURS_WITH)
        .groupBy("source", "relation", "target", "doc_id")
        .agg(F.count("*").alias("facts"), F.sum("weight").cast("double").alias("weight"))
    )


def graph_edges(b: Bed) -> DataFrame:
    return _edge_rows(b.graph.edges)


def edge_sources(b: Bed) -> DataFrame:
    return b.graph.edge_sources.select("source", "relation", "target", "doc_id")


def graph_nodes(b: Bed) -> DataFrame:
    return b.graph.nodes.select("node", "type", "label", "mentions", "title")


def simple_graph(b: Bed) -> DataFrame:
    return g.simple_graph(b.graph).withColumn("weight", F.col("weight").cast("double"))


def simple_graph_with_documents(b: Bed) -> DataFrame:
    merged = g.simple_graph(b.graph, include_documents=True)
    return merged.withColumn("weight", F.col("weight").cast("double"))


def graph_counts(b: Bed) -> DataFrame:
    return b.graph.nodes.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n").unionByName(
        b.graph.edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n")
    )


def relation_histogram(b: Bed) -> DataFrame:
    return g.relation_histogram(b.graph.edges)


def star_degrees(b: Bed) -> DataFrame:
    return g.degrees(b.star_triples).withColumn(
        "weighted_degree", F.col("weighted_degree").cast("double")
    )


def star_walk(b: Bed) -> DataFrame:
    seeds = b.table("region").select(
        F.col("r_regionkey").alias("qid"), F.concat(F.lit("r"), F.col("r_regionkey")).alias("node")
    )
    return g.bounded_walk(g.both_ways(b.star_triples), seeds, 2)


def star_components(b: Bed) -> DataFrame:
    nations = b.star_triples.where("relation = 'IN_NATION'")
    orders = b.table("orders").selectExpr("concat('o', o_orderkey) as source", "concat('c', o_custkey) as target")
    return g.connected_components(g.both_ways(nations.select("source", "target").unionByName(orders)))


def semantic_edges(b: Bed) -> DataFrame:
    edges = visual.semantic_edges(b.graph, STYLE)
    scores = visual.node_scores(edges, b.graph.nodes, STYLE)
    return visual.edge_scores(edges, scores, STYLE).select(
        "left", "right", F.round("weight", 6).alias("weight"), "relations", F.round("score", 6).alias("score")
    )


def visual_node_scores(b: Bed) -> DataFrame:
    edges = visual.semantic_edges(b.graph, STYLE)
    return visual.node_scores(edges, b.graph.nodes, STYLE).select(
        "node", "type", F.round("score", 6).alias("score")
    )


def edge_export(b: Bed) -> DataFrame:
    return files.triple_rows(b.graph).select(
        "source", "relation", "target", "weight", F.md5("sources").alias("sources_digest"),
        F.md5("evidence").alias("evidence_digest"),
    )


def triples_round_trip(b: Bed) -> DataFrame:
    path = f"{shared_folder(b.spark)}/triples-{uuid.uuid4().hex}.csv"
    files.write_triples(b.graph, path)
    back = files.graph_from_triple_rows(files.read_triples(b.spark, path), tb.DICTIONARY)
    return back.edges.select(
        "source", "relation", "target", F.col("weight").cast("double").alias("weight"), "n_sources",
        "first_source", F.size("evidence").alias("n_evidence"),
    )


# --- triples ---------------------------------------------------------------------------------------------


def triple_coercion(b: Bed) -> DataFrame:
    return b.coerced.select(
        "doc_id", "chunk_index", "source", "relation", "target", "source_type", "target_type", "evidence",
        "confidence",
    )


def malformed_replies(b: Bed) -> DataFrame:
    return tr.parse_replies(b.replies).groupBy("malformed").agg(F.count("*").alias("replies")).select(
        F.col("malformed").cast("int").alias("malformed"), "replies"
    )


def triple_graph_edges(b: Bed) -> DataFrame:
    return _edge_rows(g.build_from_triples(b.coerced, tb.DICTIONARY).edges)


def triple_graph_nodes(b: Bed) -> DataFrame:
    return g.build_from_triples(b.coerced, tb.DICTIONARY).nodes.select("node", "type", "label", "mentions", "title")


def _grown(b: Bed) -> g.Graph:
    """The graph of two stored parts, documents of odd and of even ordinals."""
    path = shared_path(b.spark, "graph-parts")
    for name, odd in (("odd", 1), ("even", 0)):
        own = b.coerced.where(F.pmod("doc_seq", F.lit(2)) == odd)
        growing.store_part(growing.state_of(*g.triple_parts(own, tb.DICTIONARY)), path, name)
    return growing.graph_of(growing.read_state(b.spark, path))


def grown_graph_edges(b: Bed) -> DataFrame:
    return _edge_rows(_grown(b).edges)


def grown_graph_nodes(b: Bed) -> DataFrame:
    return _grown(b).nodes.select("node", "type", "label", "mentions", "title")


def cache_latest(b: Bed) -> DataFrame:
    lines = b.table("events").select(
        F.col("event_id").alias("line_no"),
        F.concat(F.lit("user:"), F.col("user_id")).alias("key"),
        F.array(
            F.struct(
                F.col("event_type").alias("source"), F.lit("HAS").alias("relation"), F.col("props").alias("target"),
                *(F.lit(None).cast("string").alias(c) for c in ("source_type", "target_type", "evidence")),
                F.col("value").cast("string").alias("confidence"),
            )
        ).alias("triples"),
    )
    return tr.latest_entries(lines).select("key", F.element_at("triples", 1).alias("t")).select(
        "key", "t.source", "t.target"
    )


def cache_split(b: Bed) -> DataFrame:
    hits, misses = tr.split_by_cache(b.chunks, b.cache)
    return hits.select("key", F.lit(1).alias("hit")).unionByName(misses.select("key", F.lit(0).alias("hit")))


def work_estimate(b: Bed) -> DataFrame:
    return tr.work_estimate(b.chunks, b.cache, b.questions.count())


# --- retrieval -------------------------------------------------------------------------------------------


def tfidf_vocabulary(b: Bed) -> DataFrame:
    chunks = stage(corpus.flat_chunks(b.documents), "flat-chunks")
    ranked = tfidf.ranked_terms(tfidf.term_counts(chunks, "text", fv.STOP_WORDS), chunks.count(), fv.FLAT_MAX_FEATURES)
    return ranked.select("term", F.round("idf", 6).alias("idf"))


def tfidf_vectors(b: Bed) -> DataFrame:
    return b.flat_index.vectors.select(
        "doc_id", "chunk_ix", F.size("vec").alias("n_terms"),
        F.round(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x["w"]), 6).alias("weight_sum"),
    )


def flat_topk(b: Bed) -> DataFrame:
    return b.flat_evidence.select(
        "qid", "rank", "source_id", F.md5("text").alias("digest"), F.round("score", 6).alias("score")
    )


def stored_flat_topk(b: Bed) -> DataFrame:
    """Flat search in an index that was stored in two parts and fitted from their added counts."""
    path = shared_path(b.spark, "index")
    for name, odd in (("odd", 1), ("even", 0)):
        own = b.documents.where(F.pmod("doc_seq", F.lit(2)) == odd)
        stored_index.store_part(own, path, name, fv.STOP_WORDS)
    stored_index.refit(b.spark, path)
    found = r.flat_search(b.questions, stored_index.read(b.spark, path).flat)
    return found.select(
        "qid", "rank", "source_id", F.md5("text").alias("digest"), F.round("score", 6).alias("score")
    )


def flat_topk_distance(b: Bed) -> DataFrame:
    found = r.flat_search(b.questions, b.flat_index, score_mode="distance")
    return found.select(
        "qid", "rank", "source_id", F.md5("text").alias("digest"), F.round("score", 6).alias("score")
    )


def nearest_vectors(b: Bed) -> DataFrame:
    vectors = b.table("embeddings")
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    centres = (
        parts.groupBy("label", "i")
        .agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("xs"))
        .select(F.col("label").cast("bigint").alias("qid"), F.col("xs.x").alias("vec"))
    )
    items = vectors.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    return r.nearest_vectors(centres, items, 5).select(
        "qid", "rank", "item_id", F.round("cosine", 6).alias("cosine"), F.round("score", 6).alias("score")
    )


def vector_items(b: Bed) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries those whose id is divisible by 20."""
    items = b.table("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))
    return items, items.where("item_id % 20 = 0").withColumnRenamed("item_id", "qid")


def vector_index_search(b: Bed) -> DataFrame:
    """The index with all its lists probed, which is the exact search."""
    _, asked = vector_items(b)
    return b.vector_index.search(asked, 10, probes=VECTOR_LISTS).select(
        "qid", "rank", "item_id", F.round("cosine", 6).alias("cosine")
    )


def vector_index_recall(b: Bed) -> DataFrame:
    """Whether as many probes as the index finds necessary reach the recall that was asked for."""
    items, asked = vector_items(b)
    probes = b.vector_index.probes_for(asked, 10, 0.95)
    found = recall(b.vector_index.search(asked, 10, probes), exact_nearest(asked, items, 10))
    # Queries without a direction have no neighbours, and count as queries all the same.
    queries = asked.agg(F.countDistinct("qid").alias("n")).scalar()
    return found.select(queries.alias("queries"), (F.col("recall") >= 0.9).cast("bigint").alias("recall_reached"))


def case_list(b: Bed) -> DataFrame:
    return answers.case_list(b.questions, b.search.rows)


def seeds(b: Bed) -> DataFrame:
    return answers.seed_names(b.seeds)


def fact_scores(b: Bed) -> DataFrame:
    return b.facts.select(
        "qid", "source", "relation", "target", F.round("base_score", 6).alias("base_score")
    )


def fact_evidence(b: Bed) -> DataFrame:
    return r.fact_evidence(b.facts).select(
        "qid", "source_id", F.md5("text").alias("digest"), F.round("score", 6).alias("score")
    )


def doc_relevance(b: Bed) -> DataFrame:
    return b.signals.select(
        "qid", "doc_id", F.round("relevance", 6).alias("relevance")
    )


def source_votes(b: Bed) -> DataFrame:
    return r.source_votes(b.facts, b.graph.edge_sources)


def top_rows(b: Bed) -> DataFrame:
    return b.search.rows.select(
        "qid", "rank", "source", "relation", "target", F.round("score", 6).alias("score")
    )


def graph_evidence(b: Bed) -> DataFrame:
    return b.search.evidence.select(
        "qid", "rank", "source_id", F.md5("text").alias("digest"), F.round("score", 6).alias("score")
    )


def flat_answers(b: Bed) -> DataFrame:
    return answers.extractive_answers(b.questions, b.flat_evidence)


def benchmark_compare(b: Bed) -> DataFrame:
    return answers.compare(b.questions, b.flat_evidence, b.search.evidence, b.search.seeds, b.search.rows).select(
        "qid", "query_entities", "flat_answer", "graphrag_answer", "flat_score", "graphrag_score", "verdict",
        "top_graph_edges",
    )


def judgements(b: Bed) -> DataFrame:
    return b.judgements.withColumns(
        {c: F.col(c).cast("int") for c in ("flat_hallucination", "graphrag_hallucination")}
    )


def judgement_summary(b: Bed) -> DataFrame:
    return answers.summary(b.judgements).withColumns(
        {c: F.round(c, 6) for c in ("flat_mean", "graph_mean")}
    )


def label_quality_of_evidence(b: Bed) -> DataFrame:
    labels = b.table("labels").select(
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("source_id"), "quality", "toxic"
    )
    return b.flat_evidence.join(labels, "source_id").groupBy("quality", "toxic").agg(
        F.count("*").alias("evidence")
    )


QUERIES: dict[str, Callable[[Bed], DataFrame]] = {
    f.__name__: f
    for f in (
        clean_text, garbage_filter, header_fields, sentence_split, content_term_freq,
        number_extraction, metric_and_relation_names, query_markers, durations,
        flat_chunks, guided_chunks, char_chunks, char_chunks_small,
        entity_links_documents, entity_links_sentences, entity_links_by_join, entity_resolution,
        cooccurrence_edges, pattern_facts, graph_edges, edge_sources, graph_nodes, simple_graph,
        simple_graph_with_documents, graph_counts, relation_histogram, star_degrees, star_walk,
        star_components, semantic_edges, visual_node_scores, edge_export,
        triples_round_trip, triple_coercion, malformed_replies, grown_graph_edges, grown_graph_nodes, triple_graph_edges,
        triple_graph_nodes, cache_latest, cache_split, work_estimate, tfidf_vocabulary,
        tfidf_vectors, flat_topk, stored_flat_topk, flat_topk_distance, nearest_vectors, vector_index_search,
        vector_index_recall, case_list, evidence_lines, seeds,
        fact_scores, fact_evidence, doc_relevance, source_votes, top_rows, graph_evidence,
        flat_answers, benchmark_compare, judgements, judgement_summary, label_quality_of_evidence,
    )
}


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    df = QUERIES[name](bed(spark, folder))
    whole = ("tinyint", "smallint", "int")
    return df.select(
        *(F.col(f.name).cast("bigint") if f.dataType.simpleString() in whole else F.col(f.name) for f in df.schema)
    )
