"""Answers from evidence, their scores, and the comparison of the two systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import fixed_values as fv
from factloom.functions import text as tx
from factloom.functions.rows import once, unnest


def extractive_answers(
    questions: DataFrame, evidence: DataFrame, max_sentences: int = 5
) -> DataFrame:
    """Best evidence sentences of each question, joined, with their sources: ``(qid, answer)``.

    The evidence of a question is a short ranked list, so everything per question stays small.
    """
    asked = questions.select("qid", tx.term_set(F.col("question")).alias("q_terms"))
    items = evidence.join(asked, "qid")
    keep = ["qid", "rank", "source_id", "score", "q_terms"]
    found = unnest(items, keep, tx.sentences(F.col("text")), "pos", "sentence")
    scored = found.select(
        "qid",
        "rank",
        "source_id",
        "pos",
        "sentence",
        (
            F.col("score")
            + tx.overlap(F.col("q_terms"), tx.term_set(F.col("sentence"))) * 1.3
        ).alias("score"),
    )
    # Evidence without one whole sentence is quoted by its start.
    quoted = items.join(found.select("qid").distinct(), "qid", "left_anti").select(
        "qid",
        "rank",
        "source_id",
        F.lit(0).alias("pos"),
        F.substring("text", 1, 650).alias("sentence"),
        "score",
    )
    order = [F.desc("score"), F.col("rank"), F.col("pos")]
    repeats = Window.partitionBy("qid", "key").orderBy(*order)
    chosen = (
        scored.unionByName(quoted)
        .withColumn("key", tx.dedup_key(F.col("sentence")))
        .withColumn("copy", F.row_number().over(repeats))
        .where("copy = 1")
        .withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
        .where(F.col("place") <= max_sentences)
    )
    bare = tx.strip(F.regexp_replace("sentence", fv.ANSWER_PREFIX_PATTERN, ""))
    for label in (" Supporting extraction:", " Supporting text:"):
        bare = F.replace(bare, F.lit(label), F.lit(""))
    picked = chosen.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("place", bare.alias("part"), "source_id"))).alias("p")
    )
    cited = F.array_distinct(F.filter(F.col("p.source_id"), lambda s: s != ""))
    sources = F.when(
        F.size(cited) > 0,
        F.concat(F.lit(f" {fv.SOURCES_MARK} "), F.array_join(cited, ", "), F.lit(".")),
    ).otherwise(F.lit(""))
    answers = picked.select(
        "qid", F.concat(F.array_join(F.col("p.part"), " "), sources).alias("answer")
    )
    return questions.select("qid").join(answers, "qid", "left").select(
        "qid", F.coalesce("answer", F.lit(fv.NO_EVIDENCE_ANSWER)).alias("answer")
    )


def answer_score(question: Column, answer: Column) -> Column:
    """Share of question terms in the answer, plus 0.25 for sources, less 0.45 for no evidence."""
    terms = tx.term_set(question)
    bonus = F.when(F.contains(answer, F.lit(fv.SOURCES_MARK)), 0.25).otherwise(0.0)
    penalty = F.when(F.contains(answer, F.lit(fv.WEAK_ANSWER_MARK)), 0.45).otherwise(0.0)
    return tx.let(
        terms,
        lambda t: F.when(F.size(t) == 0, F.lit(0.0)).otherwise(
            F.greatest(
                F.lit(0.0), tx.overlap(t, tx.term_set(answer)) / F.size(t) + bonus - penalty
            )
        ),
    )


def verdict(
    flat_answer: Column, graph_answer: Column, flat_score: Column, graph_score: Column
) -> Column:
    weak = F.lit(fv.WEAK_ANSWER_MARK)
    return (
        F.when(
            F.contains(graph_answer, weak) & F.contains(flat_answer, weak),
            F.lit(fv.VERDICT_BOTH_WEAK),
        )
        .when(
            (graph_score >= flat_score + 0.18) & (flat_score < 0.42),
            F.lit(fv.VERDICT_GRAPH_OVER_WEAK_FLAT),
        )
        .when(graph_score >= flat_score + 0.18, F.lit(fv.VERDICT_GRAPH))
        .when(flat_score >= graph_score + 0.18, F.lit(fv.VERDICT_FLAT))
        .otherwise(F.lit(fv.VERDICT_EVEN))
    )


def evidence_text(evidence: DataFrame, max_items: int = 8) -> DataFrame:
    """Numbered evidence lines per question: ``(qid, evidence_text)``."""
    line = tx.evidence_line(F.col("rank"), F.col("source_id"), F.col("title"), F.col("text"))
    return (
        evidence.where(F.col("rank") <= max_items)
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
        .select("qid", F.array_join(F.col("lines.line"), "\n").alias("evidence_text"))
    )


def top_edges(rows: DataFrame, limit: int = 4) -> DataFrame:
    """The best facts of each question as one text: ``(qid, top_graph_edges)``."""
    text = tx.edge_text(F.col("source"), F.col("relation"), F.col("target"))
    return (
        rows.where(F.col("rank") <= limit)
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("edge")))).alias("e"))
        .select("qid", F.array_join(F.col("e.edge"), " | ").alias("top_graph_edges"))
    )


def case_list(questions: DataFrame, rows: DataFrame, first: int = 10, edges: int = 4) -> DataFrame:
    """The first questions that have facts, with their best ones: ``(qid, question, evidence_edges)``."""
    best = top_edges(rows, edges).withColumnRenamed("top_graph_edges", "evidence_edges")
    return questions.where(F.col("qid") <= first).join(best, "qid").select("qid", "question", "evidence_edges")


def seed_names(seeds: DataFrame) -> DataFrame:
    return (
        seeds.groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("s"))
        .select("qid", F.array_join(F.col("s.node"), ", ").alias("query_entities"))
    )


def compare(
    questions: DataFrame,
    flat_evidence: DataFrame,
    graph_evidence: DataFrame,
    seeds: DataFrame,
    rows: DataFrame,
    backend: str = "tfidf-cosine",
) -> DataFrame:
    """One row per question: both extractive answers, their scores and the verdict."""
    flat = extractive_answers(questions, flat_evidence).withColumnRenamed("answer", "flat_answer")
    graph = extractive_answers(questions, graph_evidence).withColumnRenamed(
        "answer", "graphrag_answer"
    )
    joined = questions.select("qid", "question").join(flat, "qid").join(graph, "qid")
    for name in ("flat", "graphrag"):
        joined = once(
            joined, f"{name}_score", answer_score(F.col("question"), F.col(f"{name}_answer"))
        )
    return (
        joined.join(seed_names(seeds), "qid", "left")
        .join(top_edges(rows), "qid", "left")
        .select(
            "qid",
            "question",
            F.coalesce("query_entities", F.lit("")).alias("query_entities"),
            F.lit(backend).alias("flat_backend"),
            "flat_answer",
            "graphrag_answer",
            F.round("flat_score", 3).alias("flat_score"),
            F.round("graphrag_score", 3).alias("graphrag_score"),
            F.lit(False).alias("flat_hallucination"),
            F.lit(False).alias("graphrag_hallucination"),
            verdict(
                F.col("flat_answer"),
                F.col("graphrag_answer"),
                F.col("flat_score"),
                F.col("graphrag_score"),
            ).alias("verdict"),
            F.coalesce("top_graph_edges", F.lit("")).alias("top_graph_edges"),
        )
    )


# --- judgements ----------------------------------------------------------------------------------------

JUDGEMENT_FIELDS = (
    "flat_score string, graphrag_score string, winner string, flat_hallucination string, "
    "graphrag_hallucination string, reason string"
)


def parse_judgements(replies: DataFrame) -> DataFrame:
    """Judge replies ``(qid, reply)`` to scores 0..10, winner, flags and reason.

    Scores are cut toward zero; flags given as text count as set only if they say true.
    """
    parsed = once(replies, "j", F.from_json(tx.json_object(F.col("reply")), JUDGEMENT_FIELDS))

    def score(name: str) -> Column:
        value = F.coalesce(F.expr(f"try_cast(j.{name} as double)"), F.lit(0.0))
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.nanvl(value, F.lit(0.0))))
        return clamped.cast("int").alias(name)

    def flag(name: str) -> Column:
        return F.coalesce(F.lower(F.col(f"j.{name}")) == "true", F.lit(False)).alias(name)

    return parsed.select(
        "qid",
        score("flat_score"),
        score("graphrag_score"),
        F.coalesce("j.winner", F.lit("Tie")).alias("winner"),
        flag("flat_hallucination"),
        flag("graphrag_hallucination"),
        tx.clean_text(F.coalesce("j.reason", F.lit(""))).alias("reason"),
    )


def summary(results: DataFrame) -> DataFrame:
    """Wins, hallucination flags and mean scores over judged rows, as one row."""
    winner = F.col("winner")
    return results.agg(
        F.count_if(winner == "FlatRAG").alias("flat_wins"),
        F.count_if(winner == "GraphRAG").alias("graph_wins"),
        F.count_if(~winner.isin("FlatRAG", "GraphRAG")).alias("ties"),
        F.count_if("flat_hallucination").alias("flat_hallucinations"),
        F.count_if("graphrag_hallucination").alias("graph_hallucinations"),
        F.avg("flat_score").alias("flat_mean"),
        F.avg("graphrag_score").alias("graph_mean"),
    )
