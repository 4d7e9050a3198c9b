"""The work from corpus files to graph, answers and reports."""

from __future__ import annotations

import logging
import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import fixed_values as fv
from factloom.functions import text as tx
from factloom.operators import answers, corpus, graph as g, growing, replies, retrieval as r, stored_index, triples as tr
from factloom.operators.entities import DEFAULT_DICTIONARY, EntityDictionary
from factloom.operators.rules import DEFAULT_RULES, RuleSet
from factloom.session import discard, stage
from factloom.sources import files
from factloom.sources.chat import ChatSettings, with_file

log = logging.getLogger("factloom")


def default_questions(spark: SparkSession) -> DataFrame:
    rows = list(enumerate(fv.QUESTIONS, start=1))
    return spark.createDataFrame(rows, "qid bigint, question string")


@dataclass
class Pipeline:
    """One run over a corpus folder.  ``chat`` and ``judge`` answer prompts in ``llm`` mode."""

    spark: SparkSession
    dataset: str
    output: str
    mode: str = "offline"
    dictionary: EntityDictionary = DEFAULT_DICTIONARY
    rules: RuleSet = DEFAULT_RULES
    settings: ChatSettings | None = None
    chat: replies.Chat | None = None
    judge: replies.Chat | None = None
    refresh_cache: bool = False
    score_mode: str = "cosine"
    chunks_per_commit: int = 2_000
    most_facts: int | None = None  # asked for per chunk; None: all
    part: str | None = None  # in ``llm`` mode: name of this corpus as a part of the graph stored under ``output``
    calls: int = 0
    tokens: int = 0

    def __post_init__(self) -> None:
        if self.mode not in ("llm", "offline"):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.mode == "llm" and self.chat is None:
            self.settings = self.settings or ChatSettings.from_env(with_file(os.environ))
            self.chat = self.settings.chat()
            self.judge = self.settings.chat(judge=True)
        if self.judge is None:
            self.judge = self.chat

    @property
    def backend(self) -> str:
        """Name of the flat search, as results and metadata give it."""
        return "vector-distance" if self.score_mode == "distance" else "tfidf-cosine"

    # --- building ------------------------------------------------------------------------------------

    def documents(self) -> DataFrame:
        return stage(files.read_corpus(self.spark, self.dataset), "documents")

    def chunks(self, documents: DataFrame) -> DataFrame:
        limits = self.settings
        return corpus.char_chunks(
            documents,
            limits.chunk_chars if limits else fv.CHUNK_CHARS,
            limits.max_chunks_per_doc if limits else None,
        )

    @property
    def cache_path(self) -> str:
        return f"{self.output}/triples_cache"

    def cache(self) -> DataFrame:
        if self.refresh_cache:
            return self.spark.createDataFrame([], tr.CACHE_SCHEMA)
        return files.read_cache(self.spark, self.cache_path)

    def estimate(self, documents: DataFrame, questions: int) -> DataFrame:
        seconds = self.settings.seconds_per_call if self.settings else fv.SECONDS_PER_CALL
        return tr.work_estimate(self.chunks(documents), self.cache(), questions, seconds)

    def extracted_triples(self, documents: DataFrame) -> DataFrame:
        """Triples of all chunks; only chunks missing in the cache are asked for.

        They are asked for in portions of about ``chunks_per_commit``, each of which is a commit of the
        cache, so a run that fails has lost one portion and the next one asks for what is left.
        """
        chunks = stage(self.chunks(documents), "chunks")
        _, missing = tr.split_by_cache(chunks, self.cache())
        misses = stage(missing.dropDuplicates(["key"]), "misses")
        portions = -(-misses.count() // self.chunks_per_commit)
        # In order of portions, so that each is read from the row groups that hold it.
        dealt = misses.withColumn("portion", F.pmod(F.xxhash64("key"), F.lit(portions or 1)))
        dealt = stage(dealt.repartitionByRange("portion", "key").sortWithinPartitions("portion"), "misses-dealt")
        for i in range(portions):
            portion = dealt.where(F.col("portion") == i)
            answered = stage(replies.extraction_replies(portion, self.chat, self.most_facts), "extraction-replies")
            fresh = tr.coerce_triples(tr.parse_replies(answered))
            files.append_cache(tr.cached_form(fresh, portion), self.cache_path)
            self.count(answered)
            discard(answered)
            log.info("extracted portion %d of %d", i + 1, portions)
        discard(misses, dealt)
        known, _ = tr.split_by_cache(chunks, files.read_cache(self.spark, self.cache_path))
        return tr.coerce_triples(known)

    def count(self, answered: DataFrame) -> None:
        """Add the calls and tokens of answered prompts to those of the run."""
        used = replies.usage(answered).first()
        self.calls += used["calls"]
        self.tokens += used["tokens"]

    def graph(self, documents: DataFrame) -> g.Graph:
        if self.mode == "llm" and self.part:
            state = growing.state_of(*g.triple_parts(self.extracted_triples(documents), self.dictionary))
            growing.store_part(state, f"{self.output}/graph_parts", self.part)
            built = growing.graph_of(growing.read_state(self.spark, f"{self.output}/graph_parts"))
        elif self.mode == "llm":
            built = g.build_from_triples(self.extracted_triples(documents), self.dictionary)
        else:
            built = g.build_by_rules(documents, self.dictionary, self.rules)
        return built.staged()

    def stored_graph(self) -> g.Graph:
        rows = files.read_triples(self.spark, f"{self.output}/triples.csv")
        return files.graph_from_triple_rows(rows, self.dictionary).staged()

    # --- answering -----------------------------------------------------------------------------------

    @property
    def index_path(self) -> str:
        return f"{self.output}/index"

    def index(self, documents: DataFrame) -> stored_index.Indexes:
        """Store the documents as a part of the index under ``output``; those of the graph are searched.

        A run with ``part`` searches the chunks of all parts of the graph that are in the index too.
        """
        stored_index.store_part(documents, self.index_path, self.part or "corpus")
        names = [self.part or "corpus"]
        if self.mode == "llm" and self.part:
            known = growing.parts(self.spark, f"{self.output}/graph_parts")
            names = [name for name in stored_index.parts(self.spark, self.index_path) if name in known]
        stored_index.refit(self.spark, self.index_path, names)
        stored_index.clean(self.spark, self.index_path)
        return self.stored_index()

    def stored_index(self) -> stored_index.Indexes:
        """The newest index of an earlier run; no corpus file is read."""
        return stored_index.read(self.spark, self.index_path)

    def has_index(self) -> bool:
        return bool(stored_index.versions(self.spark, self.index_path))

    def search(
        self, questions: DataFrame, graph: g.Graph, index: stored_index.Indexes
    ) -> r.GraphAnswerInputs:
        found = r.graph_search(questions, graph, index.guided, self.dictionary, documents=index.documents)
        return r.GraphAnswerInputs(found.seeds, stage(found.evidence, "evidence"), found.rows)

    def answers(self, questions: DataFrame, evidence: DataFrame, system: str) -> DataFrame:
        """Extractive answers, or those of the chat in ``llm`` mode."""
        if self.mode != "llm":
            return answers.extractive_answers(questions, evidence)
        told = replies.answer_replies(questions, answers.evidence_text(evidence), system, self.chat)
        told = stage(told, "answer-replies")
        self.count(told)
        return replies.parse_answers(questions, told)

    def ask(self, question: str, graph: g.Graph, index: stored_index.Indexes) -> dict:
        """One question: seeds, answer and best edges."""
        questions = self.spark.createDataFrame([(1, question)], "qid bigint, question string")
        found = self.search(questions, graph, index)
        seeds = [row["node"] for row in found.seeds.orderBy("pos").collect()]
        edges = found.rows.where("rank <= 5").orderBy("rank")
        text = tx.edge_text(F.col("source"), F.col("relation"), F.col("target"))
        return {
            "question": question,
            "seeds": seeds,
            "answer": self.answers(questions, found.evidence, "GraphRAG").first()["answer"],
            "edges": [row["edge"] for row in edges.select(text.alias("edge")).collect()],
        }

    def benchmark(self, questions: DataFrame, graph: g.Graph, index: stored_index.Indexes) -> DataFrame:
        """All questions through both systems, one row each."""
        flat = stage(r.flat_search(questions, index.flat, score_mode=self.score_mode), "flat")
        found = self.search(questions, graph, index)
        backend = self.backend
        if self.mode != "llm":
            return answers.compare(
                questions, flat, found.evidence, found.seeds, found.rows, backend
            )
        flat_answers = self.answers(questions, flat, "Flat RAG")
        graph_answers = self.answers(questions, found.evidence, "GraphRAG")
        flat_text, graph_text = (
            answers.evidence_text(e, n) for e, n in ((flat, 5), (found.evidence, 8))
        )
        pairs = (
            questions.join(flat_answers.withColumnRenamed("answer", "flat_answer"), "qid")
            .join(graph_answers.withColumnRenamed("answer", "graph_answer"), "qid")
            .join(flat_text.withColumnRenamed("evidence_text", "flat_text"), "qid", "left")
            .join(graph_text.withColumnRenamed("evidence_text", "graph_text"), "qid", "left")
        )
        pairs = stage(pairs, "pairs")
        judged = stage(replies.judge_replies(pairs, self.judge), "judge-replies")
        self.count(judged)
        verdicts = answers.parse_judgements(judged)
        return (
            pairs.join(verdicts, "qid")
            .join(answers.seed_names(found.seeds), "qid", "left")
            .join(answers.top_edges(found.rows), "qid", "left")
            .select(
                "qid",
                "question",
                F.coalesce("query_entities", F.lit("")).alias("query_entities"),
                F.lit(backend).alias("flat_backend"),
                "flat_answer",
                F.col("graph_answer").alias("graphrag_answer"),
                "flat_score",
                "graphrag_score",
                "flat_hallucination",
                "graphrag_hallucination",
                F.concat_ws(": ", "winner", "reason").alias("verdict"),
                F.coalesce("top_graph_edges", F.lit("")).alias("top_graph_edges"),
            )
        )

    # --- everything ----------------------------------------------------------------------------------

    def run(self, questions: DataFrame | None = None) -> tuple[g.Graph, stored_index.Indexes, DataFrame]:
        """Build, export, index, benchmark, report.  Returns graph, indexes and benchmark rows."""
        started = time.perf_counter()
        questions = default_questions(self.spark) if questions is None else questions
        documents = self.documents()
        n_documents, n_questions = documents.count(), questions.count()
        log.info("documents: %d", n_documents)
        estimate = None
        if self.mode == "llm":
            row = self.estimate(documents, n_questions)
            estimate = row.first().asDict()
            shown = row.select(tx.format_duration(F.col("estimated_seconds"))).first()[0]
            log.info("chunks to extract: %d, about %s", estimate["uncached_chunks"], shown)
        graph = self.graph(documents)
        files.write_triples(graph, f"{self.output}/triples.csv")
        index = self.index(documents)
        results = stage(self.benchmark(questions, graph, index), "benchmark")
        files.write_results(results, f"{self.output}/benchmark_results.csv")
        self.write_metadata(documents, graph, n_documents, n_questions, estimate, started)
        return graph, index, results

    def write_metadata(
        self, documents, graph, n_documents: int, n_questions: int, estimate, started: float
    ) -> None:
        noisy = documents.where("skipped_content").orderBy("doc_seq").select("doc_id")
        files.write_table_of_noise(noisy, f"{self.output}/skipped_noisy_documents")
        facts = {
            "mode": self.mode,
            "documents": n_documents,
            "skipped_noisy_documents": noisy.count(),
            "graph_nodes": graph.nodes.count(),
            "graph_edges": graph.edges.count(),
            "benchmark_questions": n_questions,
            "runtime_seconds": round(time.perf_counter() - started, 3),
            "llm_calls": self.calls,
            "estimated_llm_tokens": self.tokens,
            "model": self.settings.model if self.settings else None,
            "judge_model": self.settings.judge_model if self.settings else None,
            "flat_backend": self.backend,
            "runtime_estimate": estimate,
        }
        schema = (
            "mode string, documents bigint, skipped_noisy_documents bigint, graph_nodes bigint, "
            "graph_edges bigint, benchmark_questions bigint, runtime_seconds double, "
            "llm_calls bigint, estimated_llm_tokens bigint, model string, judge_model string, "
            "flat_backend string, runtime_estimate map<string,double>"
        )
        row = self.spark.createDataFrame([tuple(facts.values())], schema)
        files.write_metadata(row, f"{self.output}/run_metadata.json")
