"""Steps that ask a language model: prompts are columns, replies come back as a column.

Any object with ``complete(system, user) -> str`` can answer, a recording included.  The object is
sent to the executors, which call it where the rows are; everything before and after the call is
part of the plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import fixed_values as fv
from factloom.functions import text as tx
from factloom.functions.rows import once

REPLY_COLUMNS = "reply string, prompt_chars bigint, reply_chars bigint"


class Chat(Protocol):
    def complete(self, system: str, user: str) -> str: ...


def ask_each(df: DataFrame, keep: Sequence[str], system: str, user: Column, chat: Chat) -> DataFrame:
    """``keep`` plus ``reply`` and the characters sent and received."""
    keep = list(keep)
    prompts = df.select(*keep, user.alias("_user"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = [chat.complete(system, text) or "{}" for text in batch["_user"]]
            yield batch[keep].assign(
                reply=replies,
                prompt_chars=[len(system) + len(text) for text in batch["_user"]],
                reply_chars=[len(reply) for reply in replies],
            )

    return prompts.mapInPandas(run, f"{fields}, {REPLY_COLUMNS}")


def usage(replies: DataFrame) -> DataFrame:
    """Calls and estimated tokens of answered prompts, as one row."""
    chars = F.coalesce(F.sum(F.col("prompt_chars") + F.col("reply_chars")), F.lit(0))
    return replies.agg(F.count("*").alias("calls"), tx.estimated_tokens(chars).alias("tokens"))


EXTRACT_SYSTEM = (
    "Extract facts for a knowledge graph as JSON, nothing else. Name entities briefly and in one "
    "form; write relations in upper snake case; prefer specific facts to mere co-occurrence."
)
EXTRACT_TASK = (
    " of the text below as\n"
    '{"triples": [{"source": "", "relation": "", "target": "", "source_type": "", "target_type": "", '
    '"evidence": "exact short sentence", "confidence": 0.0}]}\n'
    "Types are Company, Person, Policy, Region, Metric, Concept or Document. Numbers become targets. "
    "State only what the text says.\n"
)


def extraction_replies(chunks: DataFrame, chat: Chat, most_facts: int | None = None) -> DataFrame:
    """Replies with triples for chunks that are not in the cache; all facts are asked for, or ``most_facts``."""
    wanted = "Give all facts" if most_facts is None else f"Give at most {most_facts} facts"
    user = F.concat(
        F.lit(wanted + EXTRACT_TASK),
        F.format_string("Document: %s\nTitle: %s\nLink: %s\nPart: %d\n\n", "doc_id", "title", "link", "chunk_index"),
        F.col("chunk"),
    )
    keep = ["doc_id", "doc_seq", "title", "link", "chunk_index", "key"]
    return ask_each(chunks, keep, EXTRACT_SYSTEM, user, chat)


ANSWER_SYSTEM = (
    "Answer from the given evidence only and say so if it does not suffice. Reply as JSON."
)


def answer_replies(questions: DataFrame, evidence_text: DataFrame, system_name: str, chat: Chat) -> DataFrame:
    """Replies for questions that have evidence: ``(qid, reply, ...)``."""
    user = F.concat(
        F.lit(f"System: {system_name}\nQuestion: "),
        F.col("question"),
        F.lit("\n\nEvidence:\n"),
        F.col("evidence_text"),
        F.lit('\n\nReply as {"answer": "short answer in Vietnamese, source ids in parentheses"}'),
    )
    asked = questions.join(evidence_text, "qid")
    return ask_each(asked, ["qid"], ANSWER_SYSTEM, user, chat)


def parse_answers(questions: DataFrame, replies: DataFrame) -> DataFrame:
    """Answers of all questions; without evidence or reply the fixed text stands in."""
    parsed = F.from_json(tx.json_object(F.col("reply")), "answer string")
    told = once(replies.select("qid", "reply"), "a", tx.clean_text(F.coalesce(parsed["answer"], F.lit(""))))
    return questions.select("qid").join(told, "qid", "left").select(
        "qid",
        F.when(F.coalesce("a", F.lit("")) == "", F.lit(fv.NO_EVIDENCE_REPLY)).otherwise(F.col("a")).alias("answer"),
    )


JUDGE_SYSTEM = (
    "Judge two answers strictly: facts, use of the evidence, reasoning over several steps, invented "
    "content. Reply as JSON."
)
JUDGE_SHAPE = (
    '{"flat_score": 0, "graphrag_score": 0, "winner": "FlatRAG|GraphRAG|Tie", "flat_hallucination": '
    'false, "graphrag_hallucination": false, "reason": "short, in Vietnamese"}'
)


def judge_replies(pairs: DataFrame, chat: Chat) -> DataFrame:
    """``pairs (qid, question, flat_answer, graph_answer, flat_text, graph_text)`` to replies."""
    user = F.concat_ws(
        "\n\n",
        *(
            F.concat(F.lit(f"{label}:\n"), F.coalesce(column, F.lit("")))
            for label, column in (
                ("Question", "question"),
                ("Flat answer", "flat_answer"),
                ("Flat evidence", "flat_text"),
                ("Graph answer", "graph_answer"),
                ("Graph evidence", "graph_text"),
            )
        ),
        F.lit(f"Scores are whole numbers from 0 to 10. Reply as {JUDGE_SHAPE}"),
    )
    return ask_each(pairs, ["qid"], JUDGE_SYSTEM, user, chat)
