"""Questions as an inverted index that the rows of items walk through.

The terms of a portion of questions point to the questions that have them, with weights.  Each task holds
the postings of one portion and looks its items' terms up in them, a batch of rows at a time, so a pair
of item and question exists only where they share a term.  What goes on from a task is either such pairs,
the best score of each question and group, or the best few of each question: a bar per question, the
score of the last one kept so far, stops weaker pairs before they are ordered.

A portion has at most ``BUDGET`` postings (or one question), which bounds what passes the driver and what
tasks hold; items are scanned once per portion.  Terms are compared as they are, not by hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.session import ship, stage

BUDGET = 2_000_000  # postings of a portion
CELLS = 1 << 20  # rows of a step times questions, at most
SIM_PLACES = 12


@dataclass(frozen=True)
class Postings:
    """For each distinct term, a stretch of ``question`` (places in the portion) and ``weight``."""

    terms: pa.Array
    bounds: np.ndarray
    question: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, lists: pa.Array) -> Postings:
        """Of one list per question: of terms, or of structs of a term and a weight."""
        owner = np.repeat(np.arange(len(lists)), list_sizes(lists))
        terms, weight = flat(lists)
        coded = terms.dictionary_encode()
        code = np.asarray(coded.indices)
        order = np.argsort(code, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))]).astype(np.int64)
        return cls(coded.dictionary, bounds, owner[order], weight[order])

    def walk(self, lists: pa.Array, questions: int) -> tuple[np.ndarray, np.ndarray]:
        """(row * questions + question, product of weights) for each term an item and a question share."""
        row = np.repeat(np.arange(len(lists)), list_sizes(lists))
        terms, weight = flat(lists)
        slot = np.asarray(pc.index_in(terms, value_set=self.terms).fill_null(-1))
        hit = slot >= 0
        row, weight, slot = row[hit], weight[hit], slot[hit]
        times = self.bounds[slot + 1] - self.bounds[slot]
        first = np.repeat(self.bounds[slot] - (np.cumsum(times) - times), times)
        at = np.arange(len(first)) + first
        return np.repeat(row, times) * questions + self.question[at], np.repeat(weight, times) * self.weight[at]


def list_sizes(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.list_value_length(lists).fill_null(0))


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Terms and weights of all lists."""
    values = lists.flatten()
    if pa.types.is_struct(values.type):
        return values.field(0), np.asarray(values.field(1), dtype=float)
    return values, np.ones(len(values))


@dataclass(frozen=True)
class Portion:
    """Some questions: ids, the postings of each of their columns, and how many are kept of each."""

    qids: pa.Array
    postings: dict[str, Postings]
    keep: np.ndarray
    cells: int = CELLS

    def matches(self, batch: pa.RecordBatch, sources: dict[str, str]) -> Iterator[Found]:
        """What the rows of a batch share with the questions, some rows at a time.

        ``sources`` names, for each column of the questions, the column of the batch to hold against it.
        """
        n = len(self.qids)
        step = max(1, self.cells // max(n, 1))
        for start in range(0, batch.num_rows, step):
            rows = batch.slice(start, step)
            walked = {c: self.postings[c].walk(rows.column(source), n) for c, source in sources.items()}
            hits = sum(len(key) for key, _ in walked.values())
            if 4 * hits >= rows.num_rows * n:  # nearly all pairs share something
                size = rows.num_rows * n
                sums = {c: np.bincount(key, weight, size) for c, (key, weight) in walked.items()}
                key = np.flatnonzero(reduce(np.logical_or, (s != 0 for s in sums.values())))
                sums = {c: s[key] for c, s in sums.items()}
            else:
                key, at = np.unique(np.concatenate([key for key, _ in walked.values()]), return_inverse=True)
                parts = np.split(at, np.cumsum([len(key) for key, _ in walked.values()])[:-1])
                sums = {c: np.bincount(p, weight, len(key)) for p, (c, (_, weight)) in zip(parts, walked.items())}
            yield Found(rows, key // max(n, 1), key % max(n, 1), sums)


@dataclass
class Found:
    """Pairs of a row of ``rows`` and a question, with the sums of the products of shared weights by column."""

    rows: pa.RecordBatch
    row: np.ndarray
    question: np.ndarray
    sums: dict[str, np.ndarray]
    extra: dict[str, np.ndarray] = field(default_factory=dict)

    def where(self, mask: np.ndarray) -> Found:
        cut = lambda values: {c: v[mask] for c, v in values.items()}
        return Found(self.rows, self.row[mask], self.question[mask], cut(self.sums), cut(self.extra))

    def sim(self, column: str = "vec") -> np.ndarray:
        return np.round(self.sums[column], SIM_PLACES)


def portions(asked: DataFrame, columns: Sequence[str], keep: int = 0, budget: int = BUDGET) -> Iterator[Portion]:
    """``asked`` has ``qid``, the list ``columns``, and ``more`` if a question keeps more than ``keep``."""
    sizes = sum((F.greatest(F.size(c), F.lit(0)) for c in columns), F.lit(0))
    asked = stage(asked, "asked")
    n_parts = max(1, -(-(asked.agg(F.sum(sizes)).first()[0] or 0) // budget))
    part = F.pmod(F.xxhash64("qid"), F.lit(n_parts))
    for i in range(n_parts):
        own = asked.where(part == i) if n_parts > 1 else asked
        rows = own.toArrow().combine_chunks()
        if rows.num_rows == 0:
            continue
        lists = {c: pa.concat_arrays(rows.column(c).chunks) for c in columns}
        more = np.asarray(rows.column("more").to_numpy()) if "more" in rows.column_names else 0
        qids = pa.concat_arrays(rows.column("qid").chunks)
        yield Portion(qids, {c: Postings.of(x) for c, x in lists.items()}, np.full(len(qids), keep) + more, CELLS)


Reduced = Callable[[Iterator[Found], Portion], Iterator[pa.RecordBatch]]


def matched(items: DataFrame, parts: Iterator[Portion], sources: dict[str, str], reduced: Reduced, schema: str) -> DataFrame:
    """What ``reduced`` makes of the matches of all items in each task, for all portions of questions."""
    ship(items.sparkSession)

    def one(part: Portion) -> DataFrame:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from reduced((f for batch in batches for f in part.matches(batch, sources)), part)

        return items.mapInArrow(task, schema)

    found = [one(part) for part in parts]
    if not found:
        return items.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) and x.type == f.type else pa.array(x, f.type) for f in schema for x in [columns[f.name]]]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def schema_of(items: DataFrame, qid_type: str, keys: Sequence[str], **values: str) -> tuple[str, pa.Schema]:
    kinds = {f.name: f.dataType.simpleString() for f in items.schema}
    text = ", ".join([f"qid {qid_type}", *(f"{c} {kinds[c]}" for c in keys), *(f"{c} {t}" for c, t in values.items())])
    empty = items.sparkSession.createDataFrame([], text)
    return text, to_arrow_schema(empty.schema)


def qid_type(asked: DataFrame) -> str:
    return asked.schema["qid"].dataType.simpleString()


def pairs(
    asked: DataFrame, items: DataFrame, keys: Sequence[str], sources: dict[str, str], values: Callable[[Found], dict], **types: str
) -> DataFrame:
    """``qid``, the ``keys`` of the item and ``values`` of every pair that shares a term."""
    text, schema = schema_of(items, qid_type(asked), keys, **types)

    def reduced(found: Iterator[Found], part: Portion) -> Iterator[pa.RecordBatch]:
        for f in found:
            if len(f.row):
                row = pa.array(f.row)
                held = {c: f.rows.column(c).take(row) for c in keys}
                yield batch_of(schema, {"qid": part.qids.take(pa.array(f.question)), **held, **values(f)})

    wanted = items.select(*dict.fromkeys([*keys, *sources.values()]))
    return matched(wanted, portions(asked, list(sources)), sources, reduced, text)


def group_best(
    asked: DataFrame, items: DataFrame, group: str, sources: dict[str, str], score: Callable[[Found, Portion], Found]
) -> DataFrame:
    """``qid``, ``group`` and the greatest ``score`` among the items of a group."""
    text, schema = schema_of(items, qid_type(asked), [group], score="double")

    def reduced(found: Iterator[Found], part: Portion) -> Iterator[pa.RecordBatch]:
        n = len(part.qids)
        for f in found:
            names = f.rows.column(group).dictionary_encode()
            f = score(f, part)
            if not len(f.row):
                continue
            key = np.asarray(names.indices)[f.row] * n + f.question
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            most = np.maximum.reduceat(f.extra["score"][order], first)
            key = key[order][first]
            columns = {"qid": part.qids.take(pa.array(key % n)), group: names.dictionary.take(pa.array(key // n)), "score": most}
            yield batch_of(schema, columns)

    best = matched(items, portions(asked, list(sources)), sources, reduced, text)
    return best.groupBy("qid", group).agg(F.max("score").alias("score"))


def best(
    asked: DataFrame,
    items: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sources: dict[str, str],
    score: Callable[[Found, Portion], Found],
    keep: int,
    text: str | None = None,
) -> DataFrame:
    """``qid``, ``keys`` and ``score``: of each task the ``keep`` best items of a question, and its ``more``.

    Equal scores go by ``order``, two columns of whole numbers.  Items of one ``text`` count once, as the
    best of them.
    """
    kind, schema = schema_of(items, qid_type(asked), keys, score="double")

    def reduced(found: Iterator[Found], part: Portion) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        bar = np.full(len(part.qids), -np.inf)

        def cut(question: np.ndarray, value: np.ndarray, places: list[np.ndarray], code: np.ndarray | None) -> np.ndarray:
            """Which of the candidates stay, best first by question."""
            at = np.lexsort((places[1], places[0], -value, question))
            if code is not None:  # the best copy of a text comes first
                _, one = np.unique(question[at] * (code.max(initial=0) + 1) + code[at], return_index=True)
                at = at[np.sort(one)]
            asked = question[at]
            start = np.flatnonzero(np.diff(asked, prepend=-1))
            rank = np.arange(len(at)) - np.repeat(start, np.diff(start, append=len(at)))
            return at[rank < part.keep[asked]]

        def codes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            return np.asarray(column.dictionary_encode().indices.fill_null(-1)) + 1

        def settled(rows: pa.Table) -> pa.Table:
            question, value = np.asarray(rows["question"]), np.asarray(rows["score"])
            at = cut(question, value, [np.asarray(rows[c]) for c in order], codes(rows[text]) if text else None)
            rows, question, value = rows.take(pa.array(at)), question[at], value[at]
            counts = np.bincount(question, minlength=len(bar))
            full = (counts >= part.keep) & (counts > 0)
            bar[full] = value[np.cumsum(counts)[full] - 1]
            return rows

        for f in found:
            f = score(f, part)
            f = f.where(f.extra["score"] >= bar[f.question])
            if not len(f.row):
                continue
            places = [np.asarray(f.rows.column(c))[f.row] for c in order]
            code = codes(f.rows.column(text))[f.row] if text else None
            at = cut(f.question, f.extra["score"], places, code)
            row = pa.array(f.row[at])
            fresh = {c: f.rows.column(c).take(row) for c in dict.fromkeys([*keys, *order, *([text] if text else [])])}
            fresh = pa.table({**fresh, "question": f.question[at], "score": f.extra["score"][at]})
            held = settled(pa.concat_tables([held, fresh]) if held is not None else fresh)
        if held is not None and held.num_rows:
            asked_ids = part.qids.take(pa.array(np.asarray(held["question"])))
            columns = {c: held[c].combine_chunks() for c in [*keys, "score"]}
            yield batch_of(schema, {"qid": asked_ids, **columns})

    return matched(items, portions(asked, list(sources), keep), sources, reduced, kind)
