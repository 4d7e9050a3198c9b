"""TF-IDF over chunks: word and word-pair terms, smooth idf, unit-length sparse vectors.

Fitting counts words first.  A pair is at most as frequent as either of its words, so only pairs of words
frequent enough for the vocabulary are counted after that, which gives the vocabulary of all terms.
The vocabulary is bounded by ``max_features``, so it may travel to every task; vectors are made there by
batches, as numbers, and never densified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators import matching
from factloom.session import ship

# Fixed value: tokens are runs of two or more letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
VECTOR = T.ArrayType(T.StructType().add("idx", T.IntegerType()).add("w", T.DoubleType()))
COUNTED = 1 << 20  # words that are counted at once
COUNTS = "term string, cf long, df long"
FREQUENT = 4  # times the size of a vocabulary: words that pairs may end with, at most, else any


def kept_words(text: Column, stop_words: Sequence[str]) -> Column:
    """Words without stop words; terms are these, and pairs of the words now adjacent."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words


@dataclass(frozen=True)
class TfidfModel:
    vocabulary: list[str]
    idf: list[float]
    stop_words: tuple[str, ...]

    def vectors(self, df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
        """``keep`` plus ``vec``: array of (idx, w) of the terms present, of unit length."""
        keep = list(keep)
        if not self.vocabulary:
            empty = F.array().cast("array<struct<idx:int,w:double>>")
            return df.select(*keep, empty.alias("vec"))
        ship(df.sparkSession)
        known = KnownTerms.of(self.vocabulary, self.idf)

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vec = known.weighed(batch.column(len(keep)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], vec], [*keep, "vec"])

        schema = df.select(*keep).schema.add("vec", VECTOR)
        return df.select(*keep, kept_words(F.col(text), self.stop_words).alias("_words")).mapInArrow(weigh, schema)


@dataclass(frozen=True)
class KnownTerms:
    """A vocabulary by numbers: the words in it or in its pairs, and what a word or a pair of words stands for."""

    words: pa.Array
    single: np.ndarray  # index of each word as a term, or -1; the last place is that of all other words
    pairs: np.ndarray  # first word * number of words + second word, ascending
    pair: np.ndarray  # index of each of the pairs
    idf: np.ndarray

    @classmethod
    def of(cls, vocabulary: Sequence[str], idf: Sequence[float]) -> KnownTerms:
        split = [term.split(" ") for term in vocabulary]
        words = sorted({w for term in split for w in term})
        at = {w: i for i, w in enumerate(words)}
        single = np.full(len(words) + 1, -1, np.int64)
        both: dict[int, int] = {}
        for i, term in enumerate(split):
            if len(term) == 1:
                single[at[term[0]]] = i
            else:
                both[at[term[0]] * len(words) + at[term[1]]] = i
        pairs = np.array(sorted(both), np.int64)
        pair = np.array([both[key] for key in pairs.tolist()], np.int64)
        return cls(pa.array(words, pa.string()), single, pairs, pair, np.array(idf, float))

    def weighed(self, lists: pa.Array) -> pa.Array:
        """The vector of each list of words: (idx, w) of its terms by idx, of unit length."""
        n, width = len(lists), max(len(self.idf), 1)
        owner = np.repeat(np.arange(n), matching.list_sizes(lists))
        code = np.asarray(pc.index_in(lists.flatten(), value_set=self.words).fill_null(-1)).astype(np.int64)
        term = self.single[code]
        rows, found = [owner[term >= 0]], [term[term >= 0]]
        if len(self.pairs):
            inner = (owner[1:] == owner[:-1]) & (code[1:] >= 0) & (code[:-1] >= 0)
            key = (code[:-1] * len(self.words) + code[1:])[inner]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = self.pairs[at] == key
            rows.append(owner[1:][inner][hit])
            found.append(self.pair[at[hit]])
        key, times = np.unique(np.concatenate(rows) * width + np.concatenate(found), return_counts=True)
        row, term = key // width, key % width
        weight = times * self.idf[term]
        weight = weight / np.sqrt(np.bincount(row, weight * weight, n))[row]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
        fields = [pa.array(term.astype(np.int32)), pa.array(weight)]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(fields, ["idx", "w"]))


def fit(
    chunks: DataFrame, text: str, max_features: int, stop_words: Sequence[str] | None = None
) -> TfidfModel:
    """The ``max_features`` most frequent terms (ties by term) and their idf.

    ``stop_words=None`` takes Spark's English list.
    """
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords("english")
    spark = chunks.sparkSession
    ship(spark)
    words = chunks.select(kept_words(F.col(text), stop_words).alias("words"))
    most = FREQUENT * max_features
    # One more than a pair may need is asked for, to see whether all of them are here.
    frequent = _summed(words, lambda lists: word_counts(lists)).orderBy(F.desc("cf"), "term").limit(most + 1).collect()
    first, second = ends_of_pairs([(r["term"], r["cf"]) for r in frequent], max_features, most)
    pairs = _summed(words, lambda lists: pair_counts(lists, first, second))
    top = spark.createDataFrame([tuple(r) for r in frequent[:max_features]], COUNTS)
    rows = ranked_terms(top.unionByName(pairs), chunks.count(), max_features).orderBy("idx").collect()
    return TfidfModel([r["term"] for r in rows], [r["idf"] for r in rows], tuple(stop_words))


def ends_of_pairs(frequent: list[tuple[str, int]], max_features: int, most: int) -> tuple[pa.Array, pa.Array | None]:
    """Words that a pair among the ``max_features`` most frequent terms may begin with, and end with (None: any).

    ``frequent`` has the words and their counts, the most frequent first (ties by word), or ``most`` and one more of them.
    A pair comes after its first word in that order, since it is no more frequent and a longer string, so the
    first word is among the first ``max_features``; the second is as frequent as the last of these at least.
    """
    first = [word for word, _ in frequent[:max_features]]
    bar = frequent[max_features - 1][1] if len(frequent) >= max_features else 0
    all_here = len(frequent) <= most or frequent[-1][1] < bar
    second = pa.array([word for word, cf in frequent if cf >= bar], pa.string()) if all_here else None
    return pa.array(first, pa.string()), second


def term_counts(chunks: DataFrame, text: str, stop_words: Sequence[str]) -> DataFrame:
    """(term, cf, df): occurrences and chunks of every term.  Counts of parts of the chunks add up."""
    # Words are counted by batches of chunks as numbers, so a term is a row once per batch and not once per use.
    ship(chunks.sparkSession)
    return _summed(chunks.select(kept_words(F.col(text), stop_words).alias("words")), lambda lists: batch_counts(lists))


def _summed(words: DataFrame, counts: Callable[[pa.ChunkedArray], pa.RecordBatch]) -> DataFrame:
    """(term, cf, df) of the lists ``words``: ``counts`` of batches of them, added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches):
            found = counts(batch["words"])
            yield from (found.slice(at, 1 << 16) for at in range(0, found.num_rows, 1 << 16))

    return words.mapInArrow(count, COUNTS).groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Neighbouring batches as tables of about ``COUNTED`` words; a batch with more is cut by rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        ends = np.cumsum(np.asarray(pc.list_value_length(batch["words"]).fill_null(0)))
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + COUNTED - size, side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - before)
            start = stop
            if size >= COUNTED or start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def batch_counts(lists: pa.ChunkedArray) -> pa.RecordBatch:
    """(term, cf, df) of the words of each list and of the pairs of neighbours in it."""
    counted = pa.Table.from_batches([word_counts(lists), pair_counts(lists)])
    return counted.combine_chunks().to_batches()[0] if counted.num_rows else word_counts(lists)


def word_counts(lists: pa.ChunkedArray) -> pa.RecordBatch:
    """(term, cf, df) of the words of each list."""
    names, code, owner = _coded(lists)
    word, cf, df = _key_counts(code, owner)
    return _counts_batch(names.take(pa.array(word)), cf, df)


def pair_counts(lists: pa.ChunkedArray, first: pa.Array | None = None, second: pa.Array | None = None) -> pa.RecordBatch:
    """(term, cf, df) of the pairs of neighbours in each list, those that begin and end with such words."""
    names, code, owner = _coded(lists)
    wanted = owner[1:] == owner[:-1]
    for words, end in ((first, code[:-1]), (second, code[1:])):
        if words is not None:
            wanted &= np.asarray(pc.is_in(names, value_set=words))[end] if len(names) else wanted
    width = max(len(names), 1)
    both, cf, df = _key_counts((code[:-1] * width + code[1:])[wanted], owner[1:][wanted])
    pairs = pc.binary_join_element_wise(names.take(pa.array(both // width)), names.take(pa.array(both % width)), " ")
    return _counts_batch(pairs, cf, df)


def _coded(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word of all lists in turn, and its list."""
    lists = lists.combine_chunks()
    coded = lists.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists).fill_null(0)))
    return coded.dictionary, np.asarray(coded.indices).astype(np.int64), owner


def _key_counts(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # Stable, so equal keys stay in the order of their chunks.
    order = np.argsort(keys, kind="stable")
    keys, of = keys[order], of[order]
    fresh = np.diff(keys, prepend=-1) != 0
    first = np.flatnonzero(fresh)
    another = fresh | (np.diff(of, prepend=-1) != 0)
    return keys[first], np.diff(first, append=len(keys)), np.add.reduceat(another, first, dtype=np.int64) if len(first) else first


def _counts_batch(terms: pa.Array, cf: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([terms, pa.array(cf, pa.int64()), pa.array(df, pa.int64())], ["term", "cf", "df"])


def ranked_terms(counts: DataFrame, n_chunks: int, max_features: int) -> DataFrame:
    """(idx, term, idf) of the ``max_features`` most frequent terms, from counts of one or more parts."""
    top = (
        counts.groupBy("term")
        .agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
        .orderBy(F.desc("cf"), "term")
        .limit(max_features)
    )
    # At most max_features rows are left to number.
    place = F.row_number().over(Window.orderBy(F.desc("cf"), "term")) - 1
    idf = F.log((1 + F.lit(n_chunks)) / (1 + F.col("df"))) + 1
    return top.select(place.alias("idx"), "term", idf.alias("idf"))


def cosine(queries: DataFrame, items: DataFrame, item_key: Sequence[str]) -> DataFrame:
    """Cosine of every query and item that share a term; pairs without a common term are 0."""
    found = matching.pairs(
        queries.select("qid", "vec"), items.select(*item_key, "vec"), item_key, {"vec": "vec"}, lambda f: {"sim": f.sim()}, sim="double"
    )
    return found.where("sim > 0")
