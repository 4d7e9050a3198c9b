"""Language identification: scripts narrow the candidates, a best path over words labels spans.

The model holds, for each language, how often code point trigrams and 4-grams of lower-cased words
fall into hashed slots, and which scripts its letters are of.  A word's score under a language is the sum of log
shares over its grams, relative to the best language that uses the word's script, and not below
``floor``.  The labels of the words of a text are the best path under these scores, with a penalty for each
switch of language, so single odd words do not break a span and longer passages in another language do.  The language of a text is that of most letters by these labels, its score their share.

Fitting counts grams on a bounded sample of labelled rows, in Spark; at most 2 ** 16 slots per language go
through the driver and out to the workers.  Labelling runs in the row, without a shuffle.

Null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing was learnt.
Ties go to the language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from factloom.llm.common import own, ship, tidy
from factloom.llm.scripts import NAMES, code_points, tables

BITS = 15  # slots per gram length: 2 ** BITS
GRAMS = 2
TRAIN_ROWS = 20_000  # labelled texts to learn from, about
BLOCK = 1 << 19  # characters scored at once
ROWS = 2_048  # rows of a batch labelled at once
OPEN_WORDS = 1 << 17  # words of texts that may be mixed whose scores are held at once, about
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # (slots of all gram lengths, languages): log shares
    uses: np.ndarray  # (scripts, languages): whether the language is written in the script
    switch: float = 8.0
    floor: float = -6.0


def _slots(points: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigram around and the 4-gram from before each letter; other characters are blanks."""
    c = np.where(letter, points, 32).astype(np.uint32)
    blank = np.full(2, 32, np.uint32)
    c = np.concatenate([blank[:1], c, blank])
    n = len(points)
    with np.errstate(over="ignore"):
        three = (c[:n] * np.uint32(0x9E3779B1) + c[1 : n + 1]) * np.uint32(0x85EBCA6B) + c[2 : n + 2]
        four = three * np.uint32(0xC2B2AE35) + c[3 : n + 3]
        three = (three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        four = (four ^ (four >> np.uint32(15))) * np.uint32(0x297A2D39)
    down = np.uint32(32 - BITS)
    return three >> down, (four >> down) + np.uint32(1 << BITS)


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for text in texts:
        if held and size + len(text) > BLOCK:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield held


def _words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Code points, which are letters, starts and ends of words, and the word at which each text ends."""
    points = code_points("\n".join([*texts, ""]).lower())
    letter = tables()[0][points] > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]])))
    starts, ends = edges[0::2], edges[1::2]
    lengths = np.array([len(t) if t.isascii() else len(t.lower()) for t in texts])
    return points, letter, starts, ends, np.searchsorted(starts, np.cumsum(lengths + 1))


def fit(train: DataFrame, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Learn from about ``rows`` different texts with a language, as many of each language; from all of a rare one.

    A text is taken if its hash is below a bound that depends on how many texts its language has; the
    bound is never below the least hash of the language, so a language with a text is learnt however many
    rows there are.  Copies of a text count once.
    """
    labelled = own(train, text=text, lang=lang).where("text is not null and lang is not null")
    hashed = labelled.withColumn("hash", F.shiftrightunsigned(F.xxhash64("text"), 1))
    known = hashed.groupBy("lang").agg(F.approx_count_distinct("hash").alias("texts"), F.min("hash").alias("least")).collect()
    each = max(1, rows // max(1, len(known)))
    bounds = [x for k in known for x in (F.lit(k["lang"]), F.lit(max(k["least"], int((1 << 63) * min(1.0, each / max(1, k["texts"]))) - 1)))]
    sample = labelled.limit(0)
    if known:
        bound = F.element_at(F.create_map(*bounds), F.col("lang"))
        sample = hashed.where(F.col("hash") <= bound).select("text", "lang").dropDuplicates()
    # Few enough rows for few tasks, each of which hands on one number per language and slot.
    sample = sample.repartition(8)
    width = GRAMS << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in _slices(batches):
            by_lang: dict[str, list[str]] = {}
            for body, name in zip(batch["text"].to_pylist(), batch["lang"].to_pylist()):
                by_lang.setdefault(name, []).append(body)
            for name, bodies in by_lang.items():
                held = sums.setdefault(name, np.zeros(width + len(NAMES), np.int64))
                for block in _blocks(bodies):
                    points, letter, *_ = _words(block)
                    for slots in _slots(points, letter):
                        held += np.bincount(slots[letter], minlength=len(held))
                    held[width:] += np.bincount(tables()[0][points[letter]], minlength=len(NAMES))
        for name, held in sums.items():
            slots = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(slots), pa.string()), pa.array(slots, pa.int64()), pa.array(held[slots])], ["lang", "slot", "n"]
            )

    counted = sample.mapInArrow(tidy(count), "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names, slots, n = (counted[c].to_numpy() for c in ("lang", "slot", "n"))
    languages = sorted(set(names.tolist()))
    counts = np.zeros((width + len(NAMES), len(languages)))
    counts[slots, np.searchsorted(languages, names.astype(str)) if languages else []] = n
    weights = np.zeros((width, len(languages)), np.float32)
    for at in range(0, width, 1 << BITS):
        part = counts[at : at + (1 << BITS)] + 0.1
        weights[at : at + (1 << BITS)] = np.log(part / part.sum(axis=0))
    letters = counts[width:]
    return Model(languages, weights, letters >= 0.01 * letters.sum(axis=0))


def word_scores(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores (word, language), letters of each word, and the word at which each text ends."""
    points, letter, starts, ends, stops = _words(texts)
    if not len(starts) or not model.languages:
        return np.zeros((len(starts), len(model.languages))), ends - starts, stops
    at = np.flatnonzero(letter)
    three, four = _slots(points, letter)
    each = np.take(model.weights, three[at], axis=0) + np.take(model.weights, four[at], axis=0)
    lengths = ends - starts
    sums = np.add.reduceat(each, np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0).astype(np.float64)
    uses = model.uses | ~model.uses.any(axis=1, keepdims=True)  # a script nobody was learnt with tells nothing
    if not uses[1:].all():
        sums += np.take(np.where(uses, 0.0, -np.inf), tables()[0][points[starts]], axis=0)
    return np.maximum(sums - sums.max(axis=1)[:, None], model.floor), lengths, stops


def one_label(scores: np.ndarray, stops: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray]:
    """The best single label of each text with words, and whether a path with switches may beat it."""
    n = len(scores)
    firsts = np.concatenate([[0], stops[:-1]])
    some = np.flatnonzero(stops > firsts)
    label, mixed = np.zeros(len(stops), np.int64), np.zeros(len(stops), bool)
    if scores.shape[1] < 2 or not len(some):
        return label, mixed
    label[some] = np.add.reduceat(scores, firsts[some], axis=0).argmax(axis=1)
    text = np.repeat(np.arange(len(some)), (stops - firsts)[some])
    path, rows = label[some][text], np.arange(n)
    # No run of words gains more under other labels than one switch costs: then one label is best.
    others = scores.copy()
    others[rows, path] = -np.inf
    run = np.cumsum(others.max(axis=1) - scores[rows, path])
    before = np.concatenate([[0.0], run[:-1]])
    fall = 4.0 * (np.abs(run).max() + 1.0)  # starts the running minimum anew in each text
    lowest = np.minimum.accumulate(before - fall * text) + fall * text
    mixed[some] = np.maximum.reduceat(run - lowest, firsts[some]) > switch
    return label, mixed


def best_paths(texts: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """Labels of the words on each text's best path, all texts a word at a time."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    size = np.array([len(texts[i]) for i in order], np.int64)
    if not len(size) or not size[0]:
        return [np.zeros(0, np.int64) for _ in texts]
    scores = np.concatenate([texts[i] for i in order])
    first = np.cumsum(size) - size
    n, width = scores.shape
    path, back = np.zeros(n, np.int64), np.zeros((n, width), np.int16)
    value = np.zeros((len(order), width))
    own_label = np.arange(width)
    alive = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts with more than t words
    for t in range(size[0]):
        k = alive[t]
        held, at = value[:k], first[:k] + t
        top = held.argmax(axis=1)
        moved = (held.max(axis=1) - switch)[:, None]
        back[at] = np.where(moved > held, top[:, None], own_label)
        value[:k] = np.maximum(held, moved) + scores[at]
    state = value.argmax(axis=1)
    for t in range(size[0] - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        path[at] = state[:k]
        state[:k] = back[at, state[:k]]
    found: list[np.ndarray] = [path] * len(texts)
    for i, a, b in zip(order, first, first + size):
        found[i] = path[a:b]
    return found


def label(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[list[tuple[int, str]]]]:
    """Language and score of each text, and its spans as (number of words, language)."""
    names, shares, spans = [], [], []
    is_letter = tables()[1]
    open_: list[tuple[int, np.ndarray, np.ndarray]] = []  # texts that may be mixed: place, scores, letters

    def settle() -> None:
        for (i, _, lengths), labels in zip(open_, best_paths([s for _, s, _ in open_], model.switch)):
            votes = np.bincount(labels, weights=lengths, minlength=len(model.languages))
            best = int(votes.argmax())
            names[i], shares[i] = model.languages[best], float(votes[best] / votes.sum())
            cuts = np.concatenate([[0], np.flatnonzero(labels[1:] != labels[:-1]) + 1, [len(labels)]])
            spans[i] = [(int(b - a), model.languages[labels[a]]) for a, b in zip(cuts[:-1], cuts[1:])]
        open_.clear()

    for block in _blocks([t or "" for t in texts]):
        scores, lengths, stops = word_scores(model, block)
        single, mixed = one_label(scores, stops, model.switch)
        at = 0
        for body, stop, best, several in zip(block, stops.tolist(), single.tolist(), mixed.tolist()):
            lettered = any(map(str.isalpha, body[:64])) or (stop > at and is_letter[code_points(body)].any())
            if not (lettered and model.languages):
                names.append(UNKNOWN)
                shares.append(0.0)
                spans.append([])
            else:
                if several:
                    open_.append((len(names), scores[at:stop].copy(), lengths[at:stop]))
                names.append(model.languages[best])
                shares.append(1.0)
                spans.append([(stop - at, model.languages[best])])
            at = stop
        # Scores are held for some texts at a time, however many a batch has.
        if sum(len(held) for _, held, _ in open_) >= OPEN_WORDS:
            settle()
    settle()
    return names, shares, spans


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a bounded number of rows, so a large batch is not held as lists."""
    return (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS))


def identify(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and spans (words, lang) for every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("words", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            names, shares, spans = label(shared.value, batch["text"].to_pylist())
            listed = [[{"words": n, "lang": name} for n, name in s] for s in spans]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(listed, span)],
                ["doc_id", "lang_pred", "score", "spans"],
            )

    rows = own(df, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double, spans array<struct<words:bigint,lang:string>>")


def with_language(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``row``, the rows of ``df`` as one column, so no name of theirs can clash, with lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text)
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = pc.struct_field(batch["row"], place)
            names, shares, _ = label(shared.value, texts.to_pylist())
            added = [pa.array(names, pa.string()), pa.array(shares, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch["row"], *added], ["row", "lang_pred", "score"])

    rows = df.select(F.struct("*").alias("row"))  # the text is in it, and travels once
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]
    return rows.mapInArrow(tidy(run), StructType([rows.schema["row"], *added]))
