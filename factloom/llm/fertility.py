"""Quality rules by tokenizer fertility, after base rules on words, symbols and repeats.

Under a public vocabulary with byte fallback a text shows how far it is from what the vocabulary was made
for: characters per token, the share of tokens that stand for single bytes, and the entropy of its
tokens.  Each script has a band for all three; a text outside is rejected.  Characters per token are
high where a text is written without spaces or is one symbol over and over, low in strings of random
characters; the entropy, as a share of the most that so many tokens can have, is low where a text
repeats itself.  It falls with length as well, so its limit is a fixed one.

The bands of the other two come from the table: ``spread`` times the distance of the quartiles from the
median, to both sides, over the different texts of a script that pass the base rules, so groups of copies
count once.  Quartiles are exact on a grid of 1/200, from one histogram per script, and the distance is at
least a tenth of the median, so a table of a few texts has bands too.  ``Rules.bands`` are outer limits
that hold however much noise a table has.  Texts of fewer than ``least_tokens`` tokens are too short to
tell and pass; longer texts without any letter or mark have no band and are rejected.  What still passes:
noise made of real words, and noise in short texts.

Tokens are those of the words of a text, each distinct word of a batch being encoded once.  Texts are
read once; their measures are staged, since bands and verdicts both read them.

Null and empty texts have no words and fail the base rules.  Repeated rows are judged each by itself, ties
at a limit are inside, an empty table gives no rows, extra columns are not read, and texts of any length
are measured whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import own, tidy
from factloom.llm.scripts import NAMES, dominant
from factloom.llm.tokens import BATCH, by_bytes, vocabulary
from factloom.llm.wordhash import numbers, scrambled
from factloom.session import stage

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_STEP = numbers(1, 11)[0] | np.uint64(1)
GRID = 200  # steps of a unit in which quartiles are taken
MOST = 64  # characters per token that histograms tell apart
REMEMBERED = 400_000  # words kept in a worker at most; then the memory starts anew


@dataclass(frozen=True)
class Band:
    """Outer limits of characters per token, byte share and relative token entropy, ends included."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float


LETTERS = Band(1.2, 8.0, 0.20, 0.35)
LATIN = Band(1.6, 8.0, 0.20, 0.35)  # random letters lie at 1.59
SYLLABLES = Band(0.3, 4.0, 0.90, 0.35)  # scripts of which the vocabulary has few pieces


@dataclass(frozen=True)
class Rules:
    vocabulary: str = "piece_bpe_32k.model"
    bands: dict[str, Band] = field(default_factory=lambda: {"Latin": LATIN, "Cyrillic": LETTERS, "Greek": Band(0.6, 8.0, 0.35, 0.35)})
    other: Band = SYLLABLES
    spread: float = 2.0
    least_distance: float = 0.1  # of the quartiles, as a share of the median
    least_bytes: float = 0.05  # the same for byte shares
    least_words: int = 20
    most_repeat_percent: int = 30
    least_tokens: int = 64


class PieceCounter:
    """Token ids of words by a sentencepiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.known: dict[str, bytes] = {}

    def encode_all(self, texts: list[list[str]]) -> Iterator[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list(set().union(*texts).difference(self.known))
        coded = self.model.encode(new, num_threads=1) if new else []
        self.known.update((w, array("I", ids).tobytes()) for w, ids in zip(new, coded))
        for words in texts:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.uint32)


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside ``window``-word stretches that occur twice or more, first ones included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    code = scrambled(np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64))
    if len(ids) == len(words):
        return 0
    total = code[:n].copy()
    for step in range(1, window):
        total = total * _STEP + code[step : n + step]
    order = np.argsort(total, kind="stable")
    same = total[order[1:]] == total[order[:-1]]
    if not same.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    edge[:n] += again
    edge[window : window + n] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return len(lines) - len(set(lines))


def measures(ids: np.ndarray, n_chars: int, is_byte: np.ndarray) -> tuple[float, float, float]:
    """Characters per token, share of byte tokens, entropy as a share of log2(tokens)."""
    n = len(ids)
    if n < 2:
        return float(n_chars) / max(n, 1), 0.0, 1.0
    counts = np.unique(ids, return_counts=True)[1]
    entropy = float(np.log2(n) - (counts * np.log2(counts)).sum() / n)
    return n_chars / n, float(is_byte[ids].mean()), entropy / float(np.log2(n))


def measured(df: DataFrame, rules: Rules, doc_id: str, text: str) -> DataFrame:
    """doc_id, a digest of the text, base counts, base_failed, n_tokens, script and measures of every row."""
    kinds = pa.schema(
        [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64())]
        + [("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("n_tokens", pa.int64()), ("script", pa.string())]
        + [("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(vocabulary(rules.vocabulary))
        for batch in batches:
            out = []
            for portion in by_bytes((t or "" for t in batch["text"].to_pylist()), BATCH):
                words_of = [_WORD.findall(t) for t in portion]
                for body, words, ids in zip(portion, words_of, pieces.encode_all(words_of)):
                    n, n_chars, repeats = len(words), sum(map(len, words)), repeated_words(words)
                    failed = n < rules.least_words or 100 * repeats > rules.most_repeat_percent * n
                    counts = (n, n_chars, sum(map(body.count, SYMBOLS)), duplicate_lines(body), repeats, failed)
                    out.append((*counts, len(ids), dominant(body), *measures(ids, n_chars, pieces.is_byte)))
            arrays = [pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["digest"], *arrays], ["doc_id", "digest", *kinds.names])

    rows = own(df, doc_id=doc_id, text=text).withColumn("digest", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string", pa.float64(): "double"}
    schema = [f"doc_id {kind}", "digest long", *(f"{f.name} {names[f.type]}" for f in kinds)]
    return rows.mapInArrow(tidy(run), ", ".join(schema))


def quartiles(rows: DataFrame) -> DataFrame:
    """One row per script: low, middle and high quartile of characters per token and byte share, in grid steps."""
    texts = rows.groupBy("script", "digest").agg(F.max("chars_per_token").alias("chars"), F.max("byte_share").alias("bytes"))
    # Bins are bounded, so the histogram is, whatever the table.
    steps = [
        F.struct(F.lit(name).alias("measure"), F.floor(F.least(F.col(name), F.lit(MOST)) * GRID).alias("bin"))
        for name in ("chars", "bytes")
    ]
    histogram = texts.select("script", F.explode(F.array(*steps)).alias("at")).groupBy("script", "at.measure", "at.bin").count()
    own_bins = Window.partitionBy("script", "measure")
    shared = histogram.select(
        "script", "measure", "bin", F.sum("count").over(own_bins.orderBy("bin")).alias("reached"), F.sum("count").over(own_bins).alias("total")
    )

    def quartile(name: str, k: int) -> Column:
        inside = (F.col("measure") == name) & (4 * F.col("reached") >= k * F.col("total"))
        return F.min(F.when(inside, F.col("bin")))

    return shared.groupBy("script").agg(*(quartile(name, k).alias(f"{name}_{k}") for name in ("chars", "bytes") for k in (1, 2, 3)))


def bands(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per script with letters: the limits of its band, from ``measured`` rows and the outer limits."""
    told = rows.where(~F.col("base_failed") & (F.col("n_tokens") >= rules.least_tokens) & (F.col("script") != "none"))
    outer = [(name, *vars(rules.bands.get(name, rules.other)).values()) for name in NAMES if name != "none"]
    limits = "script string, least_chars double, most_chars double, most_bytes double, least_entropy double"
    found = rows.sparkSession.createDataFrame(outer, limits).join(quartiles(told), "script", "left")

    def distance(name: str, least: Column) -> Column:
        low, middle, high = (F.col(f"{name}_{k}") for k in (1, 2, 3))
        return rules.spread * F.greatest(middle - low, high - middle, least) / GRID

    # A value lies up to one step above its bin.  Scripts without texts have the outer limits; nothing asks for them.
    chars = distance("chars", rules.least_distance * F.col("chars_2"))
    shares = distance("bytes", F.lit(rules.least_bytes * GRID))
    return found.select(
        "script",
        F.greatest("least_chars", F.col("chars_2") / GRID - chars).alias("least_chars"),
        F.least("most_chars", (F.col("chars_2") + 1) / GRID + chars).alias("most_chars"),
        F.least("most_bytes", (F.col("bytes_2") + 1) / GRID + shares).alias("most_bytes"),
        "least_entropy",
    )


def judge(df: DataFrame, rules: Rules = Rules(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, base_failed, kept, and the script and measures that decided, for every row."""
    rows = stage(measured(df, rules, doc_id, text), "fertility-measures")
    limits = stage(bands(rows, rules), "fertility-bands")
    inside = (
        F.col("chars_per_token").between(F.col("least_chars"), F.col("most_chars"))
        & (F.col("byte_share") <= F.col("most_bytes"))
        & (F.col("token_entropy") >= F.col("least_entropy"))
    )
    passed = (F.col("n_tokens") < rules.least_tokens) | F.coalesce(inside, F.lit(False))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    # One row per script, of which there are less than 20.
    return rows.join(F.broadcast(limits), "script", "left").select(
        *base, (~F.col("base_failed") & passed).alias("kept"), "script", "n_tokens", "chars_per_token", "byte_share", "token_entropy"
    )
