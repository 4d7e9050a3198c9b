"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every hash of a five-word shingle below a fixed fraction of the hash range, 2 ** -bits, so
its size grows with the text, sketches of very unequal texts hold the same shingles of a common passage,
and the sketch of a union is made from two sketches alone.  A set of fewer than ``KEEP_ALL`` shingles is
kept whole.  A sketch is one array: the bits of its own fraction (0: whole), then the hashes in order.

Two sketches are compared below the lower of their bounds.  With m hashes of the smaller one there, a
containment c has a standard error of about sqrt(c * (1 - c) * (1 - 2 ** -bits) / m): at a fraction of 1/4
at most 0.11 at m = 16, 0.04 at m = 100.  Whole sets are compared exactly; only two shingles of one 60-bit
hash are taken for the same.  Fewer than ``SURE`` hashes below the common bound tell nothing (null):
a short excerpt against a long text.  ``fingerprint_edits``, which has the texts, then compares their whole
sets, so no likeness rests on less than ``SURE`` hashes.

Texts of less than five words are one shingle and so contained in no longer text, texts without a word
have an empty sketch; two empty sketches are alike (1), an empty one and another are not (0).

Everything runs in the row, on the JVM; a text is dealt once, with its sketch, to find neighbours.  The
neighbour is found by range blocks of the id: block bounds are quantiles of the ids (as many numbers as
there are blocks go through the driver), the first row of a block is also handed to the block before it,
and the rest is ``lead`` in a block.  Ids may be integers or strings; strings are dealt by the seven bytes
behind what all ids begin with.  Null ids come last, ties of ids are ordered by text.
"""

from __future__ import annotations

from collections.abc import Callable
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.rows import once
from factloom.llm.common import GAP, own, partitions

SHINGLE = 5
FRACTION_BITS = 2  # of the query: hashes below 2 ** -2 of the range
KEEP_ALL = 128  # smaller sets are kept whole
SURE = 16  # hashes below the common bound that a likeness needs
BLOCKS = 4  # for each shuffle partition


def hashes(text: Column, k: int = SHINGLE) -> Column:
    """Hashes of the k-word shingles of a lower-cased text, with repeats; shorter texts are one."""
    words = F.array_remove(F.split(F.lower(text), GAP), "")
    return F.transform(
        F.array(words),
        lambda w: F.transform(
            F.slice(w, 1, F.greatest(F.size(w) - (k - 1), F.lit(1))),
            lambda first, i: F.xxhash64(first, *(F.get(w, i + step) for step in range(1, k))),
        ),
    )[0]


def _below(items: Column, bits: Column) -> Column:
    """The hashes below the bound of so many bits."""
    return F.filter(items, lambda x: F.call_function("shiftrightunsigned", x, F.lit(60) - bits.cast("int")) == 0)


def _own(a: Column) -> Column:
    return F.slice(a, 2, F.size(a))


def _marked(items: Column, bits: int) -> Column:
    """A sketch of distinct hashes, all of which are below the bound or belong to a whole set."""
    level = F.array(F.lit(bits).cast("bigint"))
    return F.concat(level, F.sort_array(items))


def sketch(text: Column, bits: int = 0, k: int = SHINGLE) -> Column:
    """Sketch of a text; bits 0 keeps every shingle."""
    distinct = F.array_distinct(F.transform(hashes(text, k), lambda h: F.shiftrightunsigned(h, 4)))
    if bits == 0:
        return _marked(distinct, 0)
    return F.transform(
        F.array(distinct),
        lambda h: F.when(F.size(h) < KEEP_ALL, _marked(h, 0)).otherwise(_marked(_below(h, F.lit(bits)), bits)),
    )[0]


def merged(a: Column, b: Column, bits: int = 0) -> Column:
    """Sketch of the union of the shingle sets of two sketches of texts made with the same ``bits``."""
    both = F.array_union(_own(a), _own(b))
    if bits == 0:
        return _marked(both, 0)
    whole = (a[0] == 0) & (b[0] == 0) & (F.size(both) < KEEP_ALL)
    return F.when(whole, _marked(both, 0)).otherwise(_marked(_below(both, F.lit(bits)), bits))


def _compared(a: Column, b: Column, share: Callable[[Column, Column, Column], Column]) -> Column:
    """``share`` of (size of a, size of b, common) below the lower bound; null if that tells too little."""

    def lowered(s: Column) -> Column:
        bits = F.greatest(s["a"][0], s["b"][0])
        x, y = (F.when(s[i][0] == bits, _own(s[i])).otherwise(_below(_own(s[i]), bits)) for i in "ab")
        one_empty = (F.size(s["a"]) == 1) | (F.size(s["b"]) == 1)
        both_empty = F.size(s["a"]) == F.size(s["b"])
        alike = F.when(one_empty, both_empty.cast("double"))
        return F.struct(x.alias("a"), y.alias("b"), (bits == 0).alias("whole"), alike.alias("empty"))

    def sizes(s: Column) -> Column:
        both = F.size(F.array_intersect(s["a"], s["b"]))
        return F.struct(F.size(s["a"]).alias("a"), F.size(s["b"]).alias("b"), both.alias("both"), s["whole"].alias("whole"), s["empty"].alias("empty"))

    def told(s: Column) -> Column:
        enough = s["whole"] | (F.least(s["a"], s["b"]) >= SURE)
        return F.when(s["empty"].isNotNull(), s["empty"]).when(enough, share(s["a"], s["b"], s["both"]))

    pair = F.array(F.struct(a.alias("a"), b.alias("b")))
    return F.transform(F.transform(F.transform(pair, lowered), sizes), told)[0]


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set found in the other, from 0 to 1; null if the sketches can't tell."""
    return _compared(a, b, lambda x, y, both: both / F.least(x, y))


def resemblance(a: Column, b: Column) -> Column:
    """Jaccard likeness, from 0 to 1; null if the sketches can't tell."""
    return _compared(a, b, lambda x, y, both: both / (x + y - both))


def as_text(a: Column) -> Column:
    """A sketch as one string: the bits of its fraction as a digit, then 15 hexadecimal digits per hash."""
    return F.lower(F.concat(F.hex(a[0]), F.concat_ws("", F.transform(_own(a), lambda x: F.lpad(F.hex(x), 15, "0")))))


def _place(keys: DataFrame, key: str) -> Column:
    """A number that grows with the key, to deal by: integers themselves, of strings the bytes that differ."""
    kind = keys.schema[key].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(key).cast("bigint")
    if kind != "string":
        raise TypeError(f"ids have to be integers or strings, not {kind}")
    ends = keys.agg(F.min(key).cast("binary"), F.max(key).cast("binary")).first()
    skip = len(commonprefix([bytes(x) for x in ends if x is not None]))
    tail = F.substring(F.hex(F.col(key).cast("binary")), 2 * skip + 1, 14)
    return F.conv(F.rpad(tail, 14, "0"), 16, 10).cast("bigint")


def with_next(df: DataFrame, keys: DataFrame, key: str, values: dict[str, str], tie: str) -> DataFrame:
    """Each row with values of the row after it in descending order of ``key``; the first follows the last.

    ``keys`` has the same keys as ``df``, without what is costly to compute.
    """
    spark = df.sparkSession
    blocks = BLOCKS * partitions(spark)
    place = _place(keys, key)
    shares = [i / blocks for i in range(1, blocks + 1)]
    bounds = keys.select(place.alias("at")).agg(F.percentile_approx("at", F.array(*map(F.lit, shares)), 10000)).first()[0] or []
    top = bounds[-1] if bounds else None  # the greatest key: block 0 starts there
    firsts = sorted(set(bounds), reverse=True)
    last = max(len(firsts) - 1, 0)
    step = max(1, int(len(firsts) ** 0.5))

    # Block of a key: how many bounds are >= it, less one; coarse bounds first, then the fine ones between.
    def at_least(items: list, x: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, items)).cast("array<bigint>"), lambda b: b >= x))

    coarse = at_least(firsts[::step], place) - 1 if firsts else F.lit(0)
    groups = [firsts[i : i + step] for i in range(0, len(firsts), step)]
    fine = (
        F.size(
            F.filter(
                F.element_at(F.array(*(F.array(*map(F.lit, g)) for g in groups)).cast("array<array<bigint>>"), F.greatest(coarse, F.lit(0)) + 1),
                lambda b: b >= place,
            )
        )
        if firsts
        else F.lit(1)
    )
    block = F.when(F.col(key).isNull(), last).otherwise(F.greatest(coarse * step + fine - 1, F.lit(0)))
    is_first = place.isin(firsts) if len(firsts) < 100 else F.array_contains(F.array(*map(F.lit, firsts)).cast("array<bigint>"), place)
    own_place = F.struct(block.alias("block"), F.lit(0).alias("guest"))
    before = F.struct(F.when(place == F.lit(top), last).otherwise(block - 1).alias("block"), F.lit(1).alias("guest"))
    lone = top is None  # only null keys: the smallest text is the first
    places = F.array(own_place) if lone else F.when(is_first, F.array(own_place, before)).otherwise(F.array(own_place))
    dealt = df.withColumn("_place", F.explode(places))
    # Guests of a block are the first rows of the next one: all of one key, in the same order as there.
    order = W.partitionBy("_place.block").orderBy(F.col("_place.guest"), F.col(key).desc_nulls_last(), F.col(tie))
    led = dealt.withColumns({name: F.lead(source).over(order) for name, source in values.items()})
    return led.where("_place.guest = 0").drop("_place")


def fingerprint_edits(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = FRACTION_BITS) -> DataFrame:
    """Fingerprints of whole texts and of texts whose last third is the start of the next document.

    Likeness is containment; ``jaccard_edited`` and ``jaccard_next`` have the Jaccard values.  Null texts are
    empty ones; repeated rows are rows of their own; other columns are not looked at.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = own(df, doc_id=doc_id, text=text).select("doc_id", body.alias("text"))
    keys = rows.select("doc_id")
    rows = once(rows, "sketch", sketch(F.col("text"), bits))
    rows = with_next(rows, keys, "doc_id", {"next_text": "text", "next_sketch": "sketch"}, "text")
    # A lone document is its own next one.
    rows = rows.withColumns(
        {
            "n_chars": F.char_length("text").cast("long"),
            "next_text": F.coalesce("next_text", "text"),
            "next_sketch": F.coalesce("next_sketch", "sketch"),
        }
    )
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third),
        F.substring(F.col("next_text"), F.lit(1), third),
    )
    rows = once(rows, "edited", edited)
    rows = once(rows, "edited_sketch", sketch(F.col("edited"), bits))

    def likeness(measure: Callable[[Column, Column], Column], other: str) -> Column:
        told = measure(F.col("sketch"), F.col(f"{other}_sketch"))
        whole = measure(sketch(F.col("text")), sketch(F.col("edited" if other == "edited" else "next_text")))
        return F.coalesce(told, whole)

    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(containment, "edited").alias("near_edited"),
        likeness(containment, "next").alias("near_next"),
        likeness(resemblance, "edited").alias("jaccard_edited"),
        likeness(resemblance, "next").alias("jaccard_next"),
    )
