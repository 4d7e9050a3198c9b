"""Near duplicates by an inverted join of signature coordinates, confirmed on full shingle sets.

Every text has a set of word shingles and a signature of ``coordinates`` minima.  Texts of equal sets are
one class.  Classes are posted under (coordinate, value); a pair that is to be a candidate must agree in
at least ``least`` coordinates.  So only values that two classes share matter (a first count), classes
with fewer than ``least`` of them drop out, and of the rest only a prefix is posted: any two classes
that agree in ``least`` of the coordinates share one of the ``coordinates - least + 1`` rarest.

Posting lists are not expanded into all pairs.  The class whose values are most common leads each of
its lists; the others are held against the leader, and confirmed links make components.  Then, in
lists whose classes still lie in several components, classes of different ones are paired by their
rarest shingles, with a bound on what two sets can share that leaves few of them.  Two classes of one
component need no further link, so the components are those of all confirmed pairs.  Collisions are
counted on the signatures before the texts of a leader's pair are fetched; a pair counts as a link if its
full sets meet the threshold.

The bar follows the threshold: as many coordinates as a pair that just meets it misses in at most ``LOSS``
of all cases.  Of 64 that is 40 at 0.85 (loss 2.4e-6) and 35 at 0.80 (1.2e-6); pairs more alike lose less.

Joins on hot values are equi-joins without grouping above them, which the adaptive planner splits.
Null or wordless texts have an empty set, no class and no links.  Equal rows share a class.  Of null
ids nothing is the smallest; a component without any id has null.  Extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import own, shuffled, tidy
from factloom.llm.wordhash import numbers, shingle_set, word_hashes
from factloom.session import stage

SHINGLE = 5
COORDINATES = 64
LOSS = 2.5e-6
PERCENT = 80  # of stages
PERCENT_LABELLED = 85  # of the labels of near_duplicates, as op7 has to give them


def least_agreeing(percent: int, coordinates: int = COORDINATES, loss: float = LOSS) -> int:
    """The most coordinates that a pair of likeness ``percent`` fails to agree in with a chance of at most ``loss``."""
    p, below = percent / 100, 0.0
    for n in range(coordinates):
        below += comb(coordinates, n) * p**n * (1 - p) ** (coordinates - n)
        if below > loss:
            return max(n, 1)
    return coordinates


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    raw = (x.lower() if x else b"" for x in texts.cast(pa.binary()).to_pylist())
    return (shingle_set(words, k) for words in word_hashes(raw))


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """Minimum of each of ``coordinates`` scrambled orders of the upper halves of the hashes."""
    seeds = numbers(2 * coordinates, 7).astype(np.uint32)
    flip, odd = seeds[:coordinates, None], seeds[coordinates:, None] | np.uint32(1)
    low = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        x = (short[None, at : at + 2048] ^ flip) * odd
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        low = np.minimum(low, x.min(axis=1))
    return low


def digests(df: DataFrame, doc_id: str, text: str, k: int, coordinates: int) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, set_key (digest of the set) and sig (the signature) of every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys, sigs = [], [], []
            for found in _sets(batch["text"], k):
                counts.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sigs.append(signature(found, coordinates).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_key"], pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "set_key", "sig"],
            )

    rows = own(df, doc_id=doc_id, text=text).withColumn("text_key", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(digest), f"doc_id {kind}, text_key long, n_shingles long, set_key binary, sig binary")


def _exploded(classes: DataFrame, coordinates: int) -> DataFrame:
    """(cls, key) per coordinate: the number of the coordinate above the value."""
    word = F.expr("conv(substring(hex(sig), 8 * at + 1, 8), 16, 10)").cast("long")
    return classes.select("cls", F.explode(F.sequence(F.lit(0), F.lit(coordinates - 1))).alias("at"), "sig").select(
        "cls", (F.shiftleft(F.col("at").cast("long"), 32) + word).alias("key")
    )


def postings(classes: DataFrame, coordinates: int, least: int) -> DataFrame:
    """(key, cls, pop): each class under its rarest shared values, with how common its values are."""
    features = _exploded(classes, coordinates)
    shared = features.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    mine = (
        features.join(shuffled(shared), "key")
        .groupBy("cls")
        .agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("held"), F.sum("n").alias("pop"))
    )
    # Unshared values are the rarest and fill the prefix first, so that many fewer are posted.
    width = F.size("held") - (least - 1)
    return mine.where(F.size("held") >= least).select(
        F.explode(F.slice("held", F.lit(1), width)).alias("item"), "cls", "pop"
    ).select(F.col("item.key").alias("key"), "cls", "pop")


def _agreeing(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least ``least`` coordinates."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("a_sig", "b_sig"))
            kept = (a == b).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(kept)), batch["b"].filter(pa.array(kept))], ["a", "b"])

    side = shuffled(classes.select("cls", "sig"))
    wide = pairs.join(side.select(F.col("cls").alias("a"), F.col("sig").alias("a_sig")), "a").join(
        side.select(F.col("cls").alias("b"), F.col("sig").alias("b_sig")), "b"
    )
    return wide.select("a", "b", "a_sig", "b_sig").mapInArrow(tidy(count), "a long, b long")


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets meet the threshold."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, last, held = [], None, np.zeros(0, np.uint64)
            a, b = batch["a_text"].cast(pa.binary()).to_pylist(), batch["b_text"].cast(pa.binary()).to_pylist()
            fresh = word_hashes(x.lower() for x in b)
            for left, words in zip(a, fresh):
                if left != last:
                    last, held = left, shingle_set(next(word_hashes([left.lower()])), k)
                right = shingle_set(words, k)
                both = np.sort(np.concatenate([held, right]))
                common = int((both[1:] == both[:-1]).sum())
                kept.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays(
                [batch["a"].filter(pa.array(kept, pa.bool_())), batch["b"].filter(pa.array(kept, pa.bool_()))], ["a", "b"]
            )

    side = shuffled(texts.select("cls", "text"))
    wide = pairs.join(side.select(F.col("cls").alias("b"), F.col("text").alias("b_text")), "b").join(
        side.select(F.col("cls").alias("a"), F.col("text").alias("a_text")), "a"
    )
    return wide.select("a", "b", "a_text", "b_text").mapInArrow(tidy(confirm), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(cls, comp) for every end of a link (a, b): comp is the smallest class reachable.

    Rounds of two steps on the edges, until nothing changes: every node hands its greater neighbours to its
    smallest neighbour, then its smaller ones.  Each round is written to the shared folder.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        # Towards greater neighbours: each node tells those above it its smallest neighbour.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(shuffled(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Towards smaller ones: each node and its smaller neighbours point to the smallest.
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(shuffled(lowest), "a")
            .select(F.explode(F.array("a", "b")).alias("a"), F.col("low").alias("b"))
            .where("a > b")
            .distinct()
        )
        after = stage(small, "links")
        changed = any(x.join(shuffled(y), ["a", "b"], "left_anti").limit(1).count() for x, y in ((after, edges), (edges, after)))
        edges = after
        if not changed:
            break
    return edges.select(F.col("a").alias("cls"), F.col("b").alias("comp")).union(
        edges.select(F.col("b").alias("cls"), F.col("b").alias("comp")).distinct()
    )


def near_duplicates(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    k: int = SHINGLE,
    percent: int = PERCENT_LABELLED,
    coordinates: int = COORDINATES,
    least: int | None = None,
) -> DataFrame:
    """doc_id, text_key, n_shingles, set_key, comp (number of the component), component_id and kept for every row.

    Without ``least`` it follows from ``percent`` by :func:`least_agreeing`.
    """
    least = least_agreeing(percent, coordinates) if least is None else least
    docs = stage(digests(df, doc_id, text, k, coordinates), "near-digests")
    found = docs.where("set_key is not null")
    classes = found.groupBy("set_key").agg(
        F.min("doc_id").alias("head"), F.max(F.struct("doc_id", "text_key")).alias("shown"), F.first("sig").alias("sig")
    )
    classes = stage(classes.withColumn("cls", F.monotonically_increasing_id()), "near-classes")
    posted = stage(postings(classes, coordinates, least), "near-postings")

    leaders = posted.groupBy("key").agg(F.max(F.struct("pop", "cls")).alias("top"), F.count("*").alias("n")).where("n > 1")
    first = (
        posted.join(shuffled(leaders), "key")
        .where(F.col("cls") != F.col("top.cls"))
        .select(F.col("top.cls").alias("a"), F.col("cls").alias("b"))
        .distinct()
    )
    first = stage(_agreeing(first, classes, least), "near-first")
    texts = _texts(df, doc_id, text, classes, posted, leaders)
    links = stage(_linked(first, texts, k, percent), "near-links")
    comps = stage(components(links), "near-components")

    open_ = stage(_open(posted, leaders, comps), "near-open")
    rest = stage(_across(open_, texts, k, percent), "near-rest")
    more = stage(_linked(rest, texts, k, percent), "near-links")
    if more.limit(1).count():
        comps = components(links.union(more))

    heads = classes.join(shuffled(comps), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least_ids = heads.groupBy("comp").agg(F.min("head").alias("component_id"))
    named = heads.join(shuffled(least_ids), "comp").select("set_key", "comp", "component_id")
    result = docs.drop("sig").join(shuffled(named), "set_key", "left")
    # Without shingles a row stands for itself.
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    return result.select(
        "doc_id", "text_key", "n_shingles", "set_key", "comp", component.alias("component_id"), kept.alias("kept")
    )


def representatives(df: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, **how: int) -> DataFrame:
    """The rows of ``df`` less all but one of each component: that of the smallest id.

    Likeness of 0.8 links, less than :func:`near_duplicates` asks for unless told.
    Where ids repeat or are null, the hash of the text decides among the rows of the smallest id.
    Rows without shingles stay, equal rows once.
    """
    found = near_duplicates(df, doc_id, text, percent=percent, **how).where("kept").select("comp", F.struct("doc_id", "text_key").alias("row"))
    linked = found.where("comp is not null").groupBy("comp").agg(F.min("row").alias("row")).select("row")
    chosen = linked.union(found.where("comp is null").select("row").distinct())
    chosen = chosen.select(F.col("row.doc_id").alias("near_id"), F.col("row.text_key").alias("near_text"))
    # The caller's row travels as one column, so no name of it can clash.
    rows = df.select(F.struct("*").alias("row")).select("row", F.col("row")[doc_id].alias("id"), F.col("row")[text].alias("text"))
    same = F.col("id").eqNullSafe(F.col("near_id")) & (F.xxhash64("text") == F.col("near_text"))
    return rows.join(shuffled(chosen), same, "left_semi").dropDuplicates(["id", "text"]).select("row.*")


def _texts(df: DataFrame, doc_id: str, text: str, classes: DataFrame, posted: DataFrame, leaders: DataFrame) -> DataFrame:
    """(cls, text) of the classes in lists of two or more: the text of one row of the class.

    Ids may repeat or be null, so a row is found by its id and the hash of its text.
    """
    needed = posted.join(shuffled(leaders), "key", "left_semi").select("cls").distinct()
    shown = classes.join(shuffled(needed), "cls", "left_semi").select(
        "cls", F.col("shown.doc_id").alias("shown_id"), F.col("shown.text_key").alias("text_key")
    )
    rows = own(df, doc_id=doc_id, text=text).where("text is not null").withColumn("text_key", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(shown["shown_id"]) & (rows["text_key"] == shown["text_key"])
    return stage(rows.join(shuffled(shown), same).select("cls", "text").dropDuplicates(["cls"]), "near-texts")


def _open(posted: DataFrame, leaders: DataFrame, comps: DataFrame) -> DataFrame:
    """(cls, comp) of the classes in lists whose classes lie in several components."""
    labelled = (
        posted.join(shuffled(leaders.select("key")), "key", "left_semi")
        .join(shuffled(comps), "cls", "left")
        .select("key", "cls", F.coalesce("comp", "cls").alias("comp"))
    )
    several = labelled.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return labelled.join(shuffled(several), "key", "left_semi").select("cls", "comp").distinct()


def _across(open_: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of open classes in different components that the counts of their rarest shingles don't rule out.

    The shingles of a class are ordered by how many open classes have them; two sets that meet the
    threshold share one among the first few of each, and what stands behind it bounds what they
    can share at most.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_sets(batch["text"], k))
            if found:
                sizes = np.array([len(x) for x in found])
                cls = np.repeat(batch["cls"].to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls), pa.array(np.concatenate(found).view(np.int64))], ["cls", "shingle"]
                )

    rows = stage(texts.join(shuffled(open_), "cls", "left_semi").mapInArrow(tidy(explode), "cls long, shingle long"), "near-shingles")
    common = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    sizes = rows.groupBy("cls").agg(F.count("*").alias("size")).join(shuffled(open_), "cls")
    held = rows.join(shuffled(common), "shingle").groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("held"))
    single = F.col("size") - F.size("held")  # shingles no other class has come first
    first = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    posts = (
        held.join(shuffled(sizes), "cls")
        .select("cls", "comp", "size", single.alias("single"), F.slice("held", F.lit(1), F.greatest(first - single, F.lit(0)).cast("int")).alias("held"))
        .select("cls", "comp", "size", "single", F.posexplode("held").alias("at", "item"))
        .select(F.col("item.shingle").alias("shingle"), "cls", "comp", "size", (F.col("size") - F.col("single") - F.col("at")).alias("left"))
    )
    posts = stage(posts, "near-shingle-posts")
    x, y = posts.alias("x"), posts.alias("y")
    smaller = (F.col("y.size") < F.col("x.size")) | ((F.col("y.size") == F.col("x.size")) & (F.col("y.cls") < F.col("x.cls")))
    near = (F.col("y.size") * 100 >= F.col("x.size") * percent) & (
        F.least("x.left", "y.left") * (100 + percent) >= (F.col("x.size") + F.col("y.size")) * percent
    )
    pairs = x.join(shuffled(y), F.col("x.shingle") == F.col("y.shingle")).where((F.col("x.comp") != F.col("y.comp")) & smaller & near)
    return pairs.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
