"""Removal of byte strings that occur more than once, by refinement of buckets.

A string of ``length`` bytes is repeated if it starts anywhere else, in any text.  The buckets of a
suffix sort are refined here only where a repeat can be:

1.  Initial buckets are the q-grams at content-defined anchors; every string of ``length`` bytes has an
    anchor, equal strings at the same place.  Anchors of q-grams that occur once are done with.
2.  The stretch around an anchor holds every string that the anchor stands for.  Equal stretches
    settle all their strings at once.
3.  What is left is sorted, within its bucket, by bucket identifiers of later offsets: strings that agree
    in their first q bytes agree in 2q if the identifiers q bytes further on are equal too, and so on by
    doubling up to ``length``; each round reuses the identifiers of the last at both offsets.

Identifiers are 64-bit hashes; equal stretches have equal buckets too, so both have to agree where bytes are
removed because stretches are equal.  Rows of the most frequent q-grams and buckets stay in the tasks that
hold them: the fewer than ``HOT_KEYS`` keys of more than that fraction of all rows travel to them, and only rows
of other keys meet by key.

A bucket of more than ``bucket_rows`` different stretches is not gathered into one task: its strings are split
by where the anchor lies in them, and bucketed anew by the longer core that all strings of a half
share, until the buckets are small or a core is a whole string.

Ranks over all suffixes are not built: they take several times the input on disk, and their order
is not needed to know which strings are repeated.

Texts are UTF-8 bytes; null is empty.  Repeated rows are copies of one another, so all of their
strings of that length go.  Null ids are allowed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.anchors import anchors
from factloom.llm.common import own, shuffled, tidy
from factloom.llm.wordhash import _BYTES, powers, scrambled
from factloom.session import discard, stage

_U = np.uint64
LENGTH = 200
GRAM = 64
BUCKET_ROWS = 8192
HOT_KEYS = 2_000


def _raw(texts: pa.Array) -> list[bytes]:
    return [x or b"" for x in texts.cast(pa.binary()).to_pylist()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind))


def _spot(place: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place and range of offsets in one number."""
    return (place << 32) | (lo << 16) | hi


def _unspot(spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spot >> 32, (spot >> 16) & 0xFFFF, spot & 0xFFFF


def _signature(core: np.ndarray, whole: np.ndarray, before: np.ndarray, after: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of a bucket and of a stretch, from the hashes of their bytes and the shape."""
    shape = scrambled((lo << 16 | hi).astype(_U))
    return scrambled(core + shape), scrambled(whole + (before << 20).astype(_U) + after.astype(_U) + shape)


def _scan(rows: DataFrame, length: int, q: int) -> DataFrame:
    """Size, digest and anchors of every row; no text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _raw(batch["text"])
            found = list(anchors(texts, length, q))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["rk"],
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    _lists([h.view(np.int64) for _, h in found], pa.int64()),
                    _lists([p.astype(np.int32) for p, _ in found], pa.int32()),
                ],
                ["doc_id", "rk", "n_bytes", "sha256", "keys", "places"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        tidy(scan), f"doc_id {kind}, rk long, n_bytes long, sha256 string, keys array<long>, places array<int>"
    )


def _stretches(texts: DataFrame, length: int, q: int) -> DataFrame:
    """(bucket, stretch, rk, spot) for each place of a text.

    ``bucket`` is the hash of the core that all strings around the place share, ``stretch`` that of all the
    bytes that they span.
    """

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(4)]
            for text, rk, places in zip(_raw(batch["text"]), batch["rk"].to_pylist(), batch["places"]):
                place, n = places.values.to_numpy().astype(np.int64), len(text)
                lo, hi = np.zeros(len(place), np.int64), np.full(len(place), length - q)
                start, end = place - np.minimum(place, hi), np.minimum(n, place + length)
                fits = (place + q <= n) & (end - start >= length)
                place, lo, hi, start, end = (x[fits] for x in (place, lo, hi, start, end))
                if not len(place):
                    continue
                up, down = powers(n + 1)
                sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTES[np.frombuffer(text, np.uint8)] * up[:n])])
                core, whole = (scrambled((sums[y] - sums[x]) * down[x]) for x, y in ((place, place + q), (start, end)))
                bucket, key = _signature(core, whole, place - start, end - place, lo, hi)
                for held, x in zip(out, (bucket.view(np.int64), key.view(np.int64), np.full(len(place), rk, np.int64), _spot(place, lo, hi))):
                    held.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["bucket", "stretch", "rk", "spot"])

    return texts.select("rk", "text", "places").mapInArrow(tidy(stretch), "bucket long, stretch long, rk long, spot long")


def _with_bytes(texts: DataFrame, length: int) -> DataFrame:
    """The asked stretches with their bytes: (bucket, rk, spot, single, members, bytes)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("bucket", "spot", "single", "members")
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text, rk, asked in zip(_raw(batch["text"]), batch["rk"].to_pylist(), batch["asked"]):
                for bucket, spot, single, members in zip(*(asked.values.field(c).to_pylist() for c in names)):
                    place, lo, hi = spot >> 32, (spot >> 16) & 0xFFFF, spot & 0xFFFF
                    for held, x in zip(cols, (bucket, rk, spot, single, members, text[place - min(place, hi) : place + length - lo])):
                        held.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(cols, kinds)], ["bucket", "rk", "spot", "single", "members", "bytes"]
            )

    return texts.select("rk", "text", "asked").mapInArrow(
        tidy(cut), "bucket long, rk long, spot long, single boolean, members long, bytes binary"
    )


def _halves(rows: DataFrame, length: int) -> DataFrame:
    """Each stretch as two, for the lower and the upper half of its offsets: (bucket, stretch, rk, spot, single, bytes)."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for rk, spot, single, raw in zip(*(batch[c].to_pylist() for c in ("rk", "spot", "single", "bytes"))):
                place, low, high = spot >> 32, (spot >> 16) & 0xFFFF, spot & 0xFFFF
                at = min(place, high)  # the place in these bytes
                middle = (low + high) // 2
                for lo, hi in ((low, middle), (middle + 1, high)):
                    start, end = at - min(at, hi), min(len(raw), at + length - lo)
                    if lo > hi or at < lo or at + length - hi > len(raw) or end - start < length:
                        continue
                    part = raw[start:end]
                    core = hashlib.blake2b(raw[at - lo : at + length - hi] + b"%d %d" % (lo, hi), digest_size=8).digest()
                    whole = hashlib.blake2b(part + b"%d %d %d" % (lo, hi, at - start), digest_size=8).digest()
                    bucket, key = (int.from_bytes(x, "little", signed=True) for x in (core, whole))
                    out.append((bucket, key, rk, place << 32 | lo << 16 | hi, single, part))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            cols = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(cols, kinds)], ["bucket", "stretch", "rk", "spot", "single", "bytes"]
            )

    return rows.select("rk", "spot", "single", "bytes").mapInArrow(
        tidy(halve), "bucket long, stretch long, rk long, spot long, single boolean, bytes binary"
    )


def _ids(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifier of each value, and whether its bucket has several members."""
    order = np.argsort(values, kind="stable")
    held = values[order]
    new = np.concatenate([[True], held[1:] != held[:-1]])
    rank = np.cumsum(new) - 1
    ids = np.empty(len(values), np.int64)
    ids[order] = rank
    return ids, np.bincount(rank)[ids] > 1


def repeated_starts(bucket: np.ndarray, cuts: list[bytes], left: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, q: int) -> np.ndarray:
    """For each stretch and offset of the place (0..length), whether that string occurs in another
    stretch of its bucket at the same offset.  ``left`` is the place in the stretch."""
    n, widest = len(cuts), max(map(len, cuts))
    reach = int(left.max())
    raw = np.zeros((n, reach + widest), np.uint8)
    for i, cut in enumerate(cuts):
        raw[i, reach - left[i] : reach - left[i] + len(cut)] = np.frombuffer(cut, np.uint8)
    width = raw.shape[1]
    up, down = powers(width + 1)
    sums = np.zeros((n, width + 1), _U)
    np.cumsum(_BYTES[raw] * up[:width], axis=1, out=sums[:, 1:])
    gram = (sums[:, q:] - sums[:, :-q]) * down[: width - q + 1]  # at every column
    sizes = np.array([len(c) for c in cuts])
    first, end = reach - left, reach - left + sizes  # columns of each stretch
    # Strings of `size` bytes inside their stretch, by column; equal identifiers are equal strings of a bucket and column.
    col = np.arange(width - q + 1)
    row, col = np.nonzero((col >= first[:, None]) & (col + q <= end[:, None]))
    size, ids = q, np.full((n, width), -1, np.int64)
    found_ids, open_ = _ids(scrambled(gram[row, col] + scrambled(bucket[row].view(_U) + col.astype(_U))))
    ids[row, col] = found_ids
    while size < length:
        step = min(size, length - size)
        # A longer string is told by the identifiers of its first and its last `size` bytes.
        longer = open_ & (col + step + size <= end[row])
        longer[longer] = ids[row[longer], col[longer] + step] >= 0
        row, col, open_ = row[longer], col[longer], open_[longer]
        if not len(row):
            break
        pairs = scrambled(ids[row, col].astype(_U)) + ids[row, col + step].astype(_U)
        found_ids, open_ = _ids(scrambled(pairs))
        ids.fill(-1)
        ids[row, col] = found_ids
        size += step
    offset = reach - col
    open_ &= (offset <= np.minimum(left, hi)[row]) & (offset >= lo[row])
    found = np.zeros((n, reach + 1), bool)
    if len(row):
        found[row[open_], reach - col[open_]] = True
    return found


def _refined(rows: DataFrame, length: int, q: int) -> DataFrame:
    """(rk, start, end): runs of repeated strings, from rows sorted by bucket."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole buckets, some thousand rows at a time."""
        held: pa.Table | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            bucket = held["bucket"].to_numpy()
            other = np.flatnonzero(bucket != bucket[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield held.slice(0, cut)
                held = held.slice(cut).combine_chunks()
        if held is not None:
            yield held

    def pieces(table: pa.Table) -> Iterator[pa.Table]:
        bucket = table["bucket"].to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        sizes = np.diff(edges)
        at = 0
        while at < len(sizes):
            end = at + 1
            while end < len(sizes) and edges[end + 1] - edges[at] <= 4096:
                end += 1
            yield table.slice(edges[at], edges[end] - edges[at])
            at = end

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches):
            for part in pieces(whole):
                bucket, rk, spot, single = (part[c].to_numpy() for c in ("bucket", "rk", "spot", "single"))
                place, lo, hi = _unspot(spot)
                found = repeated_starts(bucket, part["bytes"].to_pylist(), np.minimum(place, hi), lo, hi, length, q)
                found[~single.astype(bool)] = False
                # Runs of offsets; larger offsets start earlier.
                edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                row, low = np.nonzero(edge == 1)
                _, high = np.nonzero(edge == -1)
                start, end = place[row] - (high - 1), place[row] - low + length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rk[row]), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["rk", "start", "end"]
                )

    return rows.select("bucket", "rk", "spot", "single", "bytes").mapInArrow(tidy(refine), "rk long, start int, end int")


def with_counts(rows: DataFrame, counts: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` whose key is in ``counts`` (one row per key, staged), with its columns.

    Keys of more than 1 / HOT_KEYS of all counted rows are less than HOT_KEYS and travel to the rows of theirs.
    """
    counted = counts.agg(F.sum(n)).first()[0] or 0
    frequent = F.col(n) > counted // HOT_KEYS
    hot = F.broadcast(counts.where(frequent))
    others = rows.join(hot.select(key), key, "left_anti").join(shuffled(counts.where(~frequent)), key)
    return rows.join(hot, key).unionByName(others)


def repeated_strings(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, q: int = GRAM, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, end) for every row."""
    # Rows are told apart by a hash of id and text; exact copies of a row get the same spans.
    rows = own(df, doc_id=doc_id, text=text).withColumn("rk", F.xxhash64("doc_id", "text"))
    scan = stage(_scan(rows, length, q), "repeat-scan")
    placed = scan.select("rk", F.explode(F.arrays_zip("keys", "places")).alias("at"))
    placed = placed.select("rk", F.col("at.keys").alias("key"), F.col("at.places").alias("place"))
    shared = stage(placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "repeat-shared")
    hits = with_counts(placed, shared, "key", "n").groupBy("rk").agg(F.collect_set("place").alias("places"))
    hits = stage(hits, "repeat-hits")
    texts = stage(rows.where("text is not null").select("rk", "text").join(shuffled(hits), "rk"), "repeat-texts")
    discard(hits, shared)

    def reach(rows: DataFrame) -> DataFrame:
        """Where the strings of a spot start and end; an end past the text is cut later."""
        place, lo, hi = F.shiftright("spot", 32), F.shiftright("spot", 16).bitwiseAND(0xFFFF), F.col("spot").bitwiseAND(0xFFFF)
        return rows.select("rk", (place - F.least(place, hi)).cast("int").alias("start"), (place + length - lo).cast("int").alias("end"))

    def members(alike: DataFrame) -> DataFrame:
        return alike.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")

    def opened(alike: DataFrame) -> DataFrame:
        return alike.join(shuffled(members(alike)), "bucket").withColumn("single", F.col("n") == 1)

    def refined(cut: DataFrame) -> DataFrame:
        # A bucket's rows meet in one task; there are at most bucket_rows of them.
        small = cut.where(F.col("members") <= bucket_rows)
        return _refined(small.repartition("bucket").sortWithinPartitions("bucket"), length, q)

    one = F.min(F.struct("rk", "spot")).alias("one")
    stretches = stage(_stretches(texts, length, q), "repeat-stretches")
    alike = stage(stretches.groupBy("stretch", "bucket").agg(F.count("*").alias("n"), one), "repeat-alike")
    several = alike.where("n > 1").select("stretch", "bucket")
    spans = [stage(reach(stretches.join(shuffled(several), ["stretch", "bucket"], "left_semi")), "repeat-settled")]
    discard(stretches)
    sizes = stage(members(alike), "repeat-members")
    asked = with_counts(alike, sizes, "bucket", "members").withColumn("single", F.col("n") == 1).select("one.rk", F.struct("bucket", "one.spot", "single", "members").alias("item"))
    asked = stage(asked.groupBy("rk").agg(F.collect_list("item").alias("asked"), F.max("item.members").alias("most")), "repeat-asked")
    discard(alike, sizes)
    cut = _with_bytes(texts.select("rk", "text").join(shuffled(asked), "rk"), length)
    hot = asked.where(F.col("most") > bucket_rows).limit(1).count() > 0
    if hot:  # read twice, by the refinement and by the split
        cut = stage(cut, "repeat-cut")
    spans.append(stage(refined(cut), "repeat-refined"))
    discard(asked)
    while hot:
        halves = stage(_halves(cut.where(F.col("members") > bucket_rows), length), "repeat-halves")
        alike = halves.groupBy("stretch", "bucket").agg(F.count("*").alias("n"), one, F.first("bytes").alias("bytes"))
        discard(cut)
        cut = stage(opened(alike).select("bucket", "one.rk", "one.spot", "single", "members", "bytes"), "repeat-cut")
        several = alike.where("n > 1").select("stretch", "bucket")
        repeated = halves.where("single").join(shuffled(several), ["stretch", "bucket"], "left_semi")
        spans.append(stage(reach(repeated), "repeat-settled"))
        # A representative that was settled in an earlier round is a partner only.
        spans.append(stage(refined(cut), "repeat-refined"))
        hot = cut.where(F.col("members") > bucket_rows).limit(1).count() > 0
        discard(halves)
    found = spans[0]
    for part in spans[1:]:
        found = found.union(part)
    found = found.groupBy("rk").agg(F.collect_list(F.struct("start", "end")).alias("parts"))
    cuts = _kept(texts.select("rk", "text").join(shuffled(found), "rk")).dropDuplicates(["rk"])
    return (
        scan.select("doc_id", "rk", "n_bytes", "sha256")
        .join(shuffled(cuts), "rk", "left")
        .select(
            "doc_id",
            "n_bytes",
            F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
            F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
            F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
            "sha256",
            "spans",
        )
    )


def merged_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals; touching ones are one run."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return start[first], reach[np.concatenate([first[1:] - 1, [len(start) - 1]])]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return b"".join([*kept, text[at:]])


def _kept(rows: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, rk, parts in zip(_raw(batch["text"]), batch["rk"].to_pylist(), batch["parts"]):
                start, end = (parts.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
                spans = list(zip(*(x.tolist() for x in merged_spans(start, np.minimum(end, len(text))))))
                digest = hashlib.sha256(without(text, spans)).hexdigest()
                removed = sum(b - a for a, b in spans)
                for held, x in zip(out, (rk, removed, len(spans), digest, [{"start": a, "end": b} for a, b in spans])):
                    held.append(x)
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, kinds)], ["rk", "n_removed", "n_spans", "kept_sha256", "spans"]
            )

    return rows.select("rk", "text", "parts").mapInArrow(
        tidy(cut), "rk long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"
    )


def cut_repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """``df`` with the repeated strings cut out of its texts; broken characters at the cuts go too.

    All other columns stay as they are; null texts stay null.
    """
    spans = repeated_strings(df, doc_id, text, **how).where("n_spans > 0").dropDuplicates(["doc_id", "sha256"])
    spans = spans.select(F.col("doc_id").alias("cut_id"), F.col("sha256").alias("cut_sha"), F.col("spans").alias("cut"))
    # The caller's row travels as one column, so no name of it can clash.
    rows, row = df.select(F.struct("*").alias("row")), F.col("row")
    same = row[doc_id].eqNullSafe(F.col("cut_id")) & (F.sha2(row[text].cast("binary"), 256) == F.col("cut_sha"))
    joined = rows.join(shuffled(spans), same, "left").select("row", "cut")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, all_spans: pd.Series) -> pd.Series:
        return pd.Series(
            [
                t if s is None else without(t.encode(), [(x["start"], x["end"]) for x in s]).decode("utf-8", "ignore")
                for t, s in zip(texts, all_spans)
            ],
            dtype=object,
        )

    kept = joined.withColumn("kept", cut(row[text], F.col("cut")))
    return kept.select(row.withField(text, F.col("kept")).alias("row")).select("row.*")
