"""Fill-in-the-middle examples by secondary sort.

Units of a text are runs of A-Z, a-z and single other code points.  A task cuts each text into
prefix, middle and suffix at unit bounds and emits pieces of at most ``CHUNK`` units, keyed by row and
by position in the output.  The pieces are dealt by row and sorted by position within their
partition; a stream over them adds each to the digest of the output, takes the output apart at its
marks again and keys what lies between by its place in the text.  Sorting by that, in the same
partition and without another shuffle, restores the text, which is streamed into its own digest.  So
a task holds one piece at a time besides the sorter, which spills.

A row's key is its place in its input task, so rows of one id, null ids and repeated rows stay apart
and one frequent id is spread; a lost task makes the same keys again when its input is read again in
the same order, as files are.  Null texts count as empty.  A null id draws its numbers as the empty
string would.  Other columns are left out, whatever their names.  No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.common import own, tidy

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
CHUNK = 16_384  # units of a piece
BATCH_BYTES = 4 << 20
PLAIN_FROM, SUFFIX_FIRST = 90, 20  # of 100: texts from the first on stay plain, those below the second put the suffix first
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}


def unit_starts(raw: np.ndarray) -> np.ndarray:
    """Byte offsets at which the units of a UTF-8 text begin."""
    letter = ((raw | 0x20) - np.uint8(ord("a"))) < 26  # wraps around below "a"
    first = (raw & 0xC0) != 0x80
    first[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(first)


def draws(doc_id: object, seed: int = 1) -> list[int]:
    """Four numbers of 32 bits from the digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def n_chars(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def plan(doc_id: object, text: bytes, seed: int = 1) -> tuple[dict, list[bytes]]:
    """What is said of an example, and its output as pieces in order."""
    raw = np.frombuffer(text, np.uint8)
    starts = unit_starts(raw)
    n = len(starts)
    h = draws(doc_id, seed)
    bounds = np.append(starts, len(raw))
    about = {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None}

    def pieces(first: int, last: int, mark: bytes = b"") -> list[bytes]:
        cuts = [*range(first, last, CHUNK), last]
        found = [text[bounds[a] : bounds[b]] for a, b in zip(cuts, cuts[1:])] or [b""]
        return [mark + found[0], *found[1:]]

    if not text or any(mark in text for mark in PLACE) or h[2] % 100 >= PLAIN_FROM:
        return about, pieces(0, n)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    about |= {"prefix_chars": n_chars(raw[: bounds[a]]), "middle_chars": n_chars(raw[bounds[a] : bounds[b]])}
    prefix, middle, suffix = pieces(0, a, PREFIX), pieces(a, b, MIDDLE), pieces(b, n, SUFFIX)
    if h[3] % 100 < SUFFIX_FIRST:
        return about | {"form": "spm"}, suffix + prefix + middle
    return about | {"form": "psm"}, prefix + suffix + middle


def batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows whose last column holds the bytes that count."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1] or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


class Undo:
    """Takes an output apart as it streams by: pieces of text with their place (0 prefix, 1 middle, 2 suffix)."""

    def __init__(self, form: str) -> None:
        self.plain, self.place, self.rest = form == "plain", 0, b""

    def feed(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        if self.plain:
            yield 0, piece
            return
        left = self.rest + piece
        while True:
            found = min((at, mark) for mark in PLACE if (at := left.find(mark)) >= 0) if any(m in left for m in PLACE) else None
            if found is None:
                break
            at, mark = found
            if at:
                yield self.place, left[:at]
            self.place, left = PLACE[mark], left[at + len(mark) :]
        # A mark may have begun at the end.
        keep = next((k for k in (2, 1) if any(left.endswith(mark[:k]) for mark in PLACE)), 0)
        self.rest = left[len(left) - keep :]
        if len(left) > keep:
            yield self.place, left[: len(left) - keep]

    def end(self) -> Iterator[tuple[int, bytes]]:
        if self.rest:
            yield self.place, self.rest


def fill_middle(df: DataFrame, texts: bool = False, seed: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 for every row.

    ``texts`` adds the ``output`` itself and the text ``restored`` from it.
    """
    rows = own(df, doc_id=doc_id, text=text)
    id_type = rows.schema["doc_id"].dataType
    kind, arrow_kind = id_type.simpleString(), to_arrow_type(id_type)
    about = ["n", "form", "prefix_chars", "middle_chars"]
    about_types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
    about_sql = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33

        def made() -> Iterator[tuple]:
            at = 0
            for batch in batches:
                for key, body in zip(batch["doc_id"], batch["text"]):
                    key = key.as_py()
                    said, pieces = plan(key, (body.as_py() or "").encode(), seed)
                    head = (key, *said.values())
                    for place, piece in enumerate(pieces):
                        yield base + at, place, *(head if place == 0 else (None,) * 5), piece
                    at += 1

        names = ["row", "place", "doc_id", *about, "piece"]
        yield from batched(made(), pa.schema(list(zip(names, [pa.int64(), pa.int64(), arrow_kind, *about_types, pa.binary()]))))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests of outputs; their pieces keyed by the place in the text; what is said of a row comes last."""

        def made() -> Iterator[tuple]:
            row = None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["place"] == 0:
                        if row is not None:
                            yield from closed()
                        row, head, digest, undo, at = r["row"], r, hashlib.sha256(), Undo(r["form"]), 0
                        whole = []

                        def closed() -> Iterator[tuple]:
                            last = b"".join(whole) if texts else None
                            for place, body in undo.end():
                                yield row, place, at, *(None,) * 6, body
                            yield row, 3, 0, head["doc_id"], *(head[x] for x in about), digest.hexdigest(), last

                    digest.update(r["piece"])
                    if texts:
                        whole.append(r["piece"])
                    for place, body in undo.feed(r["piece"]):
                        yield row, place, at, *(None,) * 6, body
                        at += 1
            if row is not None:
                yield from closed()

        names = ["row", "place", "at", "doc_id", *about, "output_sha256", "piece"]
        types = [pa.int64(), pa.int64(), pa.int64(), arrow_kind, *about_types, pa.string(), pa.binary()]
        yield from batched(made(), pa.schema(list(zip(names, types))))

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            digest, whole = hashlib.sha256(), []
            for batch in batches:
                for r in batch.to_pylist():
                    if r["place"] < 3:
                        digest.update(r["piece"])
                        if texts:
                            whole.append(r["piece"])
                        continue
                    last = (r["piece"], b"".join(whole)) if texts else (None, None)
                    yield r["doc_id"], *(r[x] for x in about), r["output_sha256"], digest.hexdigest(), *last
                    digest, whole = hashlib.sha256(), []

        names = ["doc_id", *about, "output_sha256", "restored_sha256", "output", "restored"]
        types = [arrow_kind, *about_types, pa.string(), pa.string(), pa.binary(), pa.binary()]
        yield from batched(made(), pa.schema(list(zip(names, types))))

    pieces = rows.mapInArrow(tidy(cut), f"row long, place long, {about_sql}, piece binary")
    outputs = pieces.repartition("row").sortWithinPartitions("row", "place")
    taken = outputs.mapInArrow(tidy(written), f"row long, place long, at long, {about_sql}, output_sha256 string, piece binary")
    done = taken.sortWithinPartitions("row", "place", "at").mapInArrow(
        tidy(restored), f"{about_sql}, output_sha256 string, restored_sha256 string, output binary, restored binary"
    )
    if texts:
        return done.withColumns({c: F.col(c).cast("string") for c in ("output", "restored")})
    return done.drop("output", "restored")


def restored_text(form: Column, output: Column) -> Column:
    """The text of an example, from its form and output, inside the row."""
    suffix_on = F.substring_index(output, "<S>", -1)
    middle = F.substring_index(output, "<M>", -1)
    prefix_on = F.substring_index(output, "<P>", -1)
    psm = F.concat(F.substring_index(prefix_on, "<S>", 1), middle, F.substring_index(suffix_on, "<M>", 1))
    spm = F.concat(F.substring_index(prefix_on, "<M>", 1), middle, F.substring_index(suffix_on, "<P>", 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
