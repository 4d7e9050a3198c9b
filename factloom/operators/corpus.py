"""Documents, sentences, row windows and character chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import fixed_values as fv
from factloom.functions import text as tx
from factloom.functions.rows import once, unnest

# Order of a fact, node or chunk in the corpus: document, sentence, position inside the sentence.


def ordinal(doc_seq: Column, sent_idx: Column, sub: Column) -> Column:
    return F.struct(
        doc_seq.cast("bigint").alias("doc_seq"),
        sent_idx.cast("int").alias("sent_idx"),
        sub.cast("bigint").alias("sub"),
    )


def parse_raw(raw_files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Raw corpus files ``(doc_id, doc_seq, path, raw)`` to documents.

    ``max_chars`` is the text limit of the corpus format; ``None`` keeps whole texts.
    """
    raw = F.regexp_replace("raw", "\r\n?", "\n")
    fields = raw_files.select(
        "doc_id",
        "doc_seq",
        "path",
        *(tx.header_field(raw, f).alias(f.lower()) for f in ("Query", "Title", "Link", "Snippet")),
        tx.body_after(raw, "Full Content:").alias("body"),
    )
    return assemble(fields, max_chars)


def assemble(fields: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Fields plus ``body`` to documents: garbage bodies are emptied, the parts joined and cleaned."""
    checked = once(fields, "skipped_content", tx.is_garbage(F.col("body")))
    checked = once(
        checked,
        "content",
        F.when(F.col("skipped_content"), F.lit("")).otherwise(tx.clean_text(F.col("body"))),
    )
    parts = [F.when(F.col(c) != "", F.col(c)) for c in ("title", "snippet", "content")]
    text = tx.clean_text(F.concat_ws("\n", *parts))
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    return once(checked, "text", text).select(
        "doc_id",
        "doc_seq",
        "path",
        "query",
        F.when(F.col("title") != "", F.col("title")).otherwise(F.col("doc_id")).alias("title"),
        "link",
        "snippet",
        "content",
        "text",
        "skipped_content",
    )


def sentence_table(documents: DataFrame) -> DataFrame:
    """One row per kept sentence, numbered within its document."""
    keep = ["doc_id", "doc_seq", "title"]
    return unnest(documents, keep, tx.sentences(F.col("text")), "sent_idx", "sentence")


def windows(documents: DataFrame, size: int, stride: int, min_chars: int) -> DataFrame:
    """Row windows over the kept sentences of each document, built in place without a shuffle.

    ``stride == size`` tumbles, ``stride < size`` slides; short windows at the end are allowed.
    ``text_key`` identifies texts that are repeats of each other.
    """

    def cut(sents: Column, keys: Column) -> Column:
        def window(start: Column) -> Column:
            key_words = F.filter(F.slice(keys, start + 1, F.lit(size)), lambda k: k != "")
            return F.struct(
                F.array_join(F.slice(sents, start + 1, F.lit(size)), " ").alias("text"),
                F.md5(F.array_join(key_words, " ")).alias("text_key"),
            )

        starts = F.sequence(F.lit(0), F.size(sents) - 1, F.lit(stride))
        return F.when(F.size(sents) > 0, F.transform(starts, window))

    def with_keys(sents: Column) -> Column:
        return tx.let(F.transform(sents, tx.dedup_key), lambda keys: cut(sents, keys))

    cuts = tx.let(tx.sentences(F.col("text")), with_keys)
    return (
        unnest(documents, ["doc_id", "doc_seq", "title"], cuts, "chunk_ix", "cut")
        .where(F.length("cut.text") >= min_chars)
        .select("doc_id", "doc_seq", "title", "chunk_ix", "cut.text", "cut.text_key")
    )


def flat_chunks(documents: DataFrame) -> DataFrame:
    return windows(documents, fv.FLAT_WINDOW, fv.FLAT_STRIDE, fv.FLAT_MIN_CHARS)


def guided_chunks(documents: DataFrame) -> DataFrame:
    return windows(documents, fv.GUIDED_WINDOW, fv.GUIDED_STRIDE, fv.GUIDED_MIN_CHARS)


GROUP = 256  # windows of a group while a text is cut


def _last_break(window: Column) -> Column:
    """1-based place of the last ``". "`` or line end in a window, 0 if there is none."""
    backwards = F.reverse(window)

    def last(needle: str) -> Column:
        at = F.locate(needle[::-1], backwards)
        return F.when(at > 0, F.length(window) - at - len(needle) + 2).otherwise(F.lit(0))

    return F.greatest(last(". "), last("\n"))


def char_chunks(
    documents: DataFrame,
    chunk_chars: int = fv.CHUNK_CHARS,
    max_chunks: int | None = None,
) -> DataFrame:
    """Cut texts into windows that prefer to end behind a sentence or line.

    The cut of one window fixes the start of the next, so each text is folded with ``aggregate``, over
    pieces of the size of a window; the state is what is left of the pieces so far, less than two
    windows, and the windows cut.  A window moves on by more than half its size, so a piece brings
    two cuts at most, and the work grows with the text.  ``max_chunks=None`` cuts the whole text.
    """
    half = chunk_chars // 2
    none = F.array().cast("array<string>")

    def state_of(rest: Column, chunks: Column, full: Column) -> Column:
        return F.struct(rest.alias("rest"), chunks.alias("chunks"), full.alias("full"))

    def open_slots(state: Column) -> Column:
        if max_chunks is None:
            return F.lit(True)
        return F.size(F.flatten(state["full"])) + F.size(state["chunks"]) < max_chunks

    def with_chunk(state: Column, text: Column) -> Column:
        return tx.let(
            tx.strip(text),
            lambda chunk: F.when(chunk != "", F.concat(state["chunks"], F.array(chunk))).otherwise(state["chunks"]),
        )

    def cut(state: Column) -> Column:
        """Cut a window off if text follows it."""
        rest = state["rest"]

        def emit(end: Column) -> Column:
            chunks = with_chunk(state, F.substring(rest, F.lit(1), end))
            return state_of(F.substring(rest, end + 1, F.length(rest)), chunks, state["full"])

        def by_break(at: Column) -> Column:
            # A break only shortens the window if it lies beyond the half.
            return tx.let(F.when(at - 1 > half, at).otherwise(F.lit(chunk_chars)), emit)

        going = (F.length(rest) > chunk_chars) & open_slots(state)
        return F.when(going, tx.let(_last_break(F.substring(rest, 1, chunk_chars)), by_break)).otherwise(state)

    def put_by(state: Column) -> Column:
        """Windows are put by in groups, since adding to a long array copies it."""
        full = F.concat(state["full"], F.array(state["chunks"]))
        return F.when(F.size(state["chunks"]) >= GROUP, state_of(state["rest"], none, full)).otherwise(state)

    def step(state: Column, piece: Column) -> Column:
        rest = F.when(open_slots(state), F.concat(state["rest"], piece)).otherwise(F.lit(""))
        longer = state_of(rest, state["chunks"], state["full"])
        return tx.let(tx.let(tx.let(longer, cut), cut), put_by)

    def finish(state: Column) -> Column:
        last = F.when(open_slots(state), with_chunk(state, state["rest"])).otherwise(state["chunks"])
        return F.flatten(F.concat(state["full"], F.array(last)))

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0))
    start = state_of(F.lit(""), none, F.array().cast("array<array<string>>"))
    chunks = F.aggregate(pieces, start, step, finish)
    keep = ["doc_id", "doc_seq", "title", "link"]
    return (
        unnest(documents, keep, chunks, "pos", "chunk")
        .select(*keep, (F.col("pos") + 1).alias("chunk_index"), "chunk")
        .withColumn("key", cache_key(F.col("doc_id"), F.col("chunk_index"), F.col("chunk")))
    )


def cache_key(doc_id: Column, chunk_index: Column, chunk: Column) -> Column:
    return F.concat_ws(
        ":",
        doc_id,
        chunk_index.cast("string"),
        F.length(chunk).cast("string"),
        F.substring(F.sha2(chunk, 256), 1, 16),
    )
