"""Scalar text functions as Column expressions; all of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom import fixed_values as fv

WORD_GAP = r"[^\p{L}\p{N}_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use at several places of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(fv.WHITESPACE_CHARS))


def collapse_spaces(text: Column) -> Column:
    """Every run of white space becomes one blank, ends trimmed."""
    # Runs that are a blank already stay out of the pattern: most of a text is copied, not rebuilt.
    space = f"[{fv.WHITESPACE_CLASS}]"
    return F.btrim(F.regexp_replace(text, f" {space}+|[{fv.WHITESPACE_CLASS}&&[^ ]]{space}*", " "), F.lit(" "))


def clean_text(text: Column) -> Column:
    """Repair mojibake, unify line ends and blanks, keep at most one empty line, trim."""
    repaired = text
    for bad, good in fv.MOJIBAKE:
        repaired = F.replace(repaired, F.lit(bad), F.lit(good))
    suspect = F.contains(text, F.lit("â€")) | text.rlike("[Â\u00a0]")
    text = F.replace(F.when(suspect, repaired).otherwise(text), F.lit("\r"), F.lit("\n"))
    text = F.regexp_replace(text, "[ \t]{2,}|\t", " ")
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def entity_key(name: Column) -> Column:
    """Comparison key of a name: cleaned, lower case, only a-z and 0-9."""
    return F.regexp_replace(F.lower(clean_text(name)), "[^a-z0-9]+", "")


def dedup_key(text: Column) -> Column:
    """Texts with equal keys count as repeats: lower case, words divided by single blanks."""
    return F.btrim(F.regexp_replace(F.lower(text), WORD_GAP, " "), F.lit(" "))


def occurrences(text: Column, needle: str) -> Column:
    removed = F.replace(text, F.lit(needle), F.lit(""))
    return ((F.length(text) - F.length(removed)) / len(needle)).cast("int")


def is_garbage(text: Column) -> Column:
    """Binary leftovers: too many replacement or control characters, or PDF stream markers."""
    controls = "".join(chr(i) for i in range(32) if chr(i) not in "\n\r\t")
    # Looking each character up is slow, and few texts have one of them.
    some = text.rlike("[\ufffd\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]")
    bad = F.when(some, F.length(text) - F.length(F.translate(text, "�" + controls, ""))).otherwise(0)
    markers = occurrences(text, "endstream") + occurrences(text, "endobj")
    return (F.length(text) > 0) & (
        (bad / F.greatest(F.length(text), F.lit(1)) > fv.GARBAGE_RATIO)
        | (markers > fv.GARBAGE_STREAM_MARKERS)
    )


def header_field(raw: Column, field: str) -> Column:
    """Value of the first ``Field: value`` line.  An empty field takes the next non-blank line."""
    found = F.regexp_extract(raw, rf"(?md)^{field}:[{fv.WHITESPACE_CLASS}]*(.+)$", 1)
    return clean_text(found)


def body_after(raw: Column, marker: str) -> Column:
    """Everything behind the first marker, or nothing."""
    at = F.locate(marker, raw)
    return F.when(at > 0, F.substring(raw, at + len(marker), F.length(raw))).otherwise(F.lit(""))


def sentences(text: Column) -> Column:
    """Sentences of a text, in order, within the kept length range."""
    rough = F.split(collapse_spaces(text), r"""(?<=[.!?]) (?=[A-Z0-9"'])""")
    trimmed = F.transform(rough, lambda s: F.btrim(s, F.lit(fv.SENTENCE_TRIM_CHARS)))
    return F.filter(
        trimmed, lambda s: F.length(s).between(fv.SENTENCE_MIN_CHARS, fv.SENTENCE_MAX_CHARS)
    )


def content_terms(text: Column, stop_words: Iterable[str] = fv.STOP_WORDS) -> Column:
    """Lower-case content words in order, repeats kept."""
    dropped = [*stop_words, *fv.DOMAIN_STOP_WORDS]
    words = F.regexp_extract_all(F.lower(text), F.lit(fv.TERM_PATTERN), F.lit(0))
    return F.filter(
        words,
        lambda w: ~w.isin(dropped) & ((F.length(w) > 2) | w.isin(list(fv.SHORT_TERMS_KEPT))),
    )


def term_set(text: Column) -> Column:
    return F.array_distinct(content_terms(text))


def overlap(left: Column, right: Column) -> Column:
    """Number of elements two sets share."""
    return F.size(F.array_intersect(left, right))


def query_markers(text: Column) -> Column:
    """Quarters, years, percentages and marker phrases of a question, as a set."""
    lowered = F.lower(text)
    found = F.regexp_extract_all(lowered, F.lit(fv.MARKER_PATTERN), F.lit(0))
    phrases = F.array(*map(F.lit, fv.MARKER_PHRASES))
    return F.array_distinct(
        F.concat(found, F.filter(phrases, lambda p: F.contains(lowered, p)))
    )


def marker_hits(markers: Column, text: Column) -> Column:
    """How many markers stand anywhere in the text (no word boundary asked)."""
    return let(
        F.lower(text), lambda lowered: F.size(F.filter(markers, lambda m: F.contains(lowered, m)))
    )


def marker_candidates(text: Column) -> Column:
    """Every marker a question could have that stands anywhere in the text, as a set.

    The look-ahead tries each place, so markers inside longer numbers are found as well.
    """
    none = F.array().cast("array<string>")

    def found(lowered: Column) -> Column:
        parts = [
            F.when(
                F.contains(lowered, F.lit(sign)),
                F.regexp_extract_all(lowered, F.lit(f"(?=({pattern}))"), F.lit(1)),
            ).otherwise(none)
            for sign, pattern in fv.MARKER_FORMS
        ]
        phrases = F.array(*map(F.lit, fv.MARKER_PHRASES))
        parts.append(F.filter(phrases, lambda p: F.contains(lowered, p)))
        return F.array_distinct(F.concat(*parts))

    return let(F.lower(text), found)


def numbers(sentence: Column) -> Column:
    """Money amounts, then percentages, then counts; one number may appear under two of them."""
    return F.concat(
        *(
            F.regexp_extract_all(sentence, F.lit(pattern), F.lit(0))
            for pattern in (fv.MONEY_PATTERN, fv.PERCENT_PATTERN, fv.COUNT_PATTERN)
        )
    )


def metric_node(label: Column) -> Column:
    return F.concat(F.lit("metric:"), F.substring(collapse_spaces(label), 1, 90))


def relation_name(relation: Column) -> Column:
    """Upper snake case; characters outside A-Z, 0-9, _ and blank go before blanks turn to _."""
    kept = F.regexp_replace(F.upper(strip(relation)), "[^A-Za-z0-9_ ]+", "")
    joined = F.substring(F.regexp_replace(kept, " +", "_"), 1, 60)
    return F.when(joined == "", F.lit(fv.RELATED_TO)).otherwise(joined)


def json_object(reply: Column) -> Column:
    """The reply if it is a JSON object, else the span of its outermost braces if that is one."""

    def valid(text: Column) -> Column:
        bare = strip(text)
        return F.when(bare.startswith("{") & F.try_parse_json(bare).isNotNull(), bare)

    return F.coalesce(valid(reply), valid(F.regexp_extract(reply, r"(?s)\{.*\}", 0)))


def contains_all_groups(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """True if every group has a phrase that stands in the text."""
    condition = F.lit(True)
    for group in groups:
        any_of = F.lit(False)
        for phrase in group:
            any_of = any_of | F.contains(text, F.lit(phrase))
        condition = condition & any_of
    return condition


def edge_text(source: Column, relation: Column, target: Column) -> Column:
    return F.concat(source, F.lit(" -["), relation, F.lit("]-> "), target)


def evidence_line(rank: Column, source_id: Column, title: Column, text: Column) -> Column:
    return F.format_string(
        "[%d] source=%s; title=%s; evidence=%s", rank, source_id, title, collapse_spaces(text)
    )


def format_duration(seconds: Column) -> Column:
    minutes = seconds / 60
    return (
        F.when(seconds < 60, F.format_string("%.0fs", F.bround(seconds, 0)))
        .when(minutes < 60, F.format_string("%.1f minutes", minutes))
        .otherwise(F.format_string("%.1f hours", minutes / 60))
    )


def estimated_tokens(chars: Column) -> Column:
    """Four characters count as one token, rounded up."""
    return F.ceil(chars / 4)
