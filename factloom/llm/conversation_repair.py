"""Repair of conversations to turns that alternate, at least cost, by an automaton shared by all of them.

A row is kept (cost 0), given the other role (3) or deleted (4); turns without text are put in (3).  Rows
without a visible character and rows that repeat an earlier one must go; a row that stays although it
breaks off costs 3 more.  The repaired roles are nothing, or an optional system turn and then pairs of
user and assistant.  Of the cheapest repairs the one whose initials (K, R, D, I) come first is taken.

The signature of a conversation has a letter per row: the initial of its role, a capital if the row breaks
off, or ``-`` if it must go.  What a repair costs from some row on depends on the letters from there to
the end only, so the nodes of the automaton are the distinct ends of all signatures: they are shared from
the end.  Distinct signatures are sorted by their reverse, where those with a common end are
neighbours, and a task walks its range of them with the nodes of the current end on a stack: each node
gets its four costs and best audits, one for each state of the grammar, once.  (Ends that lie on the bound
of two ranges are met by both tasks.)  A node holds its first edits, the state they lead to and the order
of its four audits instead of the audits, so it has a fixed size and comparisons look one node down.

Rows stream through their tasks in order, and a conversation of any length needs a letter per row in its
task besides the sorter, which spills; its audit and the digest of its repaired text are single values.
Equal rows of a turn are counted before they are dealt, and so are those of a conversation, so a hot
conversation or text is pre-aggregated; the joins read staged tables, whose hot keys the planner splits.

Rows are ordered by turn, null turns first, ties by digest of role and text.  Null roles and texts count
as one space, null ids are one conversation.  Repeated rows are duplicates of the first.  Other columns
are left out, whatever their names.  No rows give no conversations, but for those named on their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.common import own, tidy
from factloom.llm.fill_middle import batched
from factloom.session import stage

SPACE = " \t\n\v\f\r"
LEGAL = ("su", "ua", "au")
KEEP, REROLE, DELETE, INSERT, BREAKS_OFF = 0, 3, 4, 3, 3
#: The grammar: 0 nothing yet, 1 after the system turn, 2 after a user, 3 after an assistant.  It may end in 0 and 3.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The turn that can be put in or made of another in each state, and the state after it.
MADE = tuple(next((role, to) for role, to in state.items() if role in "ua") for state in NEXT)
ROLES = {"u": "user", "a": "assistant"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


# --- the automaton -----------------------------------------------------------------------------------


def ranked(entries: list[tuple[int, str, int, int]]) -> list[tuple[int, str, int, int]]:
    """Entries (cost, first edits, state after them, rank of the rest) with the rank of the whole audit instead.

    First edits are inserts and one edit of the row, so of two different ones neither begins the other.
    """
    order = sorted({(e[1], e[3]) for e in entries})
    return [(cost, edits, to, order.index((edits, rank))) for cost, edits, to, rank in entries]


def with_inserts(entries: list[tuple[int, str, int, int]]) -> list[tuple[int, str, int, int]]:
    for _ in range(3):  # no cheapest repair has more in a row: they lead in a circle
        for state, (_, after) in enumerate(MADE):
            cost, edits, to, rank = entries[after]
            entries[state] = min(entries[state], (cost + INSERT, "I" + edits, to, rank), key=lambda e: (e[0], e[1], e[3]))
    return ranked(entries)


#: The empty end: nothing more to do where the grammar may end.
END = with_inserts([(0, "", -1, 0), (99, "~", -1, 0), (99, "~", -1, 0), (0, "", -1, 0)])


def node(letter: str, rest: list[tuple[int, str, int, int]]) -> list[tuple[int, str, int, int]]:
    """The node of a letter before an end: for each state (cost, first edits, state after them, rank)."""
    role, extra = letter.lower(), BREAKS_OFF if letter.isupper() else 0
    entries = []
    for state in range(4):
        cost, _, _, rank = rest[state]
        options = [(cost + DELETE, "D", state, rank)]
        if letter != "-":
            if role in NEXT[state]:
                to = NEXT[state][role]
                options.append((rest[to][0] + KEEP + extra, "K", to, rest[to][3]))
            to = MADE[state][1]
            options.append((rest[to][0] + REROLE + extra, "R", to, rest[to][3]))
        entries.append(min(options, key=lambda e: (e[0], e[1], e[3])))
    return with_inserts(entries)


def solve(signatures: DataFrame) -> DataFrame:
    """reverse, cost, audit for distinct signatures, given as ``reverse``, from last letter to first."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            path, nodes = "", [END]
            for batch in batches:
                for reverse in batch["reverse"].to_pylist():
                    shared = len(commonprefix((path, reverse)))
                    del nodes[shared + 1 :]
                    for letter in reverse[shared:]:
                        nodes.append(node(letter, nodes[-1]))
                    path, state, edits = reverse, 0, []
                    for entries in reversed(nodes):
                        edits.append(entries[state][1])
                        state = entries[state][2]
                    yield reverse, nodes[-1][0][0], "".join(edits)

        yield from batched(made(), pa.schema([("reverse", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))

    ranges = signatures.select("reverse").distinct().repartitionByRange("reverse").sortWithinPartitions("reverse")
    return ranges.mapInArrow(tidy(walk), "reverse string, cost long, audit string")


# --- what is wrong with a conversation ---------------------------------------------------------------


def said(role: Column, text: Column) -> Column:
    """Digest of role and text."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def named(df: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    rows = own(df, conv_id=conv_id, turn=turn, role=role, text=text)
    return rows.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})


def damage(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults dealt by the checksum of id and turn: of 20, one is dropped, one emptied, one without
    ends of sentences, one said twice, one said by the user."""
    rows = named(df, conv_id, turn, role, text)
    conv, at = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    key = F.concat(conv, F.lit(":"), at)
    dealt = rows.withColumn("fault", F.crc32(key.cast("binary")) % 20)
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return dealt.where("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def diagnose(rows: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """Per conversation its reversed signature and ``COUNTS``.  ``rows`` are as ``named`` gives them.

    ``also`` has ids of conversations to report without rows, too.
    """
    id_type = rows.schema["conv_id"].dataType
    seen = F.rtrim("text", F.lit(SPACE))
    first = F.substring("role", 1, 1)
    letter = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    fault = F.when(seen == "", "blank").when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), "truncated")
    units = stage(
        rows.select("conv_id", "turn", said(F.col("role"), F.col("text")).alias("said"), letter.alias("letter"), fault.alias("fault"))
        .groupBy("conv_id", "turn", "said", "letter", "fault")
        .agg(F.count("*").alias("times")),
        "turn-units",
    )
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = stage(
        units.groupBy(F.col("conv_id").alias("first_conv"), F.col("said").alias("first_said"))
        .agg(F.min(turn).alias("first"), F.count("*").alias("turns"))
        .where("turns > 1")
        .drop("turns"),
        "turn-firsts",
    )
    repeated = F.col("conv_id").eqNullSafe(F.col("first_conv")) & (F.col("said") == F.col("first_said"))
    known = units.join(firsts, repeated, "left").select(
        "conv_id", "turn", "said", "letter", "fault", "times", (F.col("first").isNull() | (F.col("first") == turn)).alias("first")
    )
    if also is not None:
        none = {c: F.lit(None).cast(known.schema[c].dataType) for c in known.columns[1:]}
        known = known.unionByName(also.select("conv_id").distinct().withColumns(none))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_in = (r for batch in batches for r in batch.to_pylist())

        def made() -> Iterator[tuple]:
            for conv, turns in groupby(rows_in, lambda r: r["conv_id"]):
                letters, count, last = [], dict.fromkeys(COUNTS, 0), None
                least = most = None
                different = 0
                for r in turns:
                    times = r["times"]
                    if times is None:  # of ``also``
                        continue
                    if r["turn"] is not None:
                        least = r["turn"] if least is None else least
                        different += r["turn"] != most
                        most = r["turn"]
                    count["illegal"] += times - 1 + (last is not None and last + r["letter"] not in LEGAL)
                    last = r["letter"]
                    if r["fault"] == "blank":
                        count["blank"] += times
                        letters.append("-" * times)
                        continue
                    again = times - r["first"]
                    if r["first"]:
                        broken = r["fault"] == "truncated"
                        count["truncated"] += broken
                        letters.append(r["letter"].upper() if broken else r["letter"])
                    count["duplicate"] += again
                    letters.append("-" * again)
                if different:
                    count["gaps"] = most - least + 1 - different
                yield conv, *count.values(), "".join(letters)[::-1]

        types = [to_arrow_type(id_type), *(pa.int64() for _ in COUNTS), pa.string()]
        yield from batched(made(), pa.schema(list(zip(["conv_id", *COUNTS, "reverse"], types))))

    ordered = known.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "said")
    return ordered.mapInArrow(tidy(read), f"conv_id {id_type.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, reverse string")


# --- repair ------------------------------------------------------------------------------------------


def edited(rows: Iterator[dict]) -> Iterator[tuple[str, str, str, int]]:
    """edit, role, text and place of what remains of a conversation, whose first row has the audit."""
    audit, at, state, place = iter((next(rows)["audit"] or "")), 0, 0, 0

    def put_in(edit: str | None) -> Iterator[tuple[str, str, str, int]]:
        nonlocal state, place
        while edit == "I":
            role, state = MADE[state]
            yield "I", ROLES[role], "", place
            place += 1
            edit = next(audit, None)
        return edit

    for r in rows:
        edit = yield from put_in(next(audit, None))
        if edit == "D":
            continue
        if edit == "R":
            role, state = MADE[state]
            role = ROLES[role]
        else:
            role = r["role"]
            state = NEXT[state][role[0]]
        yield edit, role, r["text"], place
        place += 1
    yield from put_in(next(audit, None))


def repair(
    df: DataFrame, also: DataFrame | None = None, turns: bool = False,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """Per conversation conv_id, ``COUNTS``, cost, audit and the digest of its repaired text.

    The repaired text has a line ``role:text`` per turn.  With ``turns`` the repaired turns themselves are
    returned instead: conv_id, place, edit, role, text; deleted ones are left out.
    """
    rows = named(df, conv_id, turn, role, text)
    id_type = rows.schema["conv_id"].dataType
    found = stage(diagnose(rows, also), "turn-signatures")
    solved = stage(solve(found), "turn-audits")
    heads = found.join(solved, "reverse").drop("reverse")
    wide = rows.select("conv_id", F.lit(1).alias("kind"), "turn", said(F.col("role"), F.col("text")).alias("said"), "role", "text")
    both = wide.unionByName(heads.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "said")
    report = [*COUNTS, "cost", "audit"]

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
        return groupby((r for batch in batches for r in batch.to_pylist()), lambda r: r["conv_id"])

    def as_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((conv, place, edit, *what) for conv, found in groups(batches) for edit, *what, place in edited(found))
        schema = [("conv_id", to_arrow_type(id_type)), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
        yield from batched(made, pa.schema(schema))

    def as_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, found in groups(batches):
                head = next(found)
                digest = hashlib.sha256()
                for _, role, text, place in edited(chain([head], found)):
                    digest.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
                yield conv, *(head[c] for c in report), digest.hexdigest()

        types = [to_arrow_type(id_type), *(pa.int64() for _ in report[:-1]), pa.string(), pa.string()]
        yield from batched(made(), pa.schema(list(zip(["conv_id", *report, "repaired_sha256"], types))))

    kind = id_type.simpleString()
    if turns:
        return ordered.mapInArrow(tidy(as_turns), f"conv_id {kind}, place long, edit string, role string, text string")
    return ordered.mapInArrow(
        tidy(as_digests), f"conv_id {kind}, {', '.join(f'{c} long' for c in report[:-1])}, audit string, repaired_sha256 string"
    )
