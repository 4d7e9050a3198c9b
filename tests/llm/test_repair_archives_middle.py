"""Conversation repair, archives and fill-in-the-middle against plain versions, on odd rows and on whole small tables."""

import gzip
import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import brute_new as brute
from factloom.llm import conversation_repair as chats
from factloom.llm import fill_middle as fim
from factloom.llm import queries, warc

# --- conversations -----------------------------------------------------------------------------------

TURN = "conv_id long, turn long, role string, text string, kind string, audit string, said string, first string, reverse string"


def by_turn(rows):
    """Rows in the operator's order: null turns first, ties by digest of role and text."""

    def key(r):
        said = hashlib.md5(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest()
        return r[1] is not None, r[1] or 0, said

    return sorted(rows, key=key)


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]]
    for r in brute.damaged(rows):
        groups[r[0]].append(r)
    return {c: brute.conversation(by_turn(g)) for c, g in groups.items()}


def odd_turns():
    random.seed(5)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "a", "s"]
    texts = ["Hello there.", "Fine!", "cut off", " \t", "", None, "end.\n ", "été?", "x" * 3000 + ".", "no\x1fend"]
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(random.choice([1, 2, 3, 5, 8, 12, 30])):
            turn = random.choice([None, 0, 1, 2, 3, 5, 9, 10**9, -4])
            rows.append((conv, turn, random.choice(roles[:3] * 4 + roles), random.choice(texts)))
    rows += rows[:15]  # repeated rows
    return rows


def test_repair_of_odd_turns(spark):
    rows = odd_turns()
    df = spark.createDataFrame([(*r, "k", "a", "s", "f", "r") for r in rows], TURN).repartition(5)
    found = chats.repair(chats.damage(df), also=df.select("conv_id"))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r.conv_id: tuple(r)[1:] for r in found.collect()}
    assert got == expected(rows)


def test_repaired_turns_are_the_lines_of_the_digest(spark):
    rows = odd_turns()
    damaged = chats.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    lines = defaultdict(list)
    for r in chats.repair(damaged, turns=True).collect():
        lines[r.conv_id].append((r.place, f"{r.role}:{r.text}"))
    for r in chats.repair(damaged).collect():
        text = "\n".join(x for _, x in sorted(lines[r.conv_id]))
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256
        roles = "".join(x.split(":")[0][:1] for _, x in sorted(lines[r.conv_id]))
        assert not roles or roles.removeprefix("s").replace("ua", "") == ""


def test_repair_of_no_rows(spark):
    none = spark.createDataFrame([], TURN)
    assert chats.repair(chats.damage(none), also=none.select("conv_id")).collect() == []
    alone = chats.repair(none, also=spark.createDataFrame([(7,), (None,)], "conv_id long")).collect()
    assert {tuple(r) for r in alone} == {(c, 0, 0, 0, 0, 0, 0, "", brute.sha256("")) for c in (7, None)}


def test_repair_takes_ids_of_text_and_long_conversations(spark):
    rows = [("é", i, ("user", "assistant")[i % 2] if i % 7 else "tool", f"turn {i}{'.' if i % 5 else ''}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").repartition(7)
    r = chats.repair(df).collect()[0]
    assert (r.gaps, r.duplicate, r.truncated) == (0, 0, 600)
    assert len(r.audit) >= 3000 and r.audit.count("I") + 3000 == len(r.audit)


def test_automaton_against_all_edits(spark):
    random.seed(3)
    letters = {"s": ("s", None), "u": ("u", None), "a": ("a", None), "x": ("x", None), "U": ("u", "truncated"), "A": ("a", "truncated"), "S": ("s", "truncated"), "X": ("x", "truncated"), "-": ("u", "blank")}
    words = {"".join(random.choices("suaxUASX-", k=random.randint(0, 9))) for _ in range(600)}
    df = spark.createDataFrame([(w[::-1],) for w in words], "reverse string").repartition(3)
    for r in chats.solve(df).collect():
        found = [letters[c] for c in r.reverse[::-1]]
        assert (r.cost, r.audit) == brute.best_repair(tuple(x[0] for x in found), [x[1] for x in found]), r.reverse


def test_nodes_are_shared_from_the_end(monkeypatch):
    made = Counter()
    real = chats.node
    monkeypatch.setattr(chats, "node", lambda letter, rest: made.update([letter]) or real(letter, rest))
    captured = {}

    class Frame:  # runs the task on one batch, without a session
        def select(self, *_):
            return self

        distinct = repartitionByRange = sortWithinPartitions = lambda self, *_: self

        def mapInArrow(self, task, schema):
            captured["task"] = task
            return self

    chats.solve(Frame())
    ends = sorted(["au", "aua", "auas", "auaua", "uu"])
    rows = pa.Table.from_batches(captured["task"](iter([pa.record_batch({"reverse": ends})])))
    assert rows.num_rows == 5
    distinct_ends = {w[:i] for w in ends for i in range(1, len(w) + 1)}
    assert sum(made.values()) == len(distinct_ends)


def test_op11_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_repair_conversations(spark, sf).collect()}
    assert got == expected(rows)


# --- archives ----------------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string, record_id string, payload_key string, file string, http string, refers_to string"


def odd_pages():
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nhttp://x 0.0.0.0 20010101000000 text/html 5\nhello\n"
    pages = [None, "", "\n", "\r\n\r\n", tricky, tricky, "<p>été</p>", "<p>été</p>\n", "x" * 200_000, "", None, "a\nb\rc d\x00e"]
    return [(i, f"http://h{i % 3}.example/a b?{i}", p) for i, p in enumerate(pages)] + [(40, None, "only url is null"), (41, "", "")]


def test_archived_odd_pages(spark):
    pages = odd_pages()
    df = spark.createDataFrame([(*p, "a", "b", "c", "d", "e") for p in pages], PAGE).repartition(4)
    got = {r.page_id: tuple(r) for r in warc.archived(df).collect()}
    assert got == {x[0]: x for x in brute.archived([(i, h) for i, _, h in pages])}
    assert warc.archived(df.limit(0)).collect() == []


def test_archived_repeats_and_nulls(spark):
    rows = [(3, "u", "same"), (3, "u", "same"), (None, "u", "same"), (None, "v", "alone"), (2, "w", "small")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.record_type, r.refers_to) for r in warc.archived(df).collect()]
    assert sorted(got, key=str) == sorted(
        [(3, "response", None), (3, "revisit", 3), (None, "revisit", 3), (None, "response", None), (2, "response", None)], key=str
    )
    # Payloads below the bound are all kept.
    assert {r.record_type for r in warc.archived(df, least_bytes=5).where("payload_bytes = 4").collect()} == {"response"}
    named = spark.createDataFrame([("é b%", "u", "x"), ("a", "u", "x")], "page_id string, url string, html string")
    assert {tuple(r)[0::3] for r in warc.archived(named).collect()} == {("a", "response"), ("é b%", "revisit")}


def arc_file(folder, name, data):
    folder.mkdir(exist_ok=True)
    with gzip.open(folder / name, "wb") as out:
        out.write(data)
    return f"file://{folder}"


V1 = b"filedesc://old.arc 0.0.0.0 19961030120000 text/plain 71\n1 0 Some Body\nURL IP-address Archive-date Content-type Archive-length\n\n\n"


def test_legacy_versions_are_read_by_their_own_fields(spark, tmp_path):
    body = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n\xff\xfe\x00raw\nbytes"
    two = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    v2 = b"filedesc://new.arc 0.0.0.0 20020101000000 text/plain 200 - - 0 new.arc " + str(len(two) + 11).encode() + b"\n2 0 Other\n" + two + b"\n"
    one = b"http://a.example/with space 10.0.0.1 19990203 text/html " + str(len(body)).encode() + b"\n" + body + b"\n"
    other = b"dns:b.example 10.0.0.2 20020304050607 text/dns 200 - - 99 new.arc 4\n1\n\n2\n"
    arc_file(tmp_path / "arc", "one.arc.gz", V1 + one)
    path = arc_file(tmp_path / "arc", "two.arc.gz", v2 + other)
    found = {r.url: r for r in warc.read_arc(spark, path).where("warc_type <> 'warcinfo'").collect()}
    first, second = found["http://a.example/with space"], found["dns:b.example"]
    assert (first.date, first.ip, first.warc_type, bytes(first.payload), first.fault) == ("1999-02-03T00:00:00Z", "10.0.0.1", "response", b"\xff\xfe\x00raw\nbytes", None)
    assert (second.date, second.warc_type, second.content_type, bytes(second.payload)) == ("2002-03-04T05:06:07Z", "resource", "text/dns", b"1\n\n2")
    # The payload's bytes come through the conversion, and so do identifiers and digests.
    warc.convert(spark, path, f"file://{tmp_path}/warc")
    read = {r.record_id: r for r in warc.read_warc(spark, f"file://{tmp_path}/warc").collect()}
    for r in (first, second):
        again = read[r.record_id]
        assert (again.url, again.date, again.payload_digest, bytes(again.payload), again.fault) == (r.url, r.date, r.payload_digest, bytes(r.payload), None)
    assert sum(r.warc_type == "warcinfo" for r in read.values()) >= 2


def test_faults_are_rows(spark, tmp_path):
    good = b"http://a.example/ 1.1.1.1 20000101000000 text/plain 2\nok\n"
    short = b"http://b.example/ 1.1.1.1 20000101000000 text/plain 3\ntoo long\n"
    cut = b"http://c.example/ 1.1.1.1 20000101000000 text/plain 500\ncut"
    path = arc_file(tmp_path / "arc", "x.arc.gz", V1 + b"nonsense\n" + short + good + cut)
    found = [(r.url, r.fault) for r in warc.read_arc(spark, path).where("not url <=> 'filedesc://old.arc'").collect()]
    assert found == [(None, "header"), ("http://b.example/", "length"), ("http://a.example/", None), ("http://c.example/", "truncated")]
    warc.convert(spark, path, f"file://{tmp_path}/warc")
    assert Counter(r.warc_type for r in warc.read_warc(spark, f"file://{tmp_path}/warc").collect())["metadata"] == 3


def test_a_changed_payload_is_a_fault(spark, tmp_path):
    record = warc.warc_record("response", {"WARC-Record-ID": "<urn:x>", "WARC-Payload-Digest": "sha1:" + warc.digest(b"other"), "Content-Type": "application/http"}, b"HTTP/1.1 200 OK\r\n\r\nbody")
    path = arc_file(tmp_path / "warc", "x.warc.gz", record + b"\n")
    assert [r.fault for r in warc.read_warc(spark, path).collect()] == ["digest"]


def test_op12_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: tuple(r) for r in queries.op12_arc_to_warc(spark, sf).collect()}
    assert got == {x[0]: x for x in brute.archived([(p.page_id, p.html) for p in pages])}


# --- fill in the middle ------------------------------------------------------------------------------

DOC = "doc_id long, text string, row string, place string, at string, n string, form string, piece string"


def odd_documents():
    random.seed(9)
    parts = ["word", "Ab", " ", "\n", "é", "日本", "<", "P", ">", "𝄞", "\x00", "x9y", "  "]
    texts = [None, "", "a", "é", "<P>", "a<S>b", "<M", "ab" * 60_000, "é " * 40_000, "a b " * 30_000]
    texts += ["".join(random.choices(parts, k=random.randint(1, 40))) for _ in range(120)]
    return [*enumerate(texts), (None, "null id here"), (None, "null id here"), (3, "é"), (7, "ab" * 60_000)]


def test_fill_middle_of_odd_documents(spark):
    docs = odd_documents()
    df = spark.createDataFrame([(*d, "r", "p", "a", "n", "f", "x") for d in docs], DOC).repartition(5)
    got = fim.fill_middle(df).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute.fill_middle(*d) for d in docs)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_middle(df.limit(0)).collect() == []


def test_outputs_and_restored_texts(spark):
    docs = odd_documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    whole = fim.fill_middle(df, texts=True).withColumn("in_row", fim.restored_text(F.col("form"), F.col("output"))).collect()
    assert Counter((r.doc_id, r.restored) for r in whole) == Counter((i, t or "") for i, t in docs)
    assert all(r.in_row == r.restored and brute.sha256(r.output) == r.output_sha256 for r in whole)


def test_units_and_undo():
    for _, text in odd_documents()[:60]:
        raw = (text or "").encode()
        starts = fim.unit_starts(np.frombuffer(raw, np.uint8))
        units = [raw[a:b].decode() for a, b in zip(starts, chain(starts[1:], [len(raw)]))]
        assert units == re.findall("[A-Za-z]+|[^A-Za-z]", text or "")
    # However an output is cut, it comes apart at its marks.
    out = b"<S>suffix <<P>pre<fix<M>mid>dle"
    for size in range(1, len(out)):
        undo, found = fim.Undo("spm"), defaultdict(bytes)
        for i in range(0, len(out), size):
            for place, piece in undo.feed(out[i : i + size]):
                found[place] += piece
        for place, piece in undo.end():
            found[place] += piece
        assert found == {0: b"pre<fix", 1: b"mid>dle", 2: b"suffix <"}


def test_op13_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = queries.op13_fill_middle(spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()  # before it runs, so the first plan only
    assert plan.count("Exchange hash") == 1
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute.fill_middle(d.doc_id, d.text) for d in docs)
