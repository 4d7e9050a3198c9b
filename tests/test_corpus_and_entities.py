import random
import re
import time

from pyspark.sql import functions as F

from factloom import fixed_values as fv
from factloom.operators import corpus, entities as en


def docs(spark, texts):
    rows = [(f"doc_{i}", i, "t", "", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, doc_seq bigint, title string, link string, text string")


def chunks_of(text, size, most):
    """Plain statement of the cutting rule."""
    out, at = [], 0
    while at < len(text) and (most is None or len(out) < most):
        piece = text[at : at + size]
        if at + size < len(text):
            cut = max(piece.rfind(". "), piece.rfind("\n"))
            if cut > size // 2:
                piece = piece[: cut + 1]
        if piece.strip():
            out.append(piece.strip())
        at += len(piece)
    return out


def test_char_chunks_against_brute_force(spark):
    rng = random.Random(5)
    texts = ["", "short", "a" * 50 + "\n" + "b" * 70, " " * 130 + "x" * 20, "a" * 25 + ". " + "b" * 80, "é. " * 90]
    texts += ["".join(rng.choice("ab .\né") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    for size, most in ((50, None), (50, 3), (7, None), (400, 2)):
        got = {i: [] for i in range(len(texts))}
        for r in corpus.char_chunks(docs(spark, texts), size, most).orderBy("doc_seq", "chunk_index").collect():
            got[r["doc_seq"]].append(r["chunk"])
            assert r["key"].startswith(f"doc_{r['doc_seq']}:{r['chunk_index']}:{len(r['chunk'])}:")
        assert got == {i: chunks_of(t, size, most) for i, t in enumerate(texts)}


def test_cutting_grows_with_the_text(spark):
    def seconds(n):
        table = docs(spark, ["A sentence of a text, é. " * (n // 25)]).cache()
        table.count()
        times = []
        for _ in range(2):
            started = time.perf_counter()
            assert corpus.char_chunks(table, 500).agg(F.sum(F.length("chunk"))).first()[0] > 0.9 * n
            times.append(time.perf_counter() - started)
        return min(times)

    seconds(400_000)
    assert seconds(1_600_000) < 9 * seconds(400_000)  # 4 in proportion, 16 if each cut read the whole rest


def test_windows(spark):
    sents = [f"Sentence number {i:03d} is long enough to stay in the text." for i in range(11)]
    table = docs(spark, [" ".join(sents), "Too short."])
    flat = corpus.windows(table, 4, 4, 80).orderBy("chunk_ix").collect()
    assert [r["text"] for r in flat] == [" ".join(sents[i : i + 4]) for i in (0, 4, 8)]
    slid = corpus.windows(table, 5, 3, 80).orderBy("chunk_ix").collect()
    assert [r["text"] for r in slid] == [" ".join(sents[i : i + 5]) for i in (0, 3, 6, 9)]


def find(dictionary, text):
    found = []
    for _, alias, entity in dictionary.ranked_aliases:
        pattern = re.escape(alias)
        if alias not in dictionary.unbounded:
            pattern = rf"(?<![A-Za-z0-9]){pattern}(?![A-Za-z0-9])"
        if entity.name not in found and re.search(pattern, text, re.I):
            found.append(entity.name)
    return found


def test_linking_against_brute_force(spark):
    d = en.DEFAULT_DICTIONARY
    assert (len(d.entities), len(d.ranked_aliases)) == (63, 204)
    aliases = [a for _, a, _ in d.ranked_aliases]
    rng = random.Random(3)
    texts = [
        "give it to us now", "the bus", "EV uptake rose", "campUS EV market", "FU.S.x", "TSLA and tesla",
        "a $7,500 incentive; the full $7,500 incentives", "top U.S. metropolitan areas (ZEV)", "",
        "Mercedes-Benz Group, mercedes", "zero-emission vehicle (ZEV) regulations",
    ]
    for _ in range(150):
        parts = [rng.choice(aliases) for _ in range(rng.randint(1, 4))]
        texts.append("".join(p + rng.choice([" ", ", ", "x", "-", "\n"]) for p in parts))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = {i: find(d, t) for i, t in enumerate(texts)}
    inline = en.with_entities(df, "t", d).collect()
    assert {r["i"]: [e["entity"] for e in r["entities"]] for r in inline} == want
    odd = spark.createDataFrame([(None, "Tesla"), (1, "BYD"), (1, "Tesla"), (1, None)], "i int, t string")
    ways = [sorted((str(r["t"]), [e["entity"] for e in r["entities"] or []]) for r in en.with_entities(odd, "t", d, by_join=way).collect()) for way in (False, True)]
    assert ways[0] == ways[1]
    joined = en.link_by_join(df, "t", d).collect()
    assert {r["i"]: [e["entity"] for e in r["entities"]] for r in joined} == want


def test_name_resolution(spark):
    cases = {
        "TSLA": "Tesla", "u.s.": "United States", "EV uptake": "EV adoption", "doc:x": "doc:x",
        "metric:Tesla": "metric:Tesla", " Unknown  Co ": "Unknown Co", "": "", "mercedes benz": "Mercedes-Benz",
    }
    df = spark.createDataFrame([(k, k) for k in cases], "given string, name string")
    rows = en.resolve_names(df, ["name"], en.DEFAULT_DICTIONARY).collect()
    assert {r["given"]: r["name"] for r in rows} == cases


def test_corpus_files(spark, tmp_path):
    good = "Query: q\r\nTitle: T\r\nLink: http://x\r\nSnippet: S\r\n\r\nFull Content:\r\nBody of text.\r\n"
    (tmp_path / "doc_10.txt").write_bytes(good.encode())
    (tmp_path / "doc_9.txt").write_bytes(b"no header \xff\xfe")
    (tmp_path / "other.txt").write_text("x")
    from factloom.sources import files

    rows = files.read_corpus(spark, str(tmp_path)).orderBy("doc_seq").collect()
    assert [r["doc_id"] for r in rows] == ["doc_9", "doc_10"]
    assert rows[0]["title"] == "doc_9" and rows[0]["text"] == ""
    assert rows[1]["text"] == "T\nS\nBody of text." and rows[1]["link"] == "http://x"


def test_corpus_limit(spark):
    raw = spark.createDataFrame([("doc_1", 1, "p", "Full Content:" + "ab " * 40_000)], "doc_id string, doc_seq bigint, path string, raw string")
    size = lambda **kw: corpus.parse_raw(raw, **kw).select(F.length("text")).first()[0]
    assert size(max_chars=fv.CORPUS_MAX_CHARS) == fv.CORPUS_MAX_CHARS
    assert size() == 119_999
