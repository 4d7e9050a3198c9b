"""Operators against plain versions, on a table of odd rows and on whole small tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from factloom.llm import (
    fertility,
    fingerprints,
    language,
    minhash,
    mixing,
    packing,
    queries,
    sharding,
    suffix_dedup,
    token_counts,
    url_reputation,
)
from factloom.llm.anchors import anchors
from factloom.llm.tokens import encoder, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _place string, cls string, rk string"


def odd_texts():
    random.seed(11)
    words = ["alpha", "Beta", "gamma,", "delta", "été", "über", "x1", "#tag", "don't", "zeta."]
    base = " ".join(random.choice(words) for _ in range(120))
    near = base.replace("alpha", "omega", 1)
    return [
        None,
        "",
        " \t\n ",
        "one",
        "one",
        "1234 5678 !!",
        base,
        base,
        near,
        base.upper(),
        " ".join(random.choice(words) for _ in range(30_000)),
        "word " * 400,
        "same line here\nsame line here\nother\n" * 3,
        "<|endoftext|> in a text <|startoftext|>x",
        "日本語のテキスト и русский текст",
        "a" * 5_000,
        *(" ".join(random.choice(words) for _ in range(random.randint(1, 60))) for _ in range(20)),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    texts = odd_texts()
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "a", "b", "é"][i % 4], 0, "p", "c", "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), texts


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_near_duplicates(odd, empty, spark):
    df, texts = odd
    found = by_id(minhash.near_duplicates(df))
    comps, sizes = brute.components(list(enumerate(texts)))
    assert {i: r.component_id for i, r in found.items()} == comps
    assert {i: r.n_shingles for i, r in found.items()} == sizes
    assert all(r.kept == (i == r.component_id) for i, r in found.items())
    assert minhash.near_duplicates(empty).count() == 0
    twice = minhash.near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a  b")], "doc_id long, text string"))
    assert {r.component_id for r in twice.collect()} == {3}


def test_near_duplicates_of_unclear_ids(spark):
    """Links are those of the texts, whether one id has several texts or none; one row of each group stays."""
    random.seed(8)
    one, two, other = (" ".join(f"w{random.randrange(10**9)}" for _ in range(150)) for _ in range(3))
    near_one, near_two = (f"new {t.split(' ', 1)[1]}" for t in (one, two))
    rows = [(1, one), (1, two), (2, near_one), (None, near_two), (None, other), (None, other + " more"), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(set(brute.components(list(enumerate(t for _, t in rows)))[0].values())) == 5
    groups = Counter(r.component_id for r in minhash.near_duplicates(df).collect())
    assert groups == {1: 4, None: 2, 7: 2}
    kept = {tuple(r) for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert len(kept) == 4 and kept > {(1, one), (1, two), (7, None)}


def test_near_duplicates_chain(spark):
    """Links that no leader sees are found by rarest shingles."""
    random.seed(2)
    words = [f"w{random.randrange(10**9)}" for _ in range(200)]
    docs = []
    for i in range(60):
        mine = list(words)
        for j in range(i % 6):
            mine[random.randrange(200)] = f"u{i}-{j}"
        docs.append((i, " ".join(mine)))
    found = by_id(minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {i: r.component_id for i, r in found.items()} == brute.components(docs)[0]


def test_near_stage_links_at_80_percent(spark):
    """Pairs of likeness 0.80 to 0.85 go, those below stay; the bar follows the threshold."""
    random.seed(6)
    docs = []
    for i in range(60):
        words = [f"w{random.randrange(10**9)}" for _ in range(200)]
        docs.append((2 * i, " ".join(words)))
        for at in random.sample(range(10, 190, 6), 4 + (i % 3 == 0)):
            words[at] = f"u{i}-{at}"
        docs.append((2 * i + 1, " ".join(words)))
    comps = brute.components(docs, percent=80)[0]
    assert len(set(comps.values())) == 80 and len(set(brute.components(docs, percent=85)[0].values())) == 120
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id for r in kept.collect()} == set(comps.values())
    assert [minhash.least_agreeing(p) for p in (80, 85)] == [35, 40]


@pytest.mark.parametrize("bucket_rows", [3, 8192])
def test_repeats(spark, bucket_rows):
    random.seed(5)

    def some(n):
        return "".join(random.choice("abcd é") for _ in range(n))

    p, q = some(60), some(25)
    texts = [some(random.randint(0, 60)) + random.choice([p, q, p[10:], q + p, some(30), "aa" * 60]) + some(random.randint(0, 60)) for _ in range(60)]
    texts += [None, "", "x", p * 6, p + q, p + q]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = by_id(suffix_dedup.repeated_strings(df, length=40, q=12, bucket_rows=bucket_rows))
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for _, r in sorted(found.items())]
    assert got == brute.repeats(texts, 40)


def test_repeats_odd_rows(odd, empty):
    df, texts = odd
    found = by_id(suffix_dedup.repeated_strings(df))
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for _, r in sorted(found.items())]
    assert got == brute.repeats(texts, 200)
    cut = by_id(suffix_dedup.cut_repeats(df))
    assert cut[0].text is None and cut[6].text == "" and cut[3].text == "one"
    assert suffix_dedup.cut_repeats(empty).count() == 0


def test_anchors_meet():
    """Equal strings have an anchor at the same place, in short, joined and long texts."""
    random.seed(1)
    same = bytes(random.randrange(97, 123) for _ in range(200))
    texts = [bytes(random.randrange(97, 123) for _ in range(n)) + same + b"zz" for n in (0, 50, 700_000, 3)]
    places = []
    for text, (at, _) in zip(texts, anchors(texts, 200, 64)):
        start = text.index(same)
        places.append({int(x) - start for x in at if start <= x <= start + 136})
    assert set.intersection(*places)


def test_mixing(odd, empty):
    df, texts = odd
    found = mixing.mix(df, block=8, fan_in=2).collect()
    sizes = Counter()
    for r in found:
        sizes[r.source] += r.size
    targets = brute.targets(dict(sizes))
    taken = Counter()
    largest = Counter()
    for r in found:
        assert r.size == len(brute.WORD.findall(texts[r.doc_id] or "")) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1 for s in sizes)
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5), block=8, fan_in=2).collect()), key=str)
    assert sum(r.copies for r in found) == mixing.repeated(df, block=8, fan_in=2).count()
    assert mixing.mix(empty).count() == 0


def test_mixing_is_unbiased(spark):
    """Expected copies are the fractional ones."""
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "s") for i in range(4000)], "doc_id long, text string, source string")
    rows = mixing.mix(df, share=0.5, block=512).collect()
    for size in range(1, 8):
        mine = [r.copies for r in rows if r.size == size]
        assert abs(np.mean(mine) - 0.5) < 0.1


def test_packing(odd, empty):
    df, texts = odd
    coder = encoder(vocabulary("word_bpe_49k.json")).tokenizer
    ids = {i: np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    pieces = packing.pack_texts(df, limits=packing.Limits(segments=5)).collect()
    at, room, segments = Counter(), Counter(), Counter()
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert p.start == at[p.doc_id] and zlib.crc32(part.tobytes()) == p.ids_crc32 and p.doc_tokens == len(ids[p.doc_id])
        at[p.doc_id] += p.length
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == room[p.sequence_id]
        room[p.sequence_id] += p.length
        segments[p.sequence_id] += 1
    assert at == {i: len(x) for i, x in ids.items()} and max(room.values()) <= 2048 and max(segments.values()) <= 5
    assert packing.pack_texts(empty).count() == 0


def test_packing_under_loss_limit():
    random.seed(4)
    limits = packing.Limits(tokens=100, segments=4, loss_tokens=40, pool=16, least_cut=4)
    packer = packing.Packer(limits)
    examples = [packing.Example(i, np.arange(n, dtype=np.uint32), np.arange(n) % 3 == 0) for i, n in enumerate(random.choices(range(1, 250), k=300))]
    want = {e.key: len(e.ids) for e in examples}
    pieces = [x for e in examples for x in packer.add(e)] + list(packer.rest())
    tokens, loss, segments, got = Counter(), Counter(), Counter(), Counter()
    for n, offset, p in pieces:
        assert offset == tokens[n]
        tokens[n] += len(p.ids)
        loss[n] += int(p.loss.sum())
        segments[n] += 1
        got[p.key] += len(p.ids)
    assert got == want and max(tokens.values()) <= 100 and max(loss.values()) <= 40 and max(segments.values()) <= 4


def test_token_counts(odd, empty):
    df, texts = odd
    coder = encoder(vocabulary("word_bpe_49k.json")).tokenizer
    for i, r in by_id(token_counts.count_tokens(df)).items():
        n = len(coder.encode(texts[i] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[i] or "").encode()), n, n > 2048)
    assert token_counts.count_tokens(empty).count() == 0


def test_stretches_are_exact():
    random.seed(3)
    coder = encoder(vocabulary("word_bpe_49k.json"))
    signs = "ab'Z<|>12 \tñ\u0301é😀 #endoftext\u00a0Σς"
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, coder.encode_all(texts)):
        assert np.frombuffer(ids, np.uint32).tolist() == coder.tokenizer.encode(text, add_special_tokens=False).ids


def test_language(spark, sf, odd, empty):
    rows = [r for r in queries.op5_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect() if r.held_out]
    assert sum(r.lang == r.lang_pred for r in rows) > 0.95 * len(rows)
    df, texts = odd
    model = language.fit(df)
    for i, r in by_id(language.identify(df, model)).items():
        lettered = any(c.isalpha() for c in texts[i] or "")
        assert (r.lang_pred == "und") == (not lettered) and 0 <= r.score <= 1
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}


def test_spans_of_mixed_text():
    scores = np.full((12, 2), -5.0)
    scores[:5, 0] = scores[5, 1] = scores[6:8, 0] = scores[8:, 1] = 0
    single, mixed = language.one_label(scores, np.array([12]), 8.0)
    assert single[0] == 0 and mixed[0]
    assert language.best_paths([scores], 8.0)[0].tolist() == [0] * 8 + [1] * 4


def test_shards(odd, empty):
    df, texts = odd
    rows = sharding.shard_by_bytes(df, 4, blocks=3).collect()
    sizes = {i: len((t or "").encode()) + 8 for i, t in enumerate(texts)}
    start = 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        middle, total = start + sizes[r.doc_id] / 2, sum(sizes.values())
        assert (r.size, r.shard) == (sizes[r.doc_id], int(middle * 4 / total))
        assert r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        start += r.size
    for shard in range(4):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(empty, 4).count() == 0


def test_fingerprints(odd, empty, spark):
    df, texts = odd
    found = by_id(fingerprints.fingerprint_edits(df))
    for i, r in found.items():
        text, after = texts[i] or "", texts[i - 1] or ""
        k = len(text) // 3
        assert r.edited_sha256 == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest() and r.n_chars == len(text)
    assert found[6].fingerprint == found[7].fingerprint != found[8].fingerprint
    assert found[7].near_next == 1.0 and 0.5 < found[10].jaccard_edited < 0.8
    assert fingerprints.fingerprint_edits(empty).count() == 0
    one = spark.createDataFrame([(None, "a b"), (None, "c d")], "doc_id long, text string")
    assert fingerprints.fingerprint_edits(one).count() == 2


def test_sketches_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"b{i}" for i in range(40))
    row = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, ab string")
    s = {c: fingerprints.sketch(F.col(c)) for c in row.columns}
    got = row.select(fingerprints.merged(s["a"], s["b"]).alias("m"), s["ab"].alias("ab"), fingerprints.containment(s["b"], s["ab"]).alias("c")).first()
    assert set(got.m) <= set(got.ab) and len(got.ab) - len(got.m) <= 4 and got.c >= 0.5


def test_short_excerpts_are_contained(spark):
    """Excerpts of 5 to 20 words lie wholly in their document, and likeness is that of the full sets."""
    random.seed(12)
    rows = []
    for i in range(200):
        words = [f"w{random.randrange(10**9)}" for _ in range(random.randint(300, 600))]
        at, n = random.randrange(250), random.choice([5, 8, 12, 20])
        rows.append((" ".join(words[at : at + n]), " ".join(words)))
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))
    found = df.select("a", "b", fingerprints.containment(a, b).alias("share"), fingerprints.resemblance(a, b).alias("like")).collect()
    assert all(r.share == 1.0 for r in found)
    for r in found:
        x, y = brute.shingles(r.a), brute.shingles(r.b)
        assert r.like == pytest.approx(len(x & y) / len(x | y))


def test_fraction_sketches(spark):
    """Sketches of a fraction: unions are exact, likeness is near that of the sets, thin pairs are told by whole sets."""
    random.seed(13)
    bits = fingerprints.FRACTION_BITS
    rows = []
    for i in range(120):
        words = [f"w{random.randrange(10**9)}" for _ in range(random.choice([3, 40, 100, 160, 400, 900]))]
        cut = random.randrange(len(words) + 1)
        rows.append((" ".join(words), " ".join(words[:cut] + [f"v{random.randrange(10**9)}" for _ in range(len(words) - cut)])))
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = (fingerprints.sketch(F.col(c), bits) for c in "ab")
    union = F.size(F.array_union(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))) - 1
    like = fingerprints.containment(a, b)
    found = df.select("a", "b", like.alias("like"), fingerprints.merged(a, b, bits).alias("m"), fingerprints.merged(b, a, bits).alias("n"), union.alias("u")).collect()
    for r in found:
        x, y = brute.shingles(r.a), brute.shingles(r.b)
        assert r.m == r.n and r.u == len(x | y) and (r.m[0] == 0) == (r.u < fingerprints.KEEP_ALL)
        assert len(r.m) - 1 == r.u if r.m[0] == 0 else abs((len(r.m) - 1) - r.u / 2**bits) < 5 * r.u**0.5
        if r.like is not None:
            exact = len(x & y) / min(len(x), len(y))
            assert r.like == exact if max(len(x), len(y)) < fingerprints.KEEP_ALL else abs(r.like - exact) < 0.4
    errors = [r.like - len(brute.shingles(r.a) & brute.shingles(r.b)) / len(brute.shingles(r.a)) for r in found if len(r.a.split()) == 900]
    assert errors and sum(e * e for e in errors) / len(errors) < 0.05**2
    parts = df.where("size(split(a, ' ')) >= 5").select(fingerprints.sketch(F.concat_ws(" ", "a", "b"), bits).alias("ab"), a.alias("sa"), b.alias("sb"))
    for r in parts.collect():  # a text of both parts has at most four shingles more
        whole = {x for p in (r.sa, r.sb) for x in p[1:] if x < 1 << 60 - r.ab[0]}
        assert whole <= set(r.ab[1:]) and (r.ab[0] == 0 or len(r.ab) - 1 - len(whole) <= 4)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_likeness_of_edits(spark, kind):
    """Every likeness of the query against the sets, excerpts of 5 to 20 words beside their text included."""
    random.seed(14)
    texts = []
    for n in (5, 8, 12, 20, 60, 150) * 8:
        words = [f"w{random.randrange(10**9)}" for _ in range(random.randint(200, 700))]
        at = random.randrange(len(words) - n)
        texts += [" ".join(words), " ".join(words[at : at + n])]
    ids = [f"doc_{i:09d}" if kind == "string" else i for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, ids)), f"doc_id {kind}, text string, _place {kind}").repartition(3)
    found = by_id(fingerprints.fingerprint_edits(df))
    for i, text in enumerate(texts):
        r, after, k = found[ids[i]], texts[i - 1], len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, like, other in ((r.near_edited, r.jaccard_edited, edited), (r.near_next, r.jaccard_next, after)):
            x, y = brute.shingles(text), brute.shingles(other)
            assert near == pytest.approx(len(x & y) / min(len(x), len(y)), abs=0.3)
            assert like == pytest.approx(len(x & y) / len(x | y), abs=0.3)
        if i % 2:
            assert r.near_next == 1.0
    assert sum(len(r.fingerprint) for r in found.values()) < sum(map(len, texts))


def test_urls(spark):
    rules = queries.URL_RULES
    urls = ["http://A.example.NET/en/x?q#f", "https://x.example.net/en", "ftp://example.com/de/1", "http://org/fr/", "http://b.org/de/", None, "no scheme", "x://bad.info/p"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(100 + i, "http://bad.info/") for i in range(40)], "page_id long, url string")
    known = spark.createDataFrame([(100 + i, 0) for i in range(40)] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    found = {r.page_id: r for r in url_reputation.judge_urls(pages, known, rules).collect()}
    assert (found[0].host, found[0].path, found[0].rule, found[0].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (found[1].rule, found[1].verdict) == ("net/", "block") and found[2].rule == "example.com/de/"
    assert found[3].rule == "org/fr/" and found[4].rule is None
    assert found[5].host == found[6].host == found[5].path == "" and found[7].verdict == "block"
    none = url_reputation.judge_urls(pages.limit(0), known.limit(0), rules)
    assert none.count() == 0


def test_quality(odd, empty):
    df, texts = odd
    for i, r in by_id(fertility.judge(df)).items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(texts[i])
        assert not (r.base_failed and r.kept)
    assert fertility.judge(empty).count() == 0


def test_pipeline(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = corpus_pipeline.run(spark, sf)
    assert set(pieces.columns) >= {"doc_id", "sequence_id", "offset"} and pieces.count() > 0
    for source in (odd[0].drop("_place", "cls", "rk"), empty.drop("_place", "cls", "rk")):
        for name, step in corpus_pipeline.STAGES[:-1]:
            after = step(spark, source, sf)
            assert after.columns == docs.columns, name
            source = spark.createDataFrame(after.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, source, sf).count() >= 0


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
