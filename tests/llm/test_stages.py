"""Clashing names in every stage, fits that never come out empty, mixes that meet their targets."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import language, minhash, mixing, suffix_dedup

NAMES = (
    "_size _mine _mix_id _mix_rows _cut _cut_id _cut_sha _near_id _near_text lang_pred score row id cut kept cut_id cut_sha near_id near_text "
    "row_id row_source words copies rows place mine size target salt rid share block done sig cls comp key rk spans sha256"
).split()
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(2)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    shared = " ".join(rng.choice(words) for _ in range(60))
    texts = [shared, shared, None, "", *(" ".join(rng.choice(words) for _ in range(30)) for _ in range(12)), shared + " and more " + words[0]]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 2}", len(t or ""), *(f"{n}-{i}" for n in NAMES)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"{DOC}, {', '.join(f'`{n}` string' for n in NAMES)}").repartition(3)


STAGES = {
    "language": lambda df: corpus_pipeline.language_id(df.sparkSession, df, ""),
    "near": minhash.representatives,
    "repeats": suffix_dedup.cut_repeats,
    "mix": mixing.repeated,
}


@pytest.mark.parametrize("name", STAGES)
def test_names_of_the_caller_stay_as_they_are(clashing, name):
    found = STAGES[name](clashing)
    assert found.columns == clashing.columns
    rows = found.collect()
    assert rows and all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in NAMES)
    assert STAGES[name](clashing.limit(0)).count() == 0


def test_a_fit_is_never_empty(spark):
    many = spark.range(2_000_000).select(
        F.concat(F.lit("some english words number "), F.col("id")).alias("text"), F.lit("en").alias("lang")
    )
    assert language.fit(many, rows=1).languages == ["en"]
    rare = spark.range(5).select(F.concat(F.lit("quelques mots rares "), F.col("id")).alias("text"), F.lit("fr").alias("lang"))
    model = language.fit(many.limit(100_000).unionByName(rare), rows=2_000)
    assert model.languages == ["en", "fr"]
    assert language.identify(rare.withColumn("doc_id", F.lit(1)), model).select("lang_pred").distinct().collect()[0][0] == "fr"


def test_copies_of_a_text_are_learnt_once(spark):
    copies = spark.range(50_000).select(F.lit("one english text again").alias("text"), F.lit("en").alias("lang"))
    others = spark.range(300).select(F.concat(F.lit("other words "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    once = others.unionByName(copies.limit(1))
    a, b = (language.fit(df, rows=1_000) for df in (copies.unionByName(others), once))
    assert (a.weights == b.weights).all()


def by_source(rows):
    sums = defaultdict(lambda: [0, 0.0, set()])
    for r in rows:
        held = sums[r.source]
        held[0] += r.taken
        held[1] = r.target
        if r.size:
            held[2].add(r.size)
    return sums


def near_target(taken, target, sizes):
    return abs(taken - target) <= max(0.01 * target, min(sizes, default=0), 1)


def test_sources_with_one_very_long_text_come_near_their_targets(spark):
    rng = random.Random(6)
    rows = []
    for s in range(12):
        sizes = [rng.randint(4_000, 6_000), *(rng.randint(5, 500) for _ in range(49))]  # the others can make up for it
        rows += [(1000 * s + i, "w " * n, f"s{s:02}") for i, n in enumerate(sizes)]
    rows += [(None, "w " * 7, None)] * 500  # equal rows without id
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    for how in ({}, {"block": 16, "fan_in": 2}):
        found = mixing.mix(df, **how).collect()
        assert len(found) == len(rows) and all(r.taken <= 2 * r.size for r in found)
        for source, (taken, target, sizes) in by_source(found).items():
            assert near_target(taken, target, sizes), (source, taken, target)
    again = mixing.mix(df.repartition(3), block=16, fan_in=2).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, again))


def test_the_whole_table_comes_near_its_targets(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    for source, (taken, target, sizes) in by_source(mixing.mix(df).collect()).items():
        assert near_target(taken, target, sizes), (source, taken, target)


def test_equal_rows_spread_over_blocks(spark):
    df = spark.createDataFrame([(None, "w w w", None)] * 20_000, "doc_id long, text string, source string")
    rows = mixing.own(df, doc_id="doc_id", text="text")
    assert rows.count() == 20_000
    found = mixing.mix(df, share=0.5)
    assert abs(found.agg(F.sum("taken")).first()[0] - 0.5 * 60_000) <= 3
