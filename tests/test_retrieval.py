import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom import fixed_values as fv
from factloom.functions.rows import beside
from factloom.operators import answers, graph as g, retrieval as r, tfidf
from factloom.plans import catalog
from factloom.session import stage


def test_tfidf_against_formula(spark):
    texts = ["red fox and red dog", "the dog sleeps", "fox fox fox", "a", "sleeps the red"]
    stop = ["the", "and"]

    def terms(text):
        words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in stop]
        return words + [f"{a} {b}" for a, b in zip(words, words[1:])]

    counts = [Counter(terms(t)) for t in texts]
    total, df = Counter(), Counter()
    for c in counts:
        total.update(c)
        df.update(c.keys())
    vocab = sorted(total, key=lambda t: (-total[t], t))[:6]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in vocab}

    def vector(text):
        raw = {t: n * idf[t] for t, n in Counter(terms(text)).items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    chunks = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    model = tfidf.fit(chunks, "text", 6, stop)
    assert model.vocabulary == vocab and model.idf == pytest.approx([idf[t] for t in vocab])
    got = {row["i"]: {vocab[x["idx"]]: x["w"] for x in row["vec"]} for row in model.vectors(chunks, "text", ["i"]).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(vector(text))
    queries = spark.createDataFrame([(7, "a red fox")], "qid int, question string")
    sims = tfidf.cosine(model.vectors(queries, "question", ["qid"]), model.vectors(chunks, "text", ["i"]), ["i"])
    want = {i: sum(w * vector("a red fox").get(t, 0) for t, w in vector(x).items()) for i, x in enumerate(texts)}
    assert {x["i"]: x["sim"] for x in sims.collect()} == pytest.approx({i: s for i, s in want.items() if s > 0})


def test_flat_search_fills_up(spark):
    rows = [(f"doc_{i}", i, f"T{i}", 0, t, "k") for i, t in enumerate(["alpha beta", "gamma delta", "alpha gamma", "zz"])]
    chunks = spark.createDataFrame(
        rows, "doc_id string, doc_seq bigint, title string, chunk_ix int, text string, text_key string"
    )
    index = r.build_index(chunks, "t", 5, [])
    asked = spark.createDataFrame([(1, "alpha"), (2, "unknown")], "qid bigint, question string")
    cosine = r.flat_search(asked, index, 3).orderBy("qid", "rank").collect()
    assert [(x["qid"], x["source_id"]) for x in cosine if x["qid"] == 2] == [(2, "doc_0"), (2, "doc_1"), (2, "doc_2")]
    assert {x["source_id"] for x in cosine if x["qid"] == 1 and x["score"] > 0} <= {"doc_0", "doc_2"}
    assert len(cosine) == 6
    far = r.flat_search(asked, index, 3, "distance").collect()
    assert len(far) == 6 and all(0 < x["score"] <= 1 for x in far)
    with pytest.raises(ValueError):
        r.flat_search(asked, index, 3, "other")


def test_near_facts_equal_the_walk_over_documents(spark, sf):
    """Facts found by one hop between entities are those of the two-hop walk over all nodes."""
    bed = catalog.bed(spark, sf)
    near = r.edges_in_reach(bed.seeds, bed.graph.edges)
    dist = stage(g.bounded_walk(g.both_ways(bed.graph.edges), bed.seeds, 2), "walk")
    s = dist.select("qid", F.col("node").alias("source"), F.col("dist").alias("ds"))
    t = dist.select("qid", F.col("node").alias("target"), F.col("dist").alias("dt"))
    whole = (
        bed.graph.edges.where(F.col("relation") != fv.MENTIONED_IN)
        .join(s, "source")
        .join(t, ["qid", "target"])
        .where(F.least("ds", "dt") <= 1)
    )
    key = ["qid", *g.EDGE_KEY]
    want = {tuple(x[c] for c in key) + (min(x["ds"], x["dt"]),) for x in whole.collect()}
    assert {tuple(x[c] for c in key) + (x["dist"],) for x in near.collect()} == want and want


def test_answers(spark):
    asked = spark.createDataFrame(
        [(1, "Which tesla sales fell?"), (2, "Nothing here"), (3, "short")], "qid bigint, question string"
    )
    long = "Tesla sales fell in the first quarter of the year by a lot."
    evidence = spark.createDataFrame(
        [
            (1, 1, "doc_2", "T", f"Graph fact: A -[R]-> B. Supporting extraction: {long}", 3.0),
            (1, 2, "doc_1", "T", f"Graph-guided supporting chunk: {long}", 2.0),
            (1, 3, "doc_2", "T", long, 1.0),
            (3, 1, "doc_9", "T", "Too short.", 1.0),
        ],
        "qid bigint, rank int, source_id string, title string, text string, score double",
    )
    got = {x["qid"]: x["answer"] for x in answers.extractive_answers(asked, evidence).collect()}
    # The same sentence under different labels counts as different sentences.
    assert got[1] == f"{long} {long} {long} Sources: doc_2, doc_1."
    assert got[2] == fv.NO_EVIDENCE_ANSWER
    assert got[3] == "Too short. Sources: doc_9."
    scored = asked.select("qid", answers.answer_score(F.col("question"), F.lit("tesla fell. Sources: x.")).alias("s"))
    assert {x["qid"]: round(x["s"], 6) for x in scored.collect()} == {1: round(2 / 3 + 0.25, 6), 2: 0.25, 3: 0.25}


def test_verdicts_and_judgements(spark):
    rows = [("a", "b", 0.5, 0.68), ("a", "b", 0.41, 0.6), ("a", "b", 0.7, 0.5), ("a", "b", 0.5, 0.6)]
    weak = fv.NO_EVIDENCE_ANSWER
    df = spark.createDataFrame([*rows, (weak, weak, 0.0, 0.0)], "f string, g string, fs double, gs double")
    got = [x["v"] for x in df.select(answers.verdict(F.col("f"), F.col("g"), F.col("fs"), F.col("gs")).alias("v")).collect()]
    assert got == [fv.VERDICT_GRAPH, fv.VERDICT_GRAPH_OVER_WEAK_FLAT, fv.VERDICT_FLAT, fv.VERDICT_EVEN, fv.VERDICT_BOTH_WEAK]
    replies = [
        (1, '{"flat_score": "7.9", "graphrag_score": 11, "winner": "FlatRAG", "flat_hallucination": "false", "reason": " a  b"}'),
        (2, 'Result {"flat_score": -3, "graphrag_score": "x", "graphrag_hallucination": true} end'),
        (3, "broken"),
    ]
    parsed = answers.parse_judgements(spark.createDataFrame(replies, "qid int, reply string")).orderBy("qid").collect()
    assert [tuple(x)[1:] for x in parsed] == [
        (7, 10, "FlatRAG", False, False, "a b"), (0, 0, "Tie", False, True, ""), (0, 0, "Tie", False, False, "")
    ]


def test_questions_are_scored_beside_the_chunk(spark):
    """Nothing but the best k of each partition and question is shuffled, and no signal at all."""
    rows = [(f"doc_{i}", i, f"T{i}", 0, t, "k") for i, t in enumerate(["alpha beta 2023", "gamma delta", "alpha gamma", "zz"])]
    chunks = spark.createDataFrame(
        rows, "doc_id string, doc_seq bigint, title string, chunk_ix int, text string, text_key string"
    )
    index = r.build_index(chunks, "beside", 5, [], guided=True)
    asked = stage(spark.createDataFrame([(1, "alpha 2023"), (2, "unknown")], "qid bigint, question string"), "asked")
    plan = r.flat_search(asked, index, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "SortMergeJoin" not in plan
    signals = r.chunk_signals(asked, index)
    assert "hashpartitioning(qid#" not in signals._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    got = {(x["qid"], x["doc_seq"]): (x["sim"] > 0, x["shared"], x["markers"]) for x in signals.collect()}
    assert got == {(1, 0): (True, 1, 1), (1, 2): (True, 1, 0)}


@pytest.mark.parametrize("portion", [1, 2, 1000])
def test_beside_meets_every_question_once(spark, portion):
    items = spark.createDataFrame([(1,), (2,)], "i int")
    asked = spark.createDataFrame([(q,) for q in [1, 2, 3, None, 3]], "qid bigint")
    got = Counter((x["i"], x["q"]["qid"]) for x in beside(items, asked, "q", portion).collect())
    assert got == Counter((i, q) for i in (1, 2) for q in [1, 2, 3, None, 3])
    assert beside(items, asked.where("false"), "q", portion).count() == 0


def test_facts_of_documents_are_reached_as_by_the_walk(spark):
    """Facts with a document as an end: by one hop, or one mention away; the hub's other documents stay closed."""
    facts = [
        ("A", "MENTIONED_IN", "doc:1"), ("A", "MENTIONED_IN", "doc:2"), ("B", "MENTIONED_IN", "doc:1"), ("C", "MENTIONED_IN", "doc:2"),
        ("doc:1", "CITES", "doc:3"), ("doc:3", "CITES", "D"), ("B", "AUTHOR_OF", "doc:1"), ("C", "KNOWS", "E"), ("E", "KNOWS", "F"),
        ("A", "KNOWS", "C"), ("doc:9", "CITES", "F"), ("E", "REVIEWS", "doc:2"),
    ]
    edges = spark.createDataFrame(facts, "source string, relation string, target string")
    seeds = spark.createDataFrame([(1, "A"), (2, "F"), (3, "B")], "qid bigint, node string")
    dist = {(x.qid, x.node): x.dist for x in g.bounded_walk(g.both_ways(edges), seeds, 2).collect()}
    want = {}
    for q in (1, 2, 3):
        for s, rel, t in facts:
            ends = [dist.get((q, s)), dist.get((q, t))]
            if rel != "MENTIONED_IN" and None not in ends and min(ends) <= 1:
                want[q, s, rel, t] = min(ends)
    got = {(x.qid, x.source, x.relation, x.target): x.dist for x in r.edges_in_reach(seeds, edges).collect()}
    assert got == want and (1, "doc:1", "CITES", "doc:3") in got and (3, "B", "AUTHOR_OF", "doc:1") in got


def test_vectors_meet_votes_as_numbers_and_winners_meet_chunks_without_a_shuffle(spark):
    texts = [f"alpha beta word{i} gamma delta epsilon zeta eta theta number {i} more words here" for i in range(6)]
    chunks = spark.createDataFrame([(f"doc_{i}", i, f"doc_{i}", 0, t, f"k{i}") for i, t in enumerate(texts)], CHUNK)
    index = r.build_index(chunks, "small", 50, [], guided=True)
    votes = spark.createDataFrame([(1, "doc_2", 3), (1, "doc_4", 1), (2, "doc_2", 5)], "qid bigint, doc_id string, votes bigint")
    found = r.voted_vectors(index, votes, ["doc_id", "vec", "terms"])
    plain = {x["doc_id"]: x for x in index.vectors.collect()}
    got = {x["doc_id"]: x for x in found.collect()}
    assert sorted(got) == ["doc_2", "doc_4"] and found.schema["vec"].dataType.simpleString() == index.vectors.schema["vec"].dataType.simpleString()
    assert all(got[d]["vec"] == plain[d]["vec"] and got[d]["terms"] == plain[d]["terms"] for d in got)
    assert sorted(map(tuple, got["doc_2"]["voted"])) == [(1, 3), (2, 5)]
    asked = spark.createDataFrame([(1, "alpha word3 number"), (2, "beta word5")], "qid bigint, question string")
    top = r.flat_search(asked, index, 2)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(doc_id" not in plan
    assert {x["qid"]: x["source_id"] for x in top.collect() if x["rank"] == 1} == {1: "doc_3", 2: "doc_5"}


CHUNK = "doc_id string, doc_seq bigint, title string, chunk_ix int, text string, text_key string"
