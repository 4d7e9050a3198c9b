"""The inverted index of questions against plain loops."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from factloom.operators import matching, retrieval as r

ITEM = "doc_id string, doc_seq bigint, chunk_ix bigint, text_key string, vec array<struct<idx:int,w:double>>, terms array<string>"
ASKED = "qid bigint, vec array<struct<idx:int,w:double>>, terms array<string>, more int"
SOURCES = {"vec": "vec", "terms": "terms"}


def lists(rng, n):
    vec = [(i, rng.choice([0.25, 0.5, 1.0])) for i in sorted(rng.sample(range(40), rng.randint(0, n)))]
    return vec, rng.sample([f"t{i}" for i in range(30)], rng.randint(0, n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    items = [(f"doc_{i // 3}", i // 3, i % 3, f"k{rng.randint(0, 40)}", *lists(rng, 6)) for i in range(200)]
    items += [("doc_none", 900, 0, None, [], []), ("doc_null", 901, 0, "k1", None, None)]
    asked = [(q, *lists(rng, 5), rng.choice([0, 0, 2])) for q in range(25)] + [(90, [], [], 0), (91, None, None, 0)]
    return items, asked, spark.createDataFrame(items, ITEM).repartition(5), spark.createDataFrame(asked, ASKED)


def score_of(item, question):
    sim = round(sum(w * dict(question[1] or []).get(i, 0.0) for i, w in item[4] or []), 12)
    return sim, len(set(item[5] or []) & set(question[2] or []))


def totals():
    """A scoring function that is sent to workers with its code, as they do not have this module."""

    def total(f, _=None):
        f.extra["score"] = f.sim() + f.sums["terms"]
        return f

    return total


@pytest.mark.parametrize("budget", [3, 40, matching.BUDGET])
def test_pairs_are_those_that_share_a_term(tables, monkeypatch, budget):
    monkeypatch.setattr(matching.portions, "__defaults__", (0, budget))
    items, asked, df, questions = tables
    want = {(q[0], *i[:3]): score_of(i, q) for q in asked for i in items if max(score_of(i, q)) > 0}
    values = lambda f: {"sim": f.sim(), "shared": f.sums["terms"].astype("int64")}
    found = matching.pairs(questions, df, ["doc_id", "doc_seq", "chunk_ix"], SOURCES, values, sim="double", shared="bigint").collect()
    assert len(found) == len(want)  # no row for a pair that shares nothing
    assert {(x.qid, x.doc_id, x.doc_seq, x.chunk_ix): (x.sim, x.shared) for x in found} == want


@pytest.mark.parametrize("cells", [1, 700, 1 << 20])
def test_best_of_each_task_holds_the_best_of_all(tables, monkeypatch, cells):
    monkeypatch.setattr(matching, "CELLS", cells)
    items, asked, df, questions = tables
    found = matching.best(questions, df, ["doc_id", "doc_seq", "chunk_ix", "text_key"], ["doc_seq", "chunk_ix"], SOURCES, totals(), 3, "text_key").collect()
    assert len(found) <= sum(3 + q[3] for q in asked) * df.rdd.getNumPartitions()
    got = defaultdict(dict)
    for x in found:
        at = (-x.score, x.doc_seq, x.chunk_ix)
        got[x.qid][x.text_key] = min(at, got[x.qid].get(x.text_key, at))
    for q in asked:
        texts = {}
        for i in items:
            if sum(score_of(i, q)) > 0:
                at = (-sum(score_of(i, q)), i[1], i[2])
                texts[i[3]] = min(at, texts.get(i[3], at))
        keep = 3 + q[3]
        assert sorted(got[q[0]].values())[:keep] == sorted(texts.values())[:keep]


def test_only_voted_documents_are_scored(tables, spark):
    items, asked, df, questions = tables
    votes = [(q[0], f"doc_{d}", d + 1) for q in asked[:10] for d in range(0, 40, 7)] + [(1, "doc_unknown", 3), (1234, "doc_0", 2)]
    voted = r.voted_documents(spark.createDataFrame(votes, "qid bigint, doc_id string, votes bigint"))

    total = totals()

    def score(f, part):
        f = r.with_votes(total(f), part)
        f.extra["score"] = f.extra["score"] + 100 * f.extra["votes"]
        return f

    found = matching.group_best(questions, df.join(voted, "doc_id"), "doc_id", SOURCES, score).collect()
    known = {(q, d): n for q, d, n in votes}
    want = {}
    for q in asked:
        for i in items:
            if (q[0], i[0]) in known and sum(score_of(i, q)) > 0:
                key = (q[0], i[0])
                want[key] = max(want.get(key, 0), sum(score_of(i, q)) + 100 * known[key])
    assert {(x.qid, x.doc_id): x.score for x in found} == want and want


def test_dense_and_sparse_ways_agree():
    rng = random.Random(8)
    kind = pa.list_(pa.struct([("idx", pa.int32()), ("w", pa.float64())]))
    some = lambda n: pa.array([[{"idx": i, "w": rng.random()} for i in sorted(rng.sample(range(12), rng.randint(0, 9)))] for _ in range(n)], kind)
    asked, items = some(7), some(50)
    part = matching.Portion(pa.array(range(7)), {"vec": matching.Postings.of(asked)}, np.full(7, 1))
    dense = next(part.matches(pa.record_batch({"vec": items}), {"vec": "vec"}))
    for row, question, value in zip(dense.row, dense.question, dense.sums["vec"]):
        a, b = ({x["idx"]: x["w"] for x in lists[int(at)].as_py()} for lists, at in ((items, row), (asked, question)))
        assert value == pytest.approx(sum(w * b.get(k, 0) for k, w in a.items()))
    assert len(dense.row) == sum(bool({x["idx"] for x in a} & {x["idx"] for x in b}) for a in items.to_pylist() for b in asked.to_pylist())


def test_no_questions_give_nothing(tables):
    _, _, df, questions = tables
    none = questions.where("false")
    assert matching.best(none, df, ["doc_id"], ["doc_seq", "chunk_ix"], SOURCES, totals(), 3).count() == 0
    plan = matching.group_best(questions, df, "doc_id", SOURCES, totals())._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("Exchange hash") <= 1
