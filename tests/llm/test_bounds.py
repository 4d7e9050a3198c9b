import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import language, minhash, mixing, packing, suffix_dedup
from factloom.session import stage


def test_open_texts_of_a_batch_are_settled_some_at_a_time(monkeypatch):
    weights = np.zeros((2 << language.BITS, 2), np.float32)
    for at, word in enumerate(("aaaa bbbb abab", "xxxx yyyy xyxy")):
        points, letter, *_ = language._words([word])
        for slots in language._slots(points, letter):
            weights[slots[letter], at] += 5.0
    uses = np.ones((len(language.NAMES), 2), bool)
    model = language.Model(["one", "two"], weights, uses)
    texts = ["aaaa bbbb abab aaaa xxxx yyyy xyxy", "xxxx yyyy xyxy", "aaaa bbbb xxxx yyyy xyxy xxxx yyyy"] * 40
    whole = language.label(model, texts)
    held = []
    paths = language.best_paths
    monkeypatch.setattr(language, "best_paths", lambda s, w: held.append(sum(map(len, s))) or paths(s, w))
    monkeypatch.setattr(language, "BLOCK", 100)
    monkeypatch.setattr(language, "OPEN_WORDS", 20)
    assert language.label(model, texts) == whole
    assert {len(x) for x in whole[2]} == {1, 2} and max(held) < 100


def test_need_of_empty_slots_never_fits():
    packer = packing.Packer(packing.Limits(tokens=8, loss_tokens=8, pool=4, least_cut=2))
    sizes, out = [8, 5, 3, 9, 7, 4, 1], []
    with np.errstate(all="raise"):
        for key, size in enumerate(sizes):
            out += packer.add(packing.Example(key, np.arange(size, dtype=np.uint32)))
        out += packer.rest()
    filled = {}
    for number, offset, piece in out:
        assert offset == filled.get(number, 0)
        filled[number] = offset + len(piece.ids)
    assert sum(filled.values()) == sum(sizes) and max(filled.values()) == 8


@pytest.fixture(scope="module")
def copies(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(60)) for _ in range(20)]
    rows = [(i, " ".join([f"w{i}", texts[i % 20], "end"]), f"s{i % 2}") for i in range(80)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_no_side_of_a_join_that_grows_goes_to_the_driver(spark, copies, monkeypatch):
    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name)

    monkeypatch.setattr(minhash, "stage", kept)
    found = minhash.near_duplicates(copies, percent=80)
    plans["near"] = found._jdf.queryExecution().executedPlan().toString()
    plans["mix"] = mixing.repeated(copies)._jdf.queryExecution().executedPlan().toString()
    plans["cut"] = suffix_dedup.cut_repeats(copies)._jdf.queryExecution().executedPlan().toString()
    assert found.agg(F.countDistinct("comp")).first()[0] == 20
    assert "near-postings" in plans and "near-rest" in plans
    assert "SortMergeJoin" in plans.pop("mix")  # the flips in it are few per source, and may travel
    assert [name for name, plan in plans.items() if "BroadcastHashJoin" in plan or "BroadcastNestedLoop" in plan] == []
