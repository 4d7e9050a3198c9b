import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.operators import tfidf


def test_terms_are_counted_over_batches_of_chunks(monkeypatch):
    monkeypatch.setattr(tfidf, "COUNTED", 3)
    lists = [["a", "b", "a", "b"], None, [], ["b"], ["a", "b"], ["b", "b", "b"]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string()))], ["words"])
    sums = {}
    for table in tfidf.grouped(iter([batch, batch.slice(3)])):
        for t, cf, df in zip(*tfidf.batch_counts(table["words"]).to_pydict().values()):
            held = sums.get(t, (0, 0))
            sums[t] = (held[0] + cf, held[1] + df)
    assert sums == {"a": (4, 3), "b": (12, 7), "a b": (4, 3), "b a": (1, 1), "b b": (4, 2)}


@pytest.mark.parametrize("size", [1, 3, 8, 20, 500])
def test_vocabulary_is_that_of_all_words_and_pairs(spark, monkeypatch, size):
    rng = random.Random(size)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", *(f"w{i}" for i in range(30))]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    words = [t.split() for t in texts]
    cf = Counter(term for w in words for term in [*w, *map(" ".join, zip(w, w[1:]))])
    chunks = spark.createDataFrame([(t,) for t in [*texts, ""]], "text string").repartition(3)
    counted = []
    monkeypatch.setattr(tfidf, "_summed", lambda words, counts, old=tfidf._summed: counted.append(old(words, counts)) or counted[-1])
    model = tfidf.fit(chunks, "text", size, [])
    assert model.vocabulary == sorted(cf, key=lambda term: (-cf[term], term))[:size]
    counts = counted[-1].count()  # pairs of rare words are left out
    assert counts == counted[-1].where(F.col("term").contains(" ")).count()
    assert size >= 20 or counts < sum(" " in term for term in cf)
