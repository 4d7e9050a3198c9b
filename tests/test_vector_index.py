"""The inverted file of vectors against the exact search."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from factloom.operators import vector_index
from factloom.operators.vector_index import VectorIndex, recall


@pytest.fixture(scope="module")
def vectors(spark, sf):
    return spark.read.parquet(f"{sf.replace('0.001', '0.01')}/embeddings.parquet").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"))


@pytest.fixture(scope="module")
def asked(vectors):
    """Every item whose id is divisible by 20, against all items."""
    return vectors.where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), "vec")


def rows(df):
    return sorted((x.qid, x.rank, x.item_id, round(x.cosine, 6)) for x in df.collect())


def test_all_lists_give_the_exact_search(vectors, asked, tmp_path):
    index = VectorIndex.build(vectors, f"file://{tmp_path}/index", n_lists=12)
    ids, matrix = zip(*((x.item_id, x.vec) for x in vectors.collect()))
    unit = np.array(matrix, float) / np.linalg.norm(np.array(matrix, float), axis=1, keepdims=True)
    want = []
    for q in range(0, len(ids), 20):
        cosine = np.round(unit @ unit[ids.index(q)], 9)
        best = sorted(zip(-cosine, ids))[:10]
        want += [(q, rank, item, round(-c, 6)) for rank, (c, item) in enumerate(best, 1)]
    assert rows(index.search(asked, 10, probes=12)) == sorted(want)
    assert index.items().count() == vectors.count()


def test_measured_probes_reach_the_recall(vectors, asked, tmp_path):
    index = VectorIndex.build(vectors, f"file://{tmp_path}/index", n_lists=16)
    exact = index.search(asked, 10, probes=16)
    probes = index.probes_for(asked, 10, 0.9)
    assert probes < 16
    row = recall(index.search(asked, 10, probes=probes), exact).first()
    assert row["queries"] == asked.count() and row["recall"] >= 0.9
    assert recall(index.search(asked, 10, probes=probes - 1), exact).first()["recall"] < 0.9


def test_added_vectors_are_found_and_odd_ones_are_left_out(spark, vectors, asked, tmp_path):
    index = VectorIndex.build(vectors.where("item_id < 300"), f"file://{tmp_path}/index", n_lists=8)
    index.add(vectors.where("item_id >= 300"))
    whole = VectorIndex.build(vectors, f"file://{tmp_path}/whole", n_lists=8)
    assert rows(index.search(asked, 5, probes=8)) == rows(whole.search(asked, 5, probes=8))
    odd = spark.createDataFrame([(9001, [0.0] * 64), (9002, None)], "item_id bigint, vec array<float>")
    index.add(odd)
    assert index.items().count() == vectors.count()
    found = index.search(asked.unionByName(odd.select(F.col("item_id").alias("qid"), "vec")), 1, probes=8)
    assert {x.qid: x.item_id for x in found.collect()} == {x.qid: x.qid for x in asked.collect()}


def test_steps_of_few_rows_give_the_exact_search_with_and_without_an_index(vectors, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "CELLS", 50)
    # A copy of each vector, so the ends of the best ten are ties, which go by id.
    twice = vectors.unionByName(vectors.withColumn("item_id", F.col("item_id") + 10_000))
    index = VectorIndex.build(twice, f"file://{tmp_path}/steps", n_lists=4)
    exact = rows(vector_index.exact_nearest(asked, twice, 9))
    assert exact == rows(index.search(asked, 9, probes=4))
    empty = vector_index.exact_nearest(asked.limit(0), vectors, 9)
    assert empty.count() == 0


def test_steps_bound_the_products_that_a_task_holds(monkeypatch):
    """A batch of any number of rows is held against the queries some rows at a time."""
    sizes = []
    monkeypatch.setattr(vector_index, "CELLS", 64)
    monkeypatch.setattr(vector_index, "as_matrix", lambda lists, size: sizes.append(len(lists)) or np.ones((len(lists), size)))

    class Items:
        schema = {"item_id": type("Field", (), {"dataType": LongType()})}

        def mapInArrow(self, task, schema):
            batch = pa.RecordBatch.from_arrays([pa.array([0] * 100, pa.int32()), pa.array(range(100)), pa.array([[1.0]] * 100)], ["list", "item_id", "vec"])
            return list(task(iter([batch])))

    (found,) = vector_index._scored(Items(), pa.array(range(8)), np.ones((8, 1)), np.ones((8, 1), bool), 3, "bigint")
    assert max(sizes) == 8 and sum(sizes) == 100
    assert found.num_rows == 24 and set(found["item_id"].to_pylist()) == {0, 1, 2}
