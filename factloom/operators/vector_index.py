"""Dense vectors in an inverted file: lists around centroids, read where a query needs them.

Centroids are fitted to a bounded sample (the ``sample`` vectors of least id hash); every vector is then
put into the list of its nearest centroid.  The lists are a parquet table, sorted by list and dealt by
list and id, so a large list spreads over files and a search reads the row groups of its lists.  A search
probes the nearest lists of a query and scores what they hold exactly, one batch of a task at a time; a
task hands on the best ``k`` of a query.  With all lists probed the result is that of the exact search.

Vectors may be added later; they go to the lists of the centroids as they are.  Vectors of length zero
and null vectors are in no list: they have no direction, and a cosine with them does not exist.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.session import ship

SAMPLE = 20_000  # vectors that the centroids are fitted to, at most
QUERIES = 2_000  # queries that travel to the tasks at once
PLACES = 9
CELLS = 1 << 20  # rows of a step times queries, at most


def as_matrix(lists: pa.Array, size: int) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=float).reshape(len(lists), size)


def length(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def usable(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("vec").isNotNull() & (length(F.col("vec")) > 0))


@dataclass(frozen=True)
class VectorIndex:
    """``path`` holds ``centroids (list, vec)`` and ``lists (list, item_id, vec)``."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, items: DataFrame, path: str, n_lists: int = 64, sample: int = SAMPLE, seed: int = 7) -> VectorIndex:
        """``items (item_id, vec)``; ``vec`` is an array of one length."""
        few = usable(items).orderBy(F.xxhash64("item_id"), "item_id").limit(sample)
        unit = F.transform("vec", lambda x: x.cast("double"))
        spread = few.select(array_to_vector(unit).alias("features"))
        # Lists gather directions, as the cosine does.
        model = KMeans(k=n_lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(spread)
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        items.sparkSession.createDataFrame(rows, "list int, vec array<double>").write.parquet(f"{path}/centroids")
        index = cls(items.sparkSession, path)
        index.add(items)
        return index

    def centroids(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").toArrow()
        vectors = np.array(rows["vec"].to_pylist(), dtype=float)
        return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)

    def add(self, items: DataFrame) -> None:
        """One more part of the lists."""
        ship(self.spark)
        centroids = self.centroids()

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                nearest = (as_matrix(batch["vec"], centroids.shape[1]) @ centroids.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(nearest, pa.int32()), batch["item_id"], batch["vec"]], ["list", "item_id", "vec"])

        kinds = {f.name: f.dataType.simpleString() for f in items.schema}
        rows = usable(items).select("item_id", "vec").mapInArrow(assign, f"list int, item_id {kinds['item_id']}, vec {kinds['vec']}")
        dealt = rows.repartitionByRange("list", "item_id").sortWithinPartitions("list", "item_id")
        dealt.write.mode("append").parquet(f"{self.path}/lists")

    def items(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def search(self, queries: DataFrame, k: int, probes: int = 8) -> DataFrame:
        """``queries (qid, vec)`` to ``(qid, rank, item_id, cosine, list)``, the best ``k`` in the ``probes`` nearest lists."""
        centroids = self.centroids()
        asked = usable(queries).select("qid", "vec")
        parts = max(1, -(-asked.count() // QUERIES))
        found = [self._portion(asked.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i), centroids, k, probes) for i in range(parts)]
        whole = found[0]
        for more in found[1:]:
            whole = whole.unionByName(more)
        best = Window.partitionBy("qid").orderBy(F.desc("cosine"), "item_id")
        ranked = whole.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return ranked.select("qid", "rank", "item_id", "cosine", "list")

    def probes_for(self, queries: DataFrame, k: int, target: float = 0.9, sample: int = 500) -> int:
        """The fewest probes with which ``sample`` of the queries find the share ``target`` of their exact best ``k``.

        How many lists a query needs depends on the data, so it is measured: the exact neighbours are looked
        up, and the place of their lists among those nearest to the query is counted.
        """
        few = usable(queries).orderBy(F.xxhash64("qid"), "qid").limit(sample).select("qid", "vec")
        rows = few.toArrow()
        centroids = self.centroids()
        vectors = np.array(rows["vec"].to_pylist(), dtype=float).reshape(len(rows), centroids.shape[1])
        order = np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")
        place = {q: {int(c): i for i, c in enumerate(o)} for q, o in zip(rows["qid"].to_pylist(), order)}
        exact = self.search(few, k, len(centroids)).select("qid", "list").collect()
        needed = sorted(place[x["qid"]][x["list"]] for x in exact)
        return needed[max(0, int(np.ceil(target * len(needed))) - 1)] + 1 if needed else 1

    def _portion(self, asked: DataFrame, centroids: np.ndarray, k: int, probes: int) -> DataFrame:
        rows = asked.toArrow().combine_chunks()
        qids, vectors = rows["qid"].combine_chunks(), np.array(rows["vec"].to_pylist(), dtype=float).reshape(len(rows), centroids.shape[1])
        vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        probes = min(probes, len(centroids))
        nearest = np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")[:, :probes]
        wanted = np.zeros((len(vectors), len(centroids)), bool)
        np.put_along_axis(wanted, nearest, True, axis=1)
        lists = self.items().where(F.col("list").isin([int(i) for i in np.unique(nearest)]))
        return _scored(lists, qids, vectors, wanted, k, asked.schema["qid"].dataType.simpleString())


def _scored(lists: DataFrame, qids: pa.Array, vectors: np.ndarray, wanted: np.ndarray, k: int, qid_type: str) -> DataFrame:
    """Of each task over ``lists (list, item_id, vec)`` the best ``k`` of a query in the lists it wants."""
    item_type = lists.schema["item_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bar = np.full(len(vectors), -np.inf)
        held: dict[int, list[tuple]] = {}
        step = max(1, CELLS // max(1, len(vectors)))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            matrix = as_matrix(batch["vec"], vectors.shape[1])
            cosine = np.round((matrix @ vectors.T) / np.linalg.norm(matrix, axis=1)[:, None], PLACES)
            good = wanted[:, np.asarray(batch["list"])].T & (cosine >= bar)
            ids = batch["item_id"]
            for q in np.flatnonzero(good.any(axis=0)):
                rows = np.flatnonzero(good[:, q])
                if len(rows) > k:  # no row below the k-th best of the batch
                    rows = rows[cosine[rows, q] >= np.partition(cosine[rows, q], -k)[-k]]
                best = held.get(q, []) + [(-cosine[i, q], ids[int(i)].as_py(), batch["list"][int(i)].as_py()) for i in rows]
                held[q] = sorted(best)[:k]
                if len(held[q]) == k:
                    bar[q] = -held[q][-1][0]
        flat = [(q, item, -cosine, of) for q, best in held.items() for cosine, item, of in best]
        if flat:
            q, item, cosine, of = zip(*flat)
            columns = [qids.take(pa.array(q)), pa.array(item, batch["item_id"].type), pa.array(cosine), pa.array(of, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["qid", "item_id", "cosine", "list"])

    return lists.mapInArrow(score, f"qid {qid_type}, item_id {item_type}, cosine double, list int")


def exact_nearest(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The ``k`` items of greatest cosine per query, ``(qid, rank, item_id, cosine)``, without an index.

    All pairs are scored, a portion of the queries and some rows at a time, so memory is bounded; the work
    is queries times items.
    """
    ship(items.sparkSession)
    asked = usable(queries).select("qid", "vec")
    rows = usable(items).select(F.lit(0).alias("list"), "item_id", "vec")
    parts = max(1, -(-asked.count() // QUERIES))

    def portion(i: int) -> DataFrame:
        few = asked.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i).toArrow().combine_chunks()
        vectors = np.array(few["vec"].to_pylist(), dtype=float).reshape(len(few), -1 if len(few) else 1)
        vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        found = rows if len(few) else rows.limit(0)
        kind = asked.schema["qid"].dataType.simpleString()
        return _scored(found, few["qid"].combine_chunks(), vectors, np.ones((len(few), 1), bool), k, kind)

    whole = reduce(DataFrame.unionByName, map(portion, range(parts)))
    best = Window.partitionBy("qid").orderBy(F.desc("cosine"), "item_id")
    ranked = whole.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("qid", "rank", "item_id", "cosine")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Queries, and the share of the exact neighbours that were found, as one row."""
    hits = exact.select("qid", "item_id").join(found.select("qid", "item_id", F.lit(1).alias("hit")), ["qid", "item_id"], "left")
    return hits.agg(F.countDistinct("qid").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
