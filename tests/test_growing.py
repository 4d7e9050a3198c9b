"""A graph grown from stored parts against the graph of all documents at once."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import entities as en, graph as g, growing, triples as tr

SCHEMA = "doc_id string, doc_seq bigint, title string, link string, chunk_index bigint, reply string"


def coerced(spark):
    rng = random.Random(3)
    names = ["Tesla", "BYD", "China", "a", "b", "c", None]
    rows = []
    for i in range(40):
        facts = ", ".join(
            '{"source": %s, "relation": "%s", "target": %s, "evidence": "%s", "confidence": %s}'
            % (
                *(f'"{x}"' if x else "null" for x in (rng.choice(names),)),
                rng.choice(["r", "s"]),
                *(f'"{x}"' if x else "null" for x in (rng.choice(names),)),
                rng.choice(["", *(f"e{k}" for k in range(12))]),
                rng.choice([0.1, 0.5, 1]),
            )
            for _ in range(rng.randint(0, 9))
        )
        rows.append((f"doc_{i}", i, f"Title {i}", f"link {i}", 0, '{"triples": [' + facts + "]}"))
    replies = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return tr.coerce_triples(tr.parse_replies(replies))


def tables(graph):
    read = ((graph.nodes, ["node"]), (graph.edges, g.EDGE_KEY), (graph.edge_sources, [*g.EDGE_KEY, "doc_id"]))
    return [[tuple(r) for r in df.select(sorted(df.columns)).orderBy(*key).collect()] for df, key in read]


def state(rows):
    return growing.state_of(*g.triple_parts(rows, en.DEFAULT_DICTIONARY))


def test_grown_graph(spark, tmp_path):
    triples = coerced(spark).cache()
    path = str(tmp_path / "graph")
    with pytest.raises(FileNotFoundError):
        growing.read_state(spark, path)
    thirds = [triples.where(F.col("doc_seq") % 3 == i) for i in range(3)]
    for i in (2, 0):  # the order of parts does not matter
        growing.store_part(state(thirds[i]), path, f"part-{i}")
    two = triples.where("doc_seq % 3 <> 1")
    built = g.build_from_triples(two, en.DEFAULT_DICTIONARY)
    assert tables(growing.graph_of(growing.read_state(spark, path))) == tables(built)
    assert built.edges.where("size(evidence) = 4").count() > 0 and built.nodes.where("mentions > 1").count() > 0

    # A part without a mark does not count; stored once more, it replaces what was left.
    broken = state(thirds[1].limit(5))
    broken.nodes.write.parquet(f"{path}/nodes/part=new")
    assert growing.parts(spark, path) == ["part-0", "part-2"]
    for _ in range(2):
        growing.store_part(state(thirds[1]), path, "new")
    whole = tables(g.build_from_triples(triples, en.DEFAULT_DICTIONARY))
    assert tables(growing.graph_of(growing.read_state(spark, path))) == whole

    # Parts put together into one are the same graph; an empty part adds nothing.
    merged = str(tmp_path / "merged")
    growing.store_part(growing.read_state(spark, path), merged, "base")
    growing.store_part(state(triples.limit(0)), merged, "empty")
    assert tables(growing.graph_of(growing.read_state(spark, merged))) == whole
    with pytest.raises(ValueError):
        growing.store_part(broken, path, "../up")
