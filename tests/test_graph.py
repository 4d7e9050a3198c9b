import random

from pyspark.sql import functions as F

from factloom.operators import entities as en, graph as g, rules as ru, triples as tr
from factloom.sources import files

FACT = (
    "source string, relation string, target string, weight decimal(18,6), evidence string, doc_id string, "
    "title string, ord struct<doc_seq:bigint,sent_idx:int,sub:bigint>"
)


def facts(spark, rows, parts=3):
    from decimal import Decimal

    full = [(s, r, t, Decimal(str(w)), e, d, f"title {d}", (i, 0, 0)) for i, (s, r, t, w, e, d) in enumerate(rows)]
    random.Random(1).shuffle(full)
    return spark.createDataFrame(full, FACT).repartition(parts)


def test_edge_fold(spark):
    rows = [
        ("a", "R", "b", 0.7, "", "doc_2"),
        ("a", "R", "b", 0.7, "e1", "doc_10"),
        ("a", "R", "b", 0.7, "e1", "doc_2"),
        *[("a", "R", "b", 0.1, f"e{i}", "doc_3") for i in range(2, 8)],
        ("a", "S", "b", 1.0, "x", "doc_2"),
        ("a", "R", "a", 2.0, "loop", "doc_2"),
    ]
    for parts in (1, 5):
        got = {(r["source"], r["relation"], r["target"]): r for r in g.fold_edges(facts(spark, rows, parts)).collect()}
        edge = got["a", "R", "b"]
        assert float(edge["weight"]) == 2.7
        assert edge["evidence"] == ["e1", "e2", "e3", "e4"]
        assert (edge["first_source"], edge["n_sources"], edge["title"]) == ("doc_10", 3, "title doc_2")
        assert got["a", "S", "b"]["evidence"] == ["x"] and got["a", "R", "a"]["n_sources"] == 1
    assert {r["node"]: r["degree"] for r in g.degrees(g.fold_edges(facts(spark, rows))).collect()} == {"a": 4, "b": 2}


def neighbors(spark, pairs):
    return g.both_ways(spark.createDataFrame(pairs, "source string, target string"))


def test_walk_and_components_against_brute_force(spark):
    rng = random.Random(11)
    pairs = [(f"n{rng.randint(0, 60):02d}", f"n{rng.randint(0, 60):02d}") for _ in range(45)]
    pairs += [(f"chain{i:03d}", f"chain{i + 1:03d}") for i in range(70)] + [("hub", f"leaf{i}") for i in range(50)]
    around: dict[str, set[str]] = {}
    for a, b in pairs:
        if a != b:
            around.setdefault(a, set()).add(b)
            around.setdefault(b, set()).add(a)

    def walk(starts, hops):
        dist = {s: 0 for s in starts}
        for hop in range(1, hops + 1):
            for node in [n for n, d in dist.items() if d == hop - 1]:
                for other in around.get(node, ()):
                    dist.setdefault(other, hop)
        return dist

    df = neighbors(spark, pairs)
    seeds = [(1, "n05"), (1, "chain010"), (2, "leaf3"), (3, "absent")]
    got: dict[int, dict[str, int]] = {}
    for r in g.bounded_walk(df, spark.createDataFrame(seeds, "qid int, node string"), 2).collect():
        got.setdefault(r["qid"], {})[r["node"]] = r["dist"]
    assert got == {1: walk(["n05", "chain010"], 2), 2: walk(["leaf3"], 2), 3: {"absent": 0}}
    labels = {r["node"]: r["component"] for r in g.connected_components(df).collect()}
    assert labels == {n: min(walk([n], 200)) for n in around}


def sentence_rows(spark, texts):
    df = spark.createDataFrame(
        [(f"doc_{i}", i, f"T{i}", 0, t) for i, t in enumerate(texts)],
        "doc_id string, doc_seq bigint, title string, sent_idx int, sentence string",
    )
    return en.with_entities(df, "sentence", en.DEFAULT_DICTIONARY)


def test_rules(spark):
    texts = [
        "VinFast delivered 21,912 vehicles and revenue of $512 million, a subsidiary of Vingroup.",
        "BYD is surpassing Tesla while sales fell 15% in supply.",
        "Drivers in ZEV states bought 15% more.",
        "A viral post on Tesla.",
    ]
    got = g.sentence_facts(sentence_rows(spark, texts), ru.DEFAULT_RULES).collect()
    by_doc = {i: [] for i in range(4)}
    for r in sorted(got, key=lambda r: (r["ord"]["doc_seq"], r["ord"]["sub"])):
        by_doc[int(r["doc_id"][4:])].append((r["source"], r["relation"], r["target"], float(r["weight"])))
    assert by_doc[0] == [
        ("VinFast", "CO_OCCURS_WITH", "Vingroup", 0.7),
        ("Vingroup", "DELIVERED", "metric:Vingroup deliveries: $512 million, 21,912, 512", 2.0),
        ("Vingroup", "REPORTED_REVENUE", "metric:Vingroup revenue: $512 million, 21,912, 512", 2.0),
        ("VinFast", "DELIVERED", "metric:VinFast deliveries: $512 million, 21,912, 512", 2.0),
        ("VinFast", "REPORTED_REVENUE", "metric:VinFast revenue: $512 million, 21,912, 512", 2.0),
        ("VinFast", "SUBSIDIARY_OF", "Vingroup", 3.0),
    ]
    kinds = {(s, r) for s, r, _, _ in by_doc[1]}
    assert {("BYD", "SURPASSED"), ("BYD", "SALES_DECLINED"), ("Tesla", "SALES_INCREASED")} <= kinds
    assert by_doc[2] == [("ZEV regulations", "ASSOCIATED_WITH", "metric:ZEV states combined new EV share: 5%", 3.0)]
    assert by_doc[3] == [("Inflation Reduction Act", "RELATED_TO", "Tesla", 1.5)]


def test_triples_to_graph_and_back(spark, tmp_path):
    reply = (
        '{"triples": [{"source": "TSLA", "relation": "sells-in", "target": "U.S.", "evidence": "said \\"so\\"\\nhere",'
        ' "confidence": NaNSTR}, {"source": "a", "target": "A"}, {"source": "", "target": "x"},'
        ' {"source": "TSLA", "relation": "is", "target": "Tesla", "confidence": 7}, {"source": "b", "target": "c", "confidence": "abc"}]}'
    ).replace("NaNSTR", '"NaN"')
    rows = [("doc_2", 2, "Title 2", "l", 1, reply), ("doc_10", 10, "Title 10", "l", 1, "x " + reply)]
    replies = spark.createDataFrame(
        rows, "doc_id string, doc_seq bigint, title string, link string, chunk_index bigint, reply string"
    )
    coerced = tr.coerce_triples(tr.parse_replies(replies))
    got = [
        (r["source"], r["relation"], r["target"], r["evidence"], r["confidence"])
        for r in coerced.where("doc_id = 'doc_2'").orderBy("triple_ord").collect()
    ]
    assert got == [
        ("TSLA", "SELLSIN", "U.S.", 'said "so"\nhere', 0.0),
        ("TSLA", "IS", "Tesla", "Title 2", 1.0),
        ("b", "RELATED_TO", "c", "Title 2", 0.75),
    ]
    built = g.build_from_triples(coerced, en.DEFAULT_DICTIONARY).staged()
    edges = {(r["source"], r["relation"], r["target"]): r for r in built.edges.collect()}
    assert float(edges["Tesla", "SELLSIN", "United States"]["weight"]) == 0.5
    assert float(edges["Tesla", "IS", "Tesla"]["weight"]) == 2.0
    # Source of the first triple, both ends of the second: three mentions per document.
    assert abs(float(edges["Tesla", "MENTIONED_IN", "doc:doc_2"]["weight"]) - 0.6) < 1e-9
    nodes = {r["node"]: r for r in built.nodes.collect()}
    assert (nodes["Tesla"]["type"], nodes["Tesla"]["mentions"], nodes["doc:doc_2"]["mentions"]) == ("Company", 5, 2)

    path = str(tmp_path / "triples.csv")
    files.write_triples(built, path)
    back = files.graph_from_triple_rows(files.read_triples(spark, path), en.DEFAULT_DICTIONARY)

    def plain(graph):
        ids = graph.edge_sources.groupBy(*g.EDGE_KEY).agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
        joined = graph.edges.join(ids, g.EDGE_KEY)
        return sorted((*(r[k] for k in g.EDGE_KEY), float(r["weight"]), r["evidence"], r["ids"]) for r in joined.collect())

    assert plain(back) == plain(built)
    # Long source cells go on in further rows and fold back to the same edge.
    split = files.triple_rows(built, sources_per_cell=1)
    assert split.count() >= built.edges.count()
    again = files.graph_from_triple_rows(split.withColumn("row_no", F.monotonically_increasing_id()), en.DEFAULT_DICTIONARY)
    assert [x[:4] + x[5:] for x in plain(again)] == [x[:4] + x[5:] for x in plain(built)]


def test_reload_repairs(spark):
    rows = [
        ("TSLA", "sells", "US", "bad", "doc_1|doc_2", "e1 || e2", 0),
        ("Tesla", "SELLS", "United States", "0.5", "doc_2|doc_3", "e2", 1),
        ("", "R", "x", "1", "d", "e", 2),
    ]
    df = spark.createDataFrame(
        rows, "source string, relation string, target string, weight string, sources string, evidence string, row_no bigint"
    )
    graph = files.graph_from_triple_rows(df, en.DEFAULT_DICTIONARY)
    (edge,) = graph.edges.collect()
    assert (float(edge["weight"]), edge["evidence"], edge["n_sources"]) == (1.5, ["e1", "e2"], 3)
    assert {r["node"]: r["type"] for r in graph.nodes.collect()} == {"Tesla": "Company", "United States": "Region"}


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert files.read_cache(spark, path).count() == 0
    item = '[{"source":"a","relation":"R","target":"b"}]'
    for key, triples in (("k1", "[]"), ("k2", item), ("k1", item)):
        files.append_cache(spark.sql(f"select '{key}' as key, from_json('{triples}', '{tr.TRIPLES}') as triples"), path)
    got = {r["key"]: len(r["triples"]) for r in files.read_cache(spark, path).collect()}
    assert got == {"k1": 1, "k2": 1}


def test_files_are_folded_in_the_order_of_their_names(spark, tmp_path):
    """The first file's evidence comes first, though Spark reads the larger file first."""
    folder = tmp_path / "triples"
    folder.mkdir()
    head = "source,relation,target,weight,sources,evidence\n"
    (folder / "part-0.csv").write_text(head + 'A,KNOWS,B,1.0,doc_1,"first\nof all"\nA,KNOWS,B,1.0,doc_2,second\n')
    more = "".join(f"X{i},KNOWS,Y{i},1.0,doc_9,filler {i}\n" for i in range(3000))
    (folder / "part-1.csv").write_text(head + "A,KNOWS,B,1.0,doc_3,third\n" + more + "A,KNOWS,B,1.0,doc_4,fourth\n")
    graph = files.graph_from_triple_rows(files.read_triples(spark, f"file://{folder}"), en.DEFAULT_DICTIONARY)
    (edge,) = graph.edges.where("source = 'A'").collect()
    assert [e.split()[0] for e in edge["evidence"]] == ["first", "second", "third", "fourth"] and edge["n_sources"] == 4


def test_reading_a_staged_table_makes_no_other(spark, monkeypatch):
    made = []
    monkeypatch.setattr(g, "stage", lambda df, name: made.append(name) or df)
    rows = facts(spark, [("a", "R", "b", 1.0, "e", "doc_1")])
    staged = g.Graph(rows.select("source"), g.fold_edges(rows), g.source_rows(rows)).staged()
    assert staged.edge_sources.count() == 1 and staged.edge_sources.count() == 1
    assert made == ["edge-sources"]


def test_ends_of_a_triple_are_cleaned_once(spark, capsys):
    parsed = spark.createDataFrame(
        [("doc_1", 1, "T", "l", 1, [(" a  b ", "is", "c", None, None, None, None), ("A", "is", " a ", None, None, None, None)])],
        f"doc_id string, doc_seq bigint, title string, link string, chunk_index bigint, triples {tr.TRIPLES}",
    )
    found = tr.coerce_triples(parsed)
    found.explain("formatted")
    conditions = [x for x in capsys.readouterr().out.split("\n") if x.startswith("Condition")]
    assert conditions and not any("regexp_replace" in x for x in conditions)
    assert [(r["source"], r["target"]) for r in found.collect()] == [("a b", "c")]
