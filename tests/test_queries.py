"""Whole queries against SQL, the shape of plans, and runs from files."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import check_oracles
from factloom import cli
from factloom.operators import triples as tr
from factloom.plans import catalog, pipeline
from factloom.plans.oracles import ORACLES
from factloom.sources import files
from factloom.sources.chat import ChatSettings, RecordedChat, read_number, with_file

# Every query of the graph work that has SQL.
CHECKED = [name for name in catalog.QUERIES if name in ORACLES]


@pytest.fixture(scope="module")
def con(sf):
    return check_oracles.connect(sf)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, sf, name):
    assert check_oracles.compare(spark, con, sf, name).startswith("equal")


def test_contract(spark):
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and set(ORACLES) <= names
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    bed = catalog.bed(spark, sf)
    terms = plan(catalog.content_term_freq(bed))
    assert "CartesianProduct" not in terms and "BroadcastNestedLoopJoin" not in terms
    for name in ("fact_scores", "doc_relevance", "graph_evidence", "entity_links_documents", "flat_topk"):
        text = plan(catalog.run(name, spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # Linking with a small dictionary neither joins nor shuffles.
    linked = plan(catalog.entity_links_documents(bed))
    assert "Join" not in linked and "Exchange" not in linked


def corpus_folder(tmp_path):
    folder = tmp_path / "corpus"
    folder.mkdir()
    texts = [
        "VinFast is a subsidiary of Vingroup and delivered 21,912 vehicles in Q3 2024. Tesla sales fell 15% in the United States as charging stations stayed rare.",
        "BYD is surpassing Tesla as the largest producer of electric cars in China. European makers such as BMW report revenue of $512 million for the year.",
        "The Inflation Reduction Act supports EV leasing incentives for Ford and for General Motors. Charging infrastructure in Germany grows with public charging investment.",
    ]
    for i, text in enumerate(texts, start=1):
        (folder / f"doc_{i}.txt").write_text(f"Query: q\nTitle: Title {i}\nLink: l{i}\nSnippet: s\n\nFull Content:\n{text}\n")
    return str(folder)


def test_offline_run_and_ask(spark, tmp_path, capsys):
    folder, out = corpus_folder(tmp_path), str(tmp_path / "out")
    cli.main(["--dataset", folder, "--output", out, "--mode", "offline"])
    assert {"triples.csv", "benchmark_results.csv", "run_metadata.json"} <= set(os.listdir(out))
    rows = spark.read.csv(f"{out}/benchmark_results.csv", header=True, escape='"').collect()
    assert len(rows) == 20 and "VinFast" in rows[8]["query_entities"]
    # Asking reads the stored index: the corpus may be gone.
    cli.main(["--dataset", str(tmp_path / "gone"), "--output", out, "--ask", "How are VinFast and Vingroup related?"])
    told = capsys.readouterr().out
    asked = json.loads(told.splitlines()[-1])
    assert "VinFast" in asked["seeds"] and any("VinFast -[SUBSIDIARY_OF]-> Vingroup" in e for e in asked["edges"])


def test_run_with_recorded_replies(spark, tmp_path):
    folder, out = corpus_folder(tmp_path), str(tmp_path / "out")
    triple = {"source": "VinFast", "relation": "PART_OF", "target": "Vingroup", "evidence": "VinFast is a subsidiary of Vingroup today.", "confidence": 0.9}
    chat = RecordedChat(
        (("Document: doc_1", json.dumps({"triples": [triple]})), ("Scores are", '{"flat_score": 3, "graphrag_score": 8, "winner": "GraphRAG", "reason": "r"}'), ("Evidence:", '{"answer": "told"}')),
        '{"triples": []}',
    )
    asked = spark.createDataFrame([(1, "Who owns VinFast?"), (2, "Zzz?")], "qid bigint, question string")

    def run():
        p = pipeline.Pipeline(spark, folder, out, mode="llm", settings=ChatSettings("k"), chat=chat)
        _, _, results = p.run(asked)
        (name,) = [f for f in os.listdir(f"{out}/run_metadata.json") if f.endswith(".json")]
        with open(f"{out}/run_metadata.json/{name}") as file:
            return {x["qid"]: x for x in results.collect()}, json.load(file)

    results, first = run()
    assert results[1]["graphrag_answer"] == "told" and results[1]["verdict"] == "GraphRAG: r"
    assert results[1]["top_graph_edges"] == "VinFast -[PART_OF]-> Vingroup"
    assert first["runtime_estimate"]["uncached_chunks"] == 3 and first["graph_edges"] == 3
    _, second = run()
    assert second["runtime_estimate"]["uncached_chunks"] == 0 and second["graph_edges"] == 3
    assert first["llm_calls"] - second["llm_calls"] == 3


def test_settings():
    with pytest.raises(ValueError):
        read_number("X", 1, int, {"X": "a"})
    with pytest.raises(RuntimeError):
        ChatSettings.from_env({})
    assert ChatSettings.from_env({"OPENAI_API_KEY": "k", "FACTLOOM_CHUNK_CHARS": "10"}).chunk_chars == 10


def test_extraction_goes_on_after_a_failure(spark, tmp_path):
    """A chat that dies in the third of eight portions: the next run asks for what is left, and only for that."""
    folder, out, log = tmp_path / "corpus", str(tmp_path / "out"), tmp_path / "asked"
    folder.mkdir()
    log.mkdir()
    for i in range(1, 17):
        (folder / f"doc_{i}.txt").write_text(f"Query: q\nTitle: T{i}\nLink: l\nSnippet: s\n\nFull Content:\nText number {i} says that Alpha{i} owns Beta{i} since the year 2001.\n")

    class Chat:
        def __init__(self, failing):
            self.failing, self.log = failing, str(log)

        def complete(self, system, user):
            name = user.split("Document: ")[1].split("\n")[0]
            if name in self.failing:
                raise RuntimeError("the service is gone")
            with open(f"{self.log}/{name}", "a") as asked:
                asked.write("x")
            number = name.split("_")[1]
            return json.dumps({"triples": [{"source": f"Alpha{number}", "relation": "OWNS", "target": f"Beta{number}", "evidence": "e"}]})

    def run(failing):
        p = pipeline.Pipeline(spark, str(folder), out, mode="llm", settings=ChatSettings("k"), chat=Chat(failing), chunks_per_commit=2)
        return p, p.extracted_triples(p.documents()).collect()

    chunks = pipeline.Pipeline(spark, str(folder), out).documents()
    keyed = pipeline.Pipeline(spark, str(folder), out).chunks(chunks)
    portion = {r.doc_id: r.portion for r in keyed.select("doc_id", F.expr("pmod(xxhash64(key), 8)").alias("portion")).collect()}
    third = sorted(set(portion.values()))[2]
    with pytest.raises(Exception, match="the service is gone"):
        run({d for d, p in portion.items() if p == third})
    before = {f.name for f in log.iterdir()}
    assert {d for d, p in portion.items() if p < third} <= before
    known = {d for d, p in portion.items() if p < third}
    p, triples = run(set())
    assert len(triples) == 16 and p.calls == 16 - len(known)
    assert all((log / d).read_text() == "x" for d in known)
    again, triples = run({f"doc_{i}" for i in range(1, 17)})  # nothing is left to ask
    assert len(triples) == 16 and again.calls == 0


def test_half_written_commits_do_not_count(spark, tmp_path):
    path = str(tmp_path / "cache")
    item = '[{"source":"a","relation":"R","target":"b"}]'
    entry_of = lambda key: spark.sql(f"select '{key}' as key, from_json('{item}', '{tr.TRIPLES}') as triples")
    files.append_cache(entry_of("k1"), path)
    files.append_cache(entry_of("k2"), path)
    os.unlink(f"{path}/commit=000000001/_SUCCESS")
    assert [r.key for r in files.read_cache(spark, path).collect()] == ["k1"]
    files.append_cache(entry_of("k3"), path)
    assert sorted(files.commits(spark, path).items()) == [(0, True), (1, False), (2, True)]
    assert sorted(r.key for r in files.read_cache(spark, path).collect()) == ["k1", "k3"]


def test_settings_from_a_file_and_a_named_client(tmp_path):
    (tmp_path / ".env").write_text("# comment\nexport OPENAI_API_KEY='from file'\nOPENAI_MODEL=m\nOPENAI_TEMPERATURE=\nFACTLOOM_CHAT=factloom.sources.chat:recorded\n")
    got = ChatSettings.from_env(with_file({"OPENAI_MODEL": "outer"}, str(tmp_path / ".env")))
    assert (got.api_key, got.model, got.judge_model, got.temperature) == ("from file", "outer", "outer", 0.0)
    assert got.chat().complete("s", "u") == "{}"
    assert with_file({"A": "1"}, str(tmp_path / "none")) == {"A": "1"}
    with pytest.raises(RuntimeError):
        ChatSettings("k").chat()
