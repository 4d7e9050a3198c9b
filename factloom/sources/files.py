"""Files the work reads and writes: corpus texts, triple tables, the extraction cache, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as tx
from factloom.operators import corpus, graph as g
from factloom.operators.corpus import ordinal
from factloom.operators.entities import EntityDictionary, node_type, resolve_names, type_by_name
from factloom.operators.triples import CACHE_SCHEMA, latest_entries

TRIPLE_COLUMNS = ["source", "relation", "target", "weight", "sources", "evidence"]
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "encoding": "UTF-8"}
# A cell of document ids longer than this goes on in further rows of weight 0.
SOURCES_PER_CELL = 10_000


# --- corpus ------------------------------------------------------------------------------------------


def read_corpus(spark: SparkSession, folder: str, **limits) -> DataFrame:
    """``doc_<n>.txt`` files to documents, ordered by the number in the name."""
    raw = spark.read.text(f"{folder}/doc_*.txt", wholetext=True).select(
        F.make_valid_utf8("value").alias("raw"), F.col("_metadata.file_path").alias("path")
    )
    name = F.regexp_extract(F.url_decode("path"), r"([^/]+)\.txt$", 1)
    files = raw.select(
        name.alias("doc_id"),
        F.regexp_extract(name, r"(\d+)", 1).cast("bigint").alias("doc_seq"),
        "path",
        "raw",
    )
    return corpus.parse_raw(files, **limits)


# --- triples as CSV ----------------------------------------------------------------------------------


def triple_rows(graph: g.Graph, sources_per_cell: int = SOURCES_PER_CELL) -> DataFrame:
    """Edges as export rows, the document ids of an edge joined in name order.

    The ids of one edge are ranked in portions, so that no cell and no group grows with the corpus:
    further portions are rows of weight 0 that fold into the same edge when read back.
    """
    by_hash = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n_sources") / sources_per_cell))
    sized = graph.edge_sources.join(graph.edges.select(*g.EDGE_KEY, "n_sources"), g.EDGE_KEY)
    portions = (
        sized.withColumn("portion", by_hash)
        .groupBy(*g.EDGE_KEY, "portion")
        .agg(F.array_join(F.array_sort(F.collect_list("doc_id")), "|").alias("sources"))
    )
    leading = portions.groupBy(*g.EDGE_KEY).agg(F.min("portion").alias("first_portion"))
    cells = graph.edges.join(portions, g.EDGE_KEY, "left").join(leading, g.EDGE_KEY, "left")
    # The first portion that has an id carries the weight; a hash may leave any of them empty.
    first = F.coalesce(F.col("portion") == F.col("first_portion"), F.lit(True))
    return cells.select(
        "source",
        "relation",
        "target",
        F.when(first, F.round("weight", 3).cast("double")).otherwise(0.0).alias("weight"),
        F.coalesce("sources", F.lit("")).alias("sources"),
        F.when(first, F.array_join("evidence", " || ")).otherwise("").alias("evidence"),
        "first_ord",
    )


def write_triples(graph: g.Graph, path: str) -> None:
    """Heaviest edges first; the range sort keeps the part files in order."""
    (
        triple_rows(graph)
        .orderBy(F.desc("weight"), "source", "target", "first_ord")
        .select(*TRIPLE_COLUMNS)
        .write.mode("overwrite")
        .options(**{k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"})
        .csv(path)
    )


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a triple table as text, with their file and their place in it.

    A file is read by one task (cells may hold line ends), so numbers that rise within a task order its rows;
    they say nothing about the order of files, which goes by name.
    """
    columns = ", ".join(f"{c} string" for c in TRIPLE_COLUMNS)
    rows = spark.read.schema(columns).options(**CSV_OPTIONS).csv(path)
    return rows.select(
        *TRIPLE_COLUMNS,
        F.col("_metadata.file_name").alias("file"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def graph_from_triple_rows(rows: DataFrame, dictionary: EntityDictionary) -> g.Graph:
    """Triple rows to a graph; names and relations are normalised again, types come from names.

    Unreadable weights count 1; joined sources and evidence are taken apart before the fold.  Rows come in
    the order of ``file``, if there is one, and ``row_no``.
    """
    if "file" in rows.columns:
        by_name = Window.orderBy("file")  # one row per file
        files = rows.select("file").distinct().withColumn("file_no", F.row_number().over(by_name).cast("bigint"))
        # Of a number that rises within a task, the lower 33 bits count the rows of the task.
        in_task = F.col("row_no").bitwiseAND(F.lit((1 << 33) - 1))
        rows = rows.join(files, "file").withColumns({"first_no": F.col("file_no"), "next_no": in_task})
    else:
        rows = rows.withColumns({"first_no": F.col("row_no"), "next_no": F.lit(0)})
    named = rows.select(
        F.coalesce("source", F.lit("")).alias("source"),
        tx.relation_name(F.coalesce("relation", F.lit("RELATED_TO"))).alias("relation"),
        F.coalesce("target", F.lit("")).alias("target"),
        F.coalesce(F.expr("try_cast(weight as decimal(18,6))"), F.lit(1)).alias("weight"),
        tx.clean_text(F.coalesce("sources", F.lit(""))).alias("sources"),
        tx.clean_text(F.coalesce("evidence", F.lit(""))).alias("evidence"),
        "first_no",
        "next_no",
    )
    clean = resolve_names(named, ["source", "target"], dictionary).where(
        (F.col("source") != "") & (F.col("target") != "")
    )
    texts = F.split("evidence", r" \|\| ")
    docs = F.split("sources", r"\|")
    # The weight belongs to the row, not to each of its parts.
    parts = clean.select(
        *g.EDGE_KEY,
        F.col("weight").cast("decimal(18,6)").alias("row_weight"),
        F.posexplode(F.arrays_zip(texts.alias("e"), docs.alias("d"))).alias("pos", "p"),
        "first_no",
        "next_no",
    )
    facts = parts.select(
        *g.EDGE_KEY,
        F.when(F.col("pos") == 0, F.col("row_weight")).otherwise(0).cast("decimal(18,6)").alias(
            "weight"
        ),
        F.coalesce("p.e", F.lit("")).alias("evidence"),
        F.col("p.d").alias("doc_id"),
        F.lit("").alias("title"),
        ordinal(F.col("first_no"), F.col("next_no"), F.col("pos")).alias("ord"),
    )
    ends = clean.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.col(end).alias("node"),
                        ordinal(F.col("first_no"), F.col("next_no"), F.lit(i)).alias("ord"),
                    )
                    for i, end in enumerate(("source", "target"))
                )
            )
        )
    )
    none = F.lit(None).cast("string")
    adds = ends.select(
        "node",
        node_type(F.col("node"), type_by_name(F.col("node"), dictionary), dictionary).alias("type"),
        F.col("node").alias("label"),
        none.alias("title"),
        none.alias("link"),
        "ord",
    )
    return g.Graph(
        g.fold_nodes(adds),
        g.fold_edges(facts),
        g.source_rows(facts.where("doc_id is not null")),
    )


# --- extraction cache ----------------------------------------------------------------------------------


def commits(spark: SparkSession, path: str) -> dict[int, bool]:
    """Numbers of the commits of a cache, and whether each was written to its end."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(target):
        return {}
    folders = [f.getPath() for f in store.listStatus(target) if f.getPath().getName().startswith("commit=")]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return {int(f.getName().split("=")[1]): store.exists(done(f, "_SUCCESS")) for f in folders}


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """One entry per key from the whole commits of a cache; a missing cache is empty, the last commit of a key wins."""
    whole = sorted(n for n, done in commits(spark, path).items() if done)
    if not whole:
        return spark.createDataFrame([], CACHE_SCHEMA)
    folders = [f"{path}/commit={n:09d}" for n in whole]
    lines = spark.read.schema(f"{CACHE_SCHEMA}, commit bigint").option("basePath", path).json(folders)
    order = F.struct("commit", F.to_json("triples")).alias("line_no")
    return latest_entries(lines.where("key is not null").select("key", "triples", order))


def append_cache(entries: DataFrame, path: str) -> None:
    """One more commit, a folder with the next number; it counts when Spark has marked it as written."""
    number = max(commits(entries.sparkSession, path), default=-1) + 1
    entries.select("key", "triples").write.json(f"{path}/commit={number:09d}")


# --- reports -------------------------------------------------------------------------------------------


def write_results(results: DataFrame, path: str) -> None:
    """Benchmark rows as CSV, in question order."""
    results.orderBy("qid").drop("qid").write.mode("overwrite").options(
        header=True, quote='"', escape='"'
    ).csv(path)


def write_table_of_noise(doc_ids: DataFrame, path: str) -> None:
    """Ids of documents whose content was skipped; the list may be long, so it is its own table."""
    doc_ids.write.mode("overwrite").json(path)


def write_metadata(metadata: DataFrame, path: str) -> None:
    metadata.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
