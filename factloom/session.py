"""Session defaults and staging of shared intermediates."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

LOCAL_SHARED = "/tmp/checkpoints/factloom"


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "factloom") -> SparkSession:
    """A session for tests and benches on one machine; a cluster brings its own configuration."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", LOCAL_SHARED)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per context; Spark copies it to every executor."""
    context = spark.sparkContext
    if getattr(context, "_factloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="factloom-code-"), "factloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._factloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as the cluster names it in ``spark.checkpoint.dir``.

    Sessions on one machine that name none (those of tests) get one; a cluster has to name it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(LOCAL_SHARED)
    return spark.sparkContext.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/staged/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate once as parquet in the shared folder and read it back.

    Used where a result feeds several branches: the lineage ends at a table that outlives lost
    executors, later readers prune columns, and the file sizes give the optimizer real statistics.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read.staged_path = path
    return read


def discard_path(spark: SparkSession, path: str) -> None:
    """Delete what lies under a path of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*staged: DataFrame) -> None:
    """Delete stages that no later step reads, and let go of shuffle files nobody refers to.

    Spark keeps the files of a shuffle until the driver's collector has found its plan unreachable,
    which in a long chain of stages may be after the disks are full.
    """
    for df in staged:
        discard_path(df.sparkSession, df.staged_path)
    if staged:
        release_shuffles(staged[0].sparkSession)


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver's collector find the shuffles of ended steps now, so that their files go."""
    gc.collect()
    spark._jvm.System.gc()
