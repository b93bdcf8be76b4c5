"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on.  Sizes (shuffle partitions, memory) belong to
# the cluster and are left to the caller; AQE coalesces and splits at run time.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    # A stream's batch of thousands of files is listed by so many tasks, not by one for each file.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
}


def build_session(app: str = "quillgraph", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the engine's runtime settings to a session somebody else built."""
    for key, value in ENGINE_CONF.items():
        spark.conf.set(key, value)
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts: the cluster's own, or a new one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="quillgraph-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialise(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Cut the lineage of ``df`` by writing it once to the shared folder.

    Unlike an RDD checkpoint the plan runs only once, and the files give the
    planner true sizes, so later joins broadcast only what is really small.
    ``replaces`` is an earlier cut that nothing reads any more; its files go, so
    a loop holds one state on disk.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    if replaces is not None:
        _remove(spark, replaces._cut_path)
    cut = spark.read.schema(df.schema).parquet(path)
    cut._cut_path = path
    return cut


def discard(cut: DataFrame) -> None:
    """Remove the files of a cut that nothing reads any more."""
    _remove(cut.sparkSession, cut._cut_path)
