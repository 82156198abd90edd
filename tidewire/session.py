"""Session defaults, and the one place that decides where lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Everything here may be overridden by spark-defaults or --conf on a cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "tidewire", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder lineage is cut into: the session's own, or a temporary one in local mode.

    On a cluster the folder has to be shared by all executors, so an unset
    ``spark.checkpoint.dir`` is an error there.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tidewire-")
    context.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into reliable storage and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints that nothing refers to any more.

    It does so when the driver collects its garbage, which may be long after a large shuffle has been read.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    files = df.inputFiles()
    hadoop = df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in files}:
        path = hadoop._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("stored-"):
            path.getFileSystem(hadoop._jsc.hadoopConfiguration()).delete(path, True)


def stored(
    df: DataFrame, path: str | None = None, partition_by: list[str] | None = None, compression: str | None = None
) -> DataFrame:
    """``df`` written once as Parquet and read back, from ``path`` or a new folder beside the checkpoints.

    Readers of a few columns read only these, and the lineage is cut as by a checkpoint.
    """
    spark = df.sparkSession
    path = path or f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    writer = writer.option("compression", compression) if compression else writer
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` written once in the shared folder, bucketed by ``keys``: grouping by them needs no shuffle later on.

    Rows are dealt out in the same way first, so a task writes one file. The table's name leaves the
    catalog at once; its files stay as long as other stored tables do.
    """
    spark = df.sparkSession
    name = f"tidewire_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a stored table that has fewer partitions than the cluster has cores.

    A large table has more already and is left as it is, so this costs no large shuffle.
    """
    if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism:
        return df.repartition(*keys)
    return df
