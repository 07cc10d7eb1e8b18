"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "quillsift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library expects.

    Shuffle partitions are left to adaptive execution on a cluster: start high and let it
    merge small ones. Pass ``**{"spark.sql.shuffle.partitions": "8"}`` for a laptop.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Whole documents cross to Python for Unicode normalisation: bound a batch by bytes.
        "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a missing setting
    is an error, because a machine-local path would be lost with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if configured is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
            configured = tempfile.mkdtemp(prefix="quillsift-")
        context.setCheckpointDir(configured)
    return configured or context.getCheckpointDir()


def stage_dir(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/stages-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's folder."""
    return f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_stages(spark: SparkSession) -> None:
    """Deletes all that this application has staged, once no DataFrame that reads it is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder; what follows reads that.

    Like a checkpoint it cuts the lineage and survives lost executors. Unlike one it is columnar,
    so a later pass that needs an id and a label does not read the texts again. It stays until ``clear_stages``,
    since the result may be read at any time.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deals a freshly read small table out to all cores.

    Text work is bound by CPU, and a file of few splits would keep it on as many cores. A large
    table has more splits than the cluster has cores: it is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
