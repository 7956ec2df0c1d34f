"""Session settings, shared work folder and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_OWNED: set[str] = set()  # folders that end with the driver


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings every operator relies on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Rows hold whole texts: few of them make a batch for the Python workers.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by the cluster.

    Only a local-mode session without that setting gets a temporary folder.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="feedsieve-")
    spark.conf.set(CHECKPOINT_CONF, made)
    return made


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the application's own folder; nothing is created yet.

    That folder is removed when the driver ends; `release` removes it earlier.
    """
    own = f"{shared_folder(spark)}/feedsieve-{spark.sparkContext.applicationId}"
    if own not in _OWNED:
        _OWNED.add(own)
        _file_system(spark, own).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(own))
    return f"{own}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def discard(spark: SparkSession, label: str) -> None:
    """Remove the tables stored under `label`/... by this application."""
    own = f"{shared_folder(spark)}/feedsieve-{spark.sparkContext.applicationId}/{label}"
    _file_system(spark, own).delete(spark._jvm.org.apache.hadoop.fs.Path(own), True)


def release(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application. Results that still read them must be stored before."""
    own = f"{shared_folder(spark)}/feedsieve-{spark.sparkContext.applicationId}"
    _file_system(spark, own).delete(spark._jvm.org.apache.hadoop.fs.Path(own), True)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to all tasks by their keys, for work that costs more than moving a row once.

    A row group of a file is read by one task, however many rows it holds and however many tasks there are; work that follows the
    scan directly stays in that task.
    """
    return rows.repartition(*keys)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
