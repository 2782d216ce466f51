"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own where that is unset, which only a local run may do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return _own_folders[app]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, every executor sees it,
    and Spark knows its size when it plans the joins that follow."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


#: Bytes of a batch of rows on its way to a Python worker and back; one longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """df, with its session sending batches of BATCH_BYTES to Python workers. Both the worker and the executor hold a batch twice, so
    Spark's own 64 MB for each of an executor's cores would take more than all else that an operator on texts or files keeps."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df over a few tasks for each core, by a key of many values: a small file of rows that are each much work would be one task's."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *key)


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        if path := getattr(df, "staged_path", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
