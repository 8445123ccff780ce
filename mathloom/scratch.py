"""Shared scratch space: where lineage is cut and intermediate tables are kept.

The folder comes from ``spark.checkpoint.dir``.  Only a session that does not name one gets a
temporary folder, and only if it runs inside a single machine (``local[...]``).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; raises on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="mathloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def filesystem(spark: SparkSession, path: str):
    """File system of a path, by its scheme or the cluster's default, and the path in its terms."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = filesystem(spark, path)
    return fs.exists(hadoop_path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: the plan restarts from files.

    Survives the loss of any executor, unlike block-manager storage.  The files go when the
    application ends, or with ``free``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, hadoop_path = filesystem(spark, path)
    fs.deleteOnExit(hadoop_path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at_ = path
    return out


def free(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read any more."""
    fs, hadoop_path = filesystem(df.sparkSession, df.staged_at_)
    fs.delete(hadoop_path, True)
