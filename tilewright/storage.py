"""Lineage cuts: tables written to the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Has Spark delete a query's shuffle files as soon as the query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a folder of our own if driver and executors are one process, as in tests; else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tilewright-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _path(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one. It goes when the application ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = _path(spark, at)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return at


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back. A lost executor costs nothing; what was shuffled for
    it is deleted at once."""
    spark = df.sparkSession
    at = new_folder(spark, name) + "/table"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(at)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(at)


def drop_kept(*tables: DataFrame) -> None:
    """Delete the files of tables from keep() once nothing reads them any more."""
    for df in tables:
        root = shared_dir(df.sparkSession).split(":", 1)[-1].lstrip("/")
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if at.split(":", 1)[-1].lstrip("/").startswith(root):
                fs, path = _path(df.sparkSession, at)
                fs.delete(path, True)
