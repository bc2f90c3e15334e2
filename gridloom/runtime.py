"""Session helpers shared by the operators: lineage cuts in the shared folder, releases, size checks."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    Only where the session leaves it unset and is local (as in tests) is a folder of our own used and set; on a cluster
    that is an error, as executors can't see each other's disks.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            folder = f"file://{os.path.join(tempfile.gettempdir(), 'gridloom-checkpoints')}"
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: computed once, survives lost executors.

    The files go when the driver ends, or before by ``release``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of frames made by ``cut``; others are left alone."""
    for df in frames:
        path = getattr(df, "_gridloom_path", None)
        if path:
            session = df.sparkSession
            p = session._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(session._jsc.hadoopConfiguration()).delete(p, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files of a frame made by ``cut``."""
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._gridloom_path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that doesn't clash with the columns of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")
