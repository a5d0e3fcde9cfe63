"""A folder that driver and executors share, for tables that a query writes and reads back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
#: Shuffle files go once the table is written that they were dealt out for.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a local session without one, as in a test, gets a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="weftlink-"))
        top = _OWN[0]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read back wherever they are used."""
    spark = df.sparkSession
    path = folder(spark, name)
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was) if was else spark.conf.unset(CLEANUP)
    out = spark.read.parquet(path)
    out._weftlink_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by saved() that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_weftlink_path", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
