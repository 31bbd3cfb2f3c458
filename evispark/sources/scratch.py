"""Tables that one step writes and later steps read, in a folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: What this driver wrote and did not delete yet.
_STORED: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``; without it, in local mode only, below /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints/evispark"
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written and read back: its lineage ends here, and no lost executor makes it run again."""
    path = scratch_dir(df.sparkSession)
    _STORED.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`stored` that no later step reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Delete every table that :func:`stored` made, once the results that read them are written."""
    for path in list(_STORED):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _STORED:
        _STORED.remove(path)
