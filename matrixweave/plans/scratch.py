"""Tables written in the folder that driver and executors share, to end a lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where the session names none and all runs in one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="matrixweave-core-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return f"file://{_OWN[0]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written and read back; the table goes when the application ends.

    No file marks success: on a local folder Hadoop starts ``chmod`` for each file the driver
    makes, and until that has begun, the driver's memory counts twice.
    """
    path = f"{folder(df.sparkSession)}/matrixweave-core/{tag}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)
