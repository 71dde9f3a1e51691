"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh path below spark.checkpoint.dir; a temporary folder is set as that only if a local session has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        own = spark.sparkContext.getCheckpointDir()
        if own is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-checkpoint-"))
            own = spark.sparkContext.getCheckpointDir()
        root = os.path.dirname(own.rstrip("/"))
    return f"{root.rstrip('/')}/tessella/{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a frame below the shared folder and read it back, so that later steps survive lost executors and repeat nothing."""
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bytes(spark: SparkSession, path: str, pieces: Iterable[bytes], append: bool = False) -> None:
    """One file of the pieces, on any file system that Spark knows; a new file takes the place of the old when it is whole."""
    jvm = spark.sparkContext._jvm
    target, fresh = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(fresh)
    try:
        if append and fs.exists(target):
            old = fs.open(target)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(old, out, 1 << 16, False)
            old.close()
        held, size = [], 0
        for piece in pieces:
            held.append(piece)
            size += len(piece)
            if size >= 1 << 20:
                out.write(bytearray(b"".join(held)))
                held, size = [], 0
        out.write(bytearray(b"".join(held)))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(fresh, target)


def write_text(spark: SparkSession, path: str, pieces: Iterable[str], append: bool = False) -> None:
    """The same of text."""
    write_bytes(spark, path, (piece.encode() for piece in pieces), append)
