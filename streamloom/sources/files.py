"""Small files that appear whole or not at all, in any file system that Spark writes."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """Another writer made the file first."""


def path_of(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_whole(spark: SparkSession, path: str) -> bytes:
    fs, p = path_of(spark, path)
    stream = fs.open(p)
    try:
        return bytes(b & 0xFF for b in spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, fs.getFileStatus(p).getLen()))
    finally:
        stream.close()


def create_whole(spark: SparkSession, path: str, data: bytes) -> None:
    """Makes a new file; raises Taken if there is one.

    The data are written under a hidden name, which then becomes the file's own only where nothing has it:
    no reader sees half a file, and a writer that dies leaves none.
    """
    jvm = spark._jvm
    folder, _, name = path.rpartition("/")
    fs, target = path_of(spark, path)
    _, draft = path_of(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(data)
    stream.close()
    try:
        if fs.getScheme() == "file":  # a local rename would overwrite; a link can't
            jvm.java.nio.file.Files.createLink(*[jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath() for p in (target, draft)])
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, none)
    except Exception as e:
        if fs.exists(target):
            raise Taken(path) from e
        raise
    finally:
        if fs.exists(draft):
            fs.delete(draft, False)
