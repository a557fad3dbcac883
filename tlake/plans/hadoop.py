"""A few file-system calls through Hadoop, so that every URI scheme Spark reads works."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def mkdirs(spark: SparkSession, path: str) -> None:
    _, p, fs = _fs(spark, path)
    fs.mkdirs(p)


def names(spark: SparkSession, path: str) -> list[str]:
    _, p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the folders that hold the files a pattern finds."""
    _, p, fs = _fs(spark, pattern)
    return sorted(s.getPath().getParent().getName() for s in fs.globStatus(p) or [])


def read_text(spark: SparkSession, path: str) -> str:
    jvm, p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a new file whole or not at all; fails when it exists already."""
    jvm, p, fs = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if fs.exists(p) or not fs.rename(part, p):
        fs.delete(part, False)
        raise FileExistsError(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file, in place of one that is there."""
    _, p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    _, p, fs = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    _, p, fs = _fs(spark, path)
    target = _fs(spark, to)[1]
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise FileExistsError(to)


def size(spark: SparkSession, path: str) -> int:
    _, p, fs = _fs(spark, path)
    return fs.getFileStatus(p).getLen()


def copy_start(spark: SparkSession, path: str, to: str, length: int) -> None:
    """The first bytes of a file as another file, in place of one that is there."""
    jvm, p, fs = _fs(spark, path)
    source, sink = fs.open(p), fs.create(_fs(spark, to)[1], True)
    try:
        jvm.org.apache.commons.io.IOUtils.copyLarge(source, sink, 0, length)
    finally:
        source.close()
        sink.close()
