"""Small files and renames through the session's file systems, so that any path Spark reads will do."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def make(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.mkdirs(p)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """False if the new name is taken."""
    fs, p = _at(spark, new)
    if fs.exists(p):
        return False
    fs.mkdirs(p.getParent())
    return fs.rename(_at(spark, old)[1], p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def size(spark: SparkSession, path: str) -> int:
    fs, p = _at(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n[:-5]) for n in names(spark, folder) if n.endswith(".json") and n[:-5].isdigit())


def publish(spark: SparkSession, folder: str, version: int, text: str) -> bool:
    """A small file under a number that must be free: written beside and renamed, so readers see all of it or nothing.

    Older versions stay until the caller deletes them; False if the number is taken.
    """
    beside = f"{folder}/.{uuid.uuid4().hex}"
    out = (at := _at(spark, beside))[0].create(at[1])
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if rename(spark, beside, f"{folder}/{version:012d}.json"):
        return True
    delete(spark, beside)
    return False
