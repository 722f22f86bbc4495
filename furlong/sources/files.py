"""Folders and small files in whatever file system their path names.

The one place that reaches for Hadoop's file system behind the session.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The path as Hadoop's object, and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = file_system(spark, path)
    return system.exists(found)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder; none where there is no such folder."""
    found, system = file_system(spark, path)
    return [status.getPath().getName() for status in system.listStatus(found)] if system.exists(found) else []


def modified(spark: SparkSession, path: str) -> int:
    """When a file or folder was written last, in milliseconds."""
    found, system = file_system(spark, path)
    return system.getFileStatus(found).getModificationTime()


def create(spark: SparkSession, path: str, text: str) -> None:
    found, system = file_system(spark, path)
    stream = system.create(found)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()


def rename_new(spark: SparkSession, path: str, target: str) -> bool:
    """Renames a file; false if the target is there already."""
    found, system = file_system(spark, path)
    goal, _ = file_system(spark, target)
    return not system.exists(goal) and system.rename(found, goal)


def delete_folders(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        found, system = file_system(spark, path)
        system.delete(found, True)
