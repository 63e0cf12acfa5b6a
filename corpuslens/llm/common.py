"""What the operators share: scratch tables in the shared folder, files written by tasks, ordered key helpers."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any
from urllib.parse import urlparse

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuslens.session import scratch_path

#: The bytes between words (blank, tab to carriage return), as a class for both Java's and RE2's patterns.
BLANKS = r"[\x20\x09-\x0D]"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, its lineage cut, safe when executors are lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later step reads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of an iterative job: each one replaces, and deletes, the one before."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.label, self.path = spark, label, ""

    def put(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.label)
        df.write.parquet(path)
        if self.path:
            discard(self.spark, self.path)
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)


def text_hash(column: str | Column) -> Column:
    """128 bits of a text (null: empty): equal texts, equal values."""
    return F.unhex(F.md5(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")))


def parallel_paths(uri: str):
    """The file system of a URI or path, and the path in it, for use in tasks."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def kept(name: str, make: Callable[[], Any]) -> Any:
    """A value that a Python worker makes once for all its tasks. (Modules sent by value have no globals that outlive a task.)"""
    store = sys.modules.setdefault("_corpuslens_kept", types.ModuleType("_corpuslens_kept")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


cloudpickle.register_pickle_by_value(sys.modules[__name__])
