"""Where source text comes from: folders, single files, strings, columns, and a stream of dropped files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.runtime import located

STRING = "<string>"
SCHEMA = "path string, content binary, modified timestamp"


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.py") -> DataFrame:
    """files(path, code, modified) of a folder and all below it. A folder without such files gives no rows."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return raw.select("path", F.col("content").alias("code"), F.col("modificationTime").alias("modified"))


def read_path(spark: SparkSession, path: str) -> DataFrame:
    """A ``.py`` file or a folder, on any file system Spark knows. ValueError for a file of another kind or a folder without any."""
    at, store = located(spark, path)
    if not store.exists(at):
        raise ValueError(f"{path} does not exist")
    if store.getFileStatus(at).isFile():
        if not path.endswith(".py"):
            raise ValueError(f"{path} is no Python file")
        return spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("code"), F.col("modificationTime").alias("modified"))
    every = store.listFiles(at, True)
    while every.hasNext():
        if every.next().getPath().getName().endswith(".py"):
            return read_folder(spark, path)
    raise ValueError(f"{path} holds no Python files")


def from_strings(spark: SparkSession, codes: str | Iterable[tuple[str, str]]) -> DataFrame:
    """files(path, code) of one text, or of (path, text) pairs."""
    rows = [(STRING, codes)] if isinstance(codes, str) else list(codes)
    return spark.createDataFrame(rows, "path string, code string")


def from_columns(df: DataFrame, path: Column | str, code: Column | str) -> DataFrame:
    """files(path, code) of any two columns."""
    of = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(of(path).cast("string").alias("path"), of(code).alias("code"))
