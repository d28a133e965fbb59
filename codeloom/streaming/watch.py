"""A folder into which source files are dropped, scanned as a stream.

Parsing, matching and taint folding are narrow per file, so they run unchanged
on a stream; only the windowed counts keep state, bounded by a watermark on the
files' times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators.scan import scan
from codeloom.operators.taint import analyse, taint_paths
from codeloom.sources.rules import Rule

BINARY = T.StructType.fromDDL("path string, modificationTime timestamp, length long, content binary")


def watch(spark: SparkSession, folder: str, pattern: str = "*.py", files_a_batch: int = 1000) -> DataFrame:
    """Streaming files(path, code, modified) of a folder and all below it."""
    raw = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).load(folder)
    return raw.select("path", F.col("content").alias("code"), F.col("modificationTime").alias("modified"))


def stream_findings(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """Findings of streamed files, each file's once."""
    return scan(files, rules)


def stream_taint(files: DataFrame, strict: bool = False) -> DataFrame:
    return taint_paths(analyse(files, strict=strict))


def counts_by_window(files: DataFrame, rules: list[Rule], window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window, rule_id, findings): counts by the time the files were written; files later than ``late`` are left out."""
    found = scan(files.select(F.concat_ws("\x00", "path", F.col("modified").cast("string")).alias("path"), "code"), rules)
    timed = found.withColumn("modified", F.to_timestamp(F.substring_index("path", "\x00", -1))).withWatermark("modified", late)
    return timed.groupBy(F.window("modified", window).alias("window"), "rule_id").agg(F.count("*").alias("findings"))
