"""Session helpers shared by every part of the library."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder every executor can reach.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset and all
    runs on one machine (a test) a temporary folder is made and set as
    checkpoint folder; on a cluster RuntimeError tells what is missing.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = sc.getCheckpointDir()
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = "file://" + tempfile.mkdtemp(prefix="codeloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a compressed table in the shared folder and cut its lineage there.

    Unlike ``cut`` it does not keep how rows lie in partitions, takes a fraction
    of the disk, and lets later readers skip columns. The shuffle files of the
    job that writes it go as soon as the table stands, the table itself when the
    application ends or ``release`` is called.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    at, store = located(spark, path)
    store.deleteOnExit(at)
    return out


def apart(df: DataFrame) -> DataFrame:
    """df as the side of a join that is never sent to the driver whole.

    Spark takes a table's files for its size. Those of ``keep`` are compressed,
    up to a hundred times where graphs are alike, and exploded after they are
    read, so it would broadcast tables of any size.
    """
    return df.hint("merge")


def located(spark: SparkSession, uri: str):  # noqa: ANN202
    """A path of Hadoop's and the file system it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def release(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` wrote; nothing may read them afterwards."""
    for df in tables:
        at, store = located(df.sparkSession, df._kept)
        store.delete(at, True)


def discard(spark: SparkSession, folder: str, at_end: bool = False) -> None:
    """Delete a folder of the shared one, now or when the application ends."""
    at, store = located(spark, folder)
    store.deleteOnExit(at) if at_end else store.delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on every worker of a session, once: a zip of its source in the shared folder, which Spark distributes."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(package.rglob("*")):
            if p.suffix in (".py", ".yaml"):
                z.write(p, Path("codeloom") / p.relative_to(package))
    folder = f"{shared_dir(spark).rstrip('/')}/ship-{sc.applicationId}"
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/codeloom.zip") as f:
        f.write(packed.getvalue())
    sc.addPyFile(f"{folder}/codeloom.zip")
    _SHIPPED.add(sc.applicationId)
