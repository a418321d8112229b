"""What the operators need of a session: the package on the workers, and tables in a folder that all of them reach."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session's context."""
    context = spark.sparkContext
    if getattr(context, "_traitloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="traitloom-"))
    made = Path(folder, "package", root.name)
    shutil.copytree(root, made, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(Path(folder, "traitloom")), "zip", made.parent))
    context._traitloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor reach: ``spark.checkpoint.dir``.

    Only on a local master, where all share one disk, a temporary folder is made and set where that is unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        path = tempfile.mkdtemp(prefix="traitloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver delete what was written to a path when it ends."""
    files, place = _files(spark, path)
    files.deleteOnExit(place)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage and keeps a Python stage from running once per use; the files outlive any executor and go when the driver
    ends, or with ``forget``.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._traitloom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a table of ``materialise``, once nothing reads it any more."""
    files, place = _files(df.sparkSession, df._traitloom_path)
    files.delete(place, True)


#: Bytes that reach a Python worker at once.
BATCH_BYTES, BATCHES = "16m", "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """The same table, in a session whose Arrow batches hold ``BATCH_BYTES`` at most, so that a worker's memory does not
    depend on how long the rows are. A session that sets the bound itself keeps its own."""
    if BATCHES not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(BATCHES, BATCH_BYTES)
    return df
