"""What every operator needs from the session: shared storage, durable cut points, workers that see the package."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def workers_see_package(spark: SparkSession) -> None:
    """Lets Python workers import this package when it is run from a source tree.

    On a cluster the package is installed on the executors (or shipped with --py-files) and this is a no-op.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that all executors share: the session's spark.checkpoint.dir.

    Where that is unset, a session whose executors are this process (tests) gets a temporary folder; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if not found:
        if jsc.getCheckpointDir().isDefined():
            return _qualified(spark, str(jsc.getCheckpointDir().get()))
        if not jsc.isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparvox-")
        atexit.register(remove_uri, found)
        spark.sparkContext.setCheckpointDir(found)
    return _qualified(spark, found)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Hadoop resolves it, so that Python's file systems take it for the same place."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return "file:///" + uri[len("file:") :].lstrip("/") if uri.startswith("file:") else uri


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh URI below the shared folder, removed when this driver ends."""
    uri = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove_uri, uri)
    return uri


def remove_uri(uri: str) -> None:
    from pyarrow import fs

    try:
        system, path = fs.FileSystem.from_uri(uri)
        system.delete_dir(path)
    except (OSError, ValueError):
        pass  # never written, or the store has gone before the driver


#: Stored tables: a weak reference to what every plan over the table holds, and where it lies.
_stored: list[tuple] = []


def sweep() -> None:
    """Removes the stored tables that no plan of the driver refers to any more."""
    gone = []
    for entry in list(_stored):
        reference, uri = entry
        try:
            dead = reference.get() is None
        except Exception:  # noqa: BLE001  the session that stored it has ended, and its tables went with it
            _stored.remove(entry)
            continue
        if dead:
            gone.append(uri)
            _stored.remove(entry)
    for uri in gone:
        remove_uri(uri)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: a cut point that survives the loss of executors.

    The table is there as long as some plan refers to it; it goes when a later one is stored, or when the driver ends.
    """
    spark = df.sparkSession
    sweep()
    uri = shared_path(spark, name)
    df.write.parquet(uri)
    out = spark.read.schema(df.schema).parquet(uri)
    files = out._jdf.queryExecution().analyzed().relation().location()
    _stored.append((spark._jvm.java.lang.ref.WeakReference(files), uri))
    return out


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of a small table: it is computed once and stored."""
    return stage(df, "cut")
