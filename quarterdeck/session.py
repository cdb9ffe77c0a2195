"""Session helpers: shared folders, table loading, layout sizes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a test-data folder, as stored."""
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset on a single machine (as in tests) a temporary folder is set and
    used, and removed at the end. On a cluster a missing setting is an error: executors don't share their own disks.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        current = java.get() if java.isDefined() else None
    if not current:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quarterdeck-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        current = "file://" + folder
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(current)
    return current


#: Tables written by this process, and the gateway through which they are removed when it ends.
_WRITTEN: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
        except Exception:  # noqa: BLE001, S112 - the JVM may be gone; the folder's own clearing remains
            continue


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is removed when the driver's process ends."""
    if not _WRITTEN:
        atexit.register(_remove_written)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder, and read back."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from.

    The package's folder joins the workers' search path; executors of other machines, which may not have that folder, are
    sent the package itself, unless PYTHONPATH names the folder already (then all executors are meant to have it).
    """
    sc = spark.sparkContext
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if home in known or home in sc.environment.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (home, sc.environment.get("PYTHONPATH")) if p)
    if not _is_local(spark):
        folder = tempfile.mkdtemp(prefix="quarterdeck-")  # of the driver; Spark serves the archive from there to the executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "quarterdeck"), "zip", home, "quarterdeck"))
