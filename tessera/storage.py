"""Shared storage for intermediate tables: lineage ends there and lost executors don't matter."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that ``stash`` has written in this process.
_stashed: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where none is named, a temporary one is set if all of Spark runs on this machine; on a
    cluster that raises, as executors wouldn't share it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stashed.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, which knows every store that Spark reads."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def list_dir(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it isn't there."""
    files, folder = _path(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(folder)) if files.exists(folder) else []


def exists(spark: SparkSession, path: str) -> bool:
    files, found = _path(spark, path)
    return files.exists(found)


def delete(spark: SparkSession, path: str) -> None:
    files, found = _path(spark, path)
    files.delete(found, True)


def modified(spark: SparkSession, path: str) -> float:
    """Seconds since 1970 at which a file was written."""
    files, found = _path(spark, path)
    return files.getFileStatus(found).getModificationTime() / 1000


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, on the driver."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, from the driver."""
    files, found = _path(spark, path)
    out = files.create(found, True)
    out.write(bytearray(text.encode()))
    out.close()


def forget(spark: SparkSession) -> int:
    """Delete what ``stash`` has written in this process, when no frame made from it is used any more."""
    paths = _stashed[:]
    for p in paths:
        delete(spark, p)
        _stashed.remove(p)
    return len(paths)
