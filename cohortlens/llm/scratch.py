"""The shared folder for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without one gets its own."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="cohortlens-llm-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once (reliable checkpoint): later reads neither
    recompute it nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read from there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_shared(spark: SparkSession, name: str, array) -> str:
    """Save a NumPy array as a file of the shared folder; returns its path."""
    import io

    import numpy as np
    from pyarrow import fs

    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    where, at = filesystem(path)
    data = io.BytesIO()
    np.save(data, array)
    where.create_dir(at.rpartition("/")[0])
    with where.open_output_stream(at, compression=None) as out:
        out.write(data.getvalue())
    return path


def filesystem(path: str):
    """(file system, path in it) of a folder's URI or local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application, so that tasks can import it
    wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    import io
    import os
    import zipfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    at = os.path.join(folder, n)
                    z.write(at, os.path.relpath(at, os.path.dirname(root)))
    path = f"{shared_dir(spark).rstrip('/')}/cohortlens-{uuid.uuid4().hex}.zip"
    where, at = filesystem(path)
    where.create_dir(at.rpartition("/")[0])
    with where.open_output_stream(at, compression=None) as out:
        out.write(data.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
