"""Shared folders for checkpoints and hand-over files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(session: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, seen by every executor.

    There is no fallback: a machine-local folder would scatter the rows over the executors' disks.
    """
    folder = session.conf.get(SETTING, None) or session.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    return folder


def local_fallback(session: SparkSession) -> None:
    """Names a temporary folder where none is set and driver and executors are one process, as in
    tests and local trials. Does nothing on a cluster."""
    context = session.sparkContext
    unset = not session.conf.get(SETTING, None) and context.getCheckpointDir() is None
    if unset and context.master.split("[")[0] == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="larder-"))


def pinned(df: DataFrame) -> DataFrame:
    """The rows written to the reliable checkpoint folder, so that lost executors never force a
    long recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def application_folder(session: SparkSession) -> str:
    return f"{shared_folder(session).rstrip('/')}/larder-{session.sparkContext.applicationId}"


def scratch_path(session: SparkSession, name: str) -> str:
    """A fresh path for a table that one step writes and the next reads."""
    return f"{application_folder(session)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: columnar, so wide results take little disk."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(session: SparkSession) -> None:
    """Deletes every hand-over table of this application; call it once the results are written."""
    jvm = session.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(application_folder(session))
    path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
