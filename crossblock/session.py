"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: A local session's own folder, and the folders of open workspaces.
_own: str | None = None
_folders: list[str] = []


def session(master: str | None = None, app: str = "crossblock", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local session may fall back to a folder of its own: on a cluster a
    machine-local folder is lost with its machine.
    """
    global _own
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is not None:
        return named
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="crossblock-")
    return _own


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Collect the files that `cut` and `scratch_path` make inside, and delete them at the end.

    What is still needed must have been read, or written elsewhere, by then.
    """
    folder = f"{shared_dir(spark)}/workspace-{uuid.uuid4().hex}"
    _folders.append(folder)
    try:
        yield folder
    finally:
        _folders.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    folder = _folders[-1] if _folders else shared_dir(spark)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    For frames that several branches read: none recomputes it, its plan ends here, and it
    outlives the executors that made it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
