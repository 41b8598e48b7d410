"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", **conf) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flowloom")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session, where driver and executors share one disk, falls back
    to a temporary folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="flowloom-")
    context.setCheckpointDir(folder)
    return folder


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write an intermediate result once, as Parquet, so that several jobs can read it.

    A shared file survives the loss of any executor, and reading it back prunes columns.
    """
    path = work_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """Store ``df`` and mark it for broadcast only when its plan statistics stay below ``most_bytes``."""
    stored = materialise(df)
    return F.broadcast(stored) if plan_bytes(stored) <= most_bytes else stored


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``, without running it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def open_folder(uri: str):
    """The Arrow file system of a shared folder or file, and the path in it.

    Spark's names of stores are translated; a store that Arrow cannot reach is refused.
    """
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if colon else uri
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    known = {"s3a": "s3", "s3n": "s3", "abfss": "abfss", "s3": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs"}
    if scheme not in known:
        raise ValueError(f"tasks cannot open files in a {scheme}: folder; set spark.checkpoint.dir to a file, s3a, gs, abfss, dbfs or hdfs folder")
    return fs.FileSystem.from_uri(f"{known[scheme]}:{rest}")
