"""Snapshots in versions: whole directories that become current by being complete."""

from __future__ import annotations

import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a local session may do without that setting."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="run-")
    return shared.rstrip("/")


def names_in(spark: SparkSession, directory: str) -> list[str]:
    """Names of what a directory holds; nothing if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in fs.listStatus(path)] if fs.exists(path) else []


def rename_if_absent(spark: SparkSession, source: str, target: str, text: str | None = None) -> bool:
    """Give ``source`` the name ``target``, or say False if that is taken. With ``text``, source is first written with it.

    On HDFS and local disks a rename is one step; of two writers one is told. An
    object store needs a committer that has such a step.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(source), hadoop.Path(target)
    configuration = spark._jsc.hadoopConfiguration()
    fs = old.getFileSystem(configuration)
    if text is not None:
        stream = fs.create(old, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
    fs.mkdirs(new.getParent())
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        hadoop.FileContext.getFileContext(fs.getUri(), configuration).rename(fs.makeQualified(old), fs.makeQualified(new), options)
        return True
    except Py4JJavaError as error:
        taken = error.java_exception.getClass().getSimpleName() in ("FileAlreadyExistsException", "IOException")
        if not (taken and fs.exists(new)):
            raise
        fs.delete(old, True)
        return False


def _versions(spark: SparkSession, pattern: str, part: str = "version") -> list[int]:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [int(re.search(rf"{part}=(\d+)", f.getPath().toString()[-60:])[1]) for f in found]


def latest_version(spark: SparkSession, root: str) -> int | None:
    """The highest ``<root>/version=N`` whose write has finished, as its ``_SUCCESS`` file tells."""
    return max(_versions(spark, f"{root}/version=*/_SUCCESS"), default=None)


def read_version(
    spark: SparkSession, root: str, version: int | None = None, schema: StructType | None = None
) -> DataFrame | None:
    """A version, the latest by default; None if there is none yet.

    Give the ``schema`` of a version written with ``partition_by``: without it
    Spark guesses the type of those columns from directory names, and a
    database called ``007`` would come back as a number.
    """
    version = latest_version(spark, root) if version is None else version
    if version is None:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(f"{root}/version={version}")
    more = f"{root}/added-to={version}"
    for number in sorted(_versions(spark, f"{more}/part=*/_SUCCESS", "part")):
        df = df.unionByName(reader.parquet(f"{more}/part={number}"))
    return df


def append_version(df: DataFrame, root: str, version: int, partition_by: list[str] | None = None) -> str | None:
    """Add ``df`` to a version: a directory beside it, which gets its name when it is complete.

    Gives the path, or None if another writer was first since ``df`` was read: the
    name is the number that follows those which were there. Decide anew then what is missing.
    """
    spark, more = df.sparkSession, f"{root}/added-to={version}"
    path = f"{more}/part={max(_versions(spark, f'{more}/part=*', 'part'), default=-1) + 1}"
    unnamed = f"{root}/.unnamed-{uuid.uuid4().hex}"
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("error").parquet(unnamed, partitionBy=partition_by)
    return path if rename_if_absent(spark, unnamed, path) and latest_version(spark, root) == version else None


def write_version(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as the next version and return its path.

    Nothing that may be read from is overwritten. Readers switch over when the
    job commits, all at once; a job that dies leaves the old version current and
    its number unused.
    One writer at a time: a second one fails on the existing path.
    """
    path = f"{root}/version={max(_versions(df.sparkSession, f'{root}/version=*'), default=-1) + 1}"
    if partition_by:
        # Tasks of even size per directory: AQE splits a container that is too large.
        df = df.hint("rebalance", *partition_by)
    df.write.mode("error").parquet(path, partitionBy=partition_by)
    return path
