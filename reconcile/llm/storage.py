"""Reading tables and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of a few longs that may be sent to every executor (about 64 MB); above that a join shuffles.
BROADCAST_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting (a test) gets a folder of its own.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp()
        context.setCheckpointDir(shared)
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and reread from the shared folder; lost executors cost nothing then."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame) -> DataFrame:
    """df (of cheap lineage, a few narrow columns), marked for broadcast only if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, spread: Column, salts: int = 32, how: str = "inner") -> DataFrame:
    """rows joined to the one row of lookup with an equal key (null equals null); ``how="left"`` keeps rows without one.

    A key that holds a third of all rows is dealt over ``salts`` parts by
    ``spread``; lookup, one row for each key, is repeated that often.
    """
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    copies = copies.withColumnRenamed(key, "_key").withColumnRenamed("_salt", "_salt_of_copy")
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    matched = (F.col(key).eqNullSafe(F.col("_key"))) & (F.col("_salt") == F.col("_salt_of_copy"))
    return dealt.join(copies, matched, how).drop("_key", "_salt", "_salt_of_copy")
