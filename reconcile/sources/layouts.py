"""Snapshots laid out for what will be asked of them: in buckets of the keys, in directories of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

DAY = ["year", "month", "day"]


def write_bucketed(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> DataFrame:
    """Write df as the external table ``name`` at ``path``, bucketed and sorted by the keys, and give it back.

    ``plan(strategy="join")`` of two such tables with the same keys and number of
    buckets moves no row. One file for each bucket: rows are gathered before they are written.
    """
    gathered = df.repartition(buckets, *keys)
    gathered.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def write_by_day(df: DataFrame, at: Column, path: str) -> None:
    """Write df below ``year=YYYY/month=MM/day=DD`` directories, by a timestamp; a large day is several files."""
    parts = {"year": "yyyy", "month": "MM", "day": "dd"}
    dated = df.withColumns({name: F.date_format(at, form) for name, form in parts.items()})
    dated.hint("rebalance", *DAY).write.partitionBy(*DAY).parquet(path)


def read_by_day(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``write_by_day`` wrote of rows with this schema. Conditions on the three strings prune directories."""
    for name in DAY:
        # Given, not guessed: month 01 is no number.
        schema = schema.add(name, StringType())
    return spark.read.schema(schema).parquet(path)
