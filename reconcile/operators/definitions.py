"""Table definitions as data: columns, partitions and properties of DDL text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reconcile.functions import ddl

_COLUMN = pa.struct(
    [("ordinal", pa.int32()), ("name", pa.string()), ("data_type", pa.string()), ("comment", pa.string())]
)
_PARSED = pa.struct(
    [
        ("columns", pa.list_(_COLUMN)),
        ("partitions", pa.list_(_COLUMN)),
        ("partitioned_by", pa.string()),
        ("table_properties", pa.map_(pa.string(), pa.string())),
        *((name, pa.string()) for name in ("format", "location", "input_format", "output_format", "serialization_library")),
    ]
)
_COLUMN_DDL = "array<struct<ordinal: int, name: string, data_type: string, comment: string>>"
_PARSED_DDL = (
    f"struct<columns: {_COLUMN_DDL}, partitions: {_COLUMN_DDL},"
    " partitioned_by: string, table_properties: map<string, string>, format: string, location: string,"
    " input_format: string, output_format: string, serialization_library: string>"
)


def parse(content: Column, full: bool = True) -> Column:
    """``struct<columns, partitions, partitioned_by, table_properties, format, location, input_format, ...>`` of a definition.

    Clauses count outside of brackets, quotes and comments only. Without ``full``, ``partitions`` and ``table_properties`` stay empty and cost nothing.
    """

    def parse_batch(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else ddl.parse(t, full) for t in texts.to_pylist()], _PARSED)

    return F.arrow_udf(parse_batch, _PARSED_DDL)(content)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """The same rows, dealt by the columns ``by`` over tasks of even size, at least as many as there are cores.

    Definitions take a hundred times as long to parse as to read, so that a file
    of a size that suits a scan would keep one task busy for very long. Spark
    coalesces what is dealt by size, down to ``spark.sql.adaptive.coalescePartitions.minPartitionSize``.
    """
    return df.repartition(*by)


def rows_of(df: DataFrame, keys: list[str], entries: Column, first: str) -> DataFrame:
    """``keys`` and a row for each entry of an array of structs, of which ``first`` is never null.

    With a plain inline Spark would push a filter on the array's size below the
    projection that makes it, and everything the array is made of would be
    worked out twice.
    """
    return df.select(*keys, F.inline_outer(entries)).where(F.col(first).isNotNull())


def location(content: Column) -> Column:
    """The quoted string after LOCATION."""
    return parse(content, full=False)["location"]


def stored_as(content: Column) -> Column:
    """The word after STORED AS, in upper case (``INPUTFORMAT`` for the long form)."""
    return parse(content, full=False)["format"]


def storage(parsed: Column) -> Column:
    """``struct<location, input_format, output_format, serialization_library>`` of a parsed definition."""
    return F.struct(*(parsed[name].alias(name) for name in ("location", "input_format", "output_format", "serialization_library")))


def split_location(url: Column) -> Column:
    """``s3://bucket/key`` as ``struct<bucket, key>``; null if either part is empty."""
    pattern = r"(?s)\As3://([^/]+)/(.+)\z"
    parts = F.struct(
        F.regexp_extract(url, pattern, 1).alias("bucket"), F.regexp_extract(url, pattern, 2).alias("key")
    )
    return F.when(url.rlike(pattern), parts)


def columns(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """One row per column: ``keys, ordinal, name, data_type, comment``."""
    return rows_of(spread(df, *keys, content), keys, parse(F.col(content), full=False)["columns"], "name")


def properties(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """``keys, location, format, partitions, table_properties``."""
    parsed = F.col("__parsed")
    return spread(df, *keys, content).select(*keys, parse(F.col(content)).alias("__parsed")).select(
        *keys,
        parsed["location"].alias("location"),
        parsed["format"].alias("format"),
        parsed["partitioned_by"].alias("partitions"),
        parsed["table_properties"].alias("table_properties"),
    )


def table_definitions(df: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """The whole definition as one nested row per key."""
    parsed = F.col("__parsed")
    return spread(df, *keys, content).select(*keys, parse(F.col(content)).alias("__parsed")).select(
        *keys,
        parsed["columns"].alias("columns"),
        parsed["partitions"].alias("partitions"),
        storage(parsed).alias("storage_descriptor"),
        parsed["table_properties"].alias("table_properties"),
    )
