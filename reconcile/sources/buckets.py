"""Tables in buckets of keys, of which a change rewrites only those that it touches.

``<root>/files/<write>/bucket=<n>/`` holds the rows of a bucket as one write left them, ``<root>/manifests/<version>.json``
says which write each bucket is read from. Files are never changed. A new version is a new manifest that shares the
buckets it leaves alone with the one before; it comes into being by a rename that fails if the version is there already,
so readers see a version whole or not at all, a job that dies leaves the table as it was, and of two
writers the second notices. A manifest is as long as there are buckets, however many rows there are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from reconcile.sources.versions import names_in, rename_if_absent

BUCKET = "bucket"


class Conflict(Exception):
    """Another writer has changed a bucket that this one was to replace."""


class Manifest(NamedTuple):
    version: int
    keys: list[str]
    buckets: int
    schema: StructType
    held: dict[int, str]  # bucket -> the write it is read from; a bucket without rows is not there


def bucket_of(manifest: Manifest) -> Column:
    """The bucket of a row. Keys are hashed as the table's types, so that an int finds a long."""
    typed = [F.col(k).cast(manifest.schema[k].dataType) for k in manifest.keys]
    return F.pmod(F.xxhash64(*typed), F.lit(manifest.buckets)).cast("int")


def create_buckets(df: DataFrame, root: str, keys: list[str], buckets: int = 64) -> Manifest:
    """Write df as version 0 of a table in buckets; it is an error if there is one."""
    empty = Manifest(-1, list(keys), buckets, df.schema, {})
    write = _written(df, root, empty)
    return commit(df.sparkSession, root, empty, write, range(buckets))


def latest_manifest(spark: SparkSession, root: str) -> Manifest | None:
    versions = [int(name[:-5]) for name in names_in(spark, f"{root}/manifests") if name.endswith(".json") and name[:-5].isdigit()]
    return read_manifest(spark, root, max(versions)) if versions else None


def read_manifest(spark: SparkSession, root: str, version: int) -> Manifest:
    text = spark.read.text(f"{root}/manifests/{version}.json", wholetext=True).first()[0]
    found = json.loads(text)
    held = {int(b): found["writes"][w] for b, w in found["held"].items()}
    return Manifest(version, found["keys"], found["buckets"], StructType.fromJson(found["schema"]), held)


def read_buckets(spark: SparkSession, root: str, manifest: Manifest | None = None, only: Iterable[int] | None = None) -> DataFrame:
    """The table, by default its latest version; ``only`` some buckets of it. One scan, whatever its history."""
    manifest = manifest or latest_manifest(spark, root)
    if manifest is None:
        raise FileNotFoundError(f"no table in buckets: {root}")
    chosen = manifest.held if only is None else set(only) & manifest.held.keys()
    paths = [f"{root}/files/{manifest.held[b]}/{BUCKET}={b}" for b in sorted(chosen)]
    return spark.read.schema(manifest.schema).parquet(*paths) if paths else spark.createDataFrame([], manifest.schema)


def replace_buckets(df: DataFrame, root: str, base: Manifest, touched: Iterable[int]) -> Manifest:
    """The next version: the touched buckets hold df's rows, the others what they held."""
    return commit(df.sparkSession, root, base, _written(df, root, base), touched)


def _written(df: DataFrame, root: str, manifest: Manifest) -> str:
    """df below the name of a new write, a directory for each bucket; no reader knows it yet."""
    write = uuid.uuid4().hex
    columns = [F.col(f.name).cast(f.dataType) for f in manifest.schema.fields]
    # Each bucket is gathered, so that it isn't a file for every task; AQE splits one that is large.
    rows = df.select(*columns, bucket_of(manifest).alias(f"__{BUCKET}")).hint("rebalance", f"__{BUCKET}")
    rows.withColumnRenamed(f"__{BUCKET}", BUCKET).write.mode("error").partitionBy(BUCKET).parquet(f"{root}/files/{write}")
    return write


def commit(spark: SparkSession, root: str, base: Manifest, write: str, touched: Iterable[int]) -> Manifest:
    """Make the write current in the touched buckets.

    Where another version came first, this one is put on top of it if it left
    the touched buckets as they were in ``base``; else it is a conflict.
    """
    touched = set(touched)
    there = {int(name.split("=")[1]) for name in names_in(spark, f"{root}/files/{write}") if name.startswith(f"{BUCKET}=")}
    latest = base
    while True:
        held = {b: w for b, w in latest.held.items() if b not in touched} | {b: write for b in there}
        writes = sorted(set(held.values()))
        places = {w: n for n, w in enumerate(writes)}
        text = json.dumps({
            "keys": base.keys, "buckets": base.buckets, "schema": base.schema.jsonValue(), "writes": writes,
            "held": {b: places[w] for b, w in sorted(held.items())},
        })
        if rename_if_absent(spark, f"{root}/manifests/.{uuid.uuid4().hex}", f"{root}/manifests/{latest.version + 1}.json", text):
            return Manifest(latest.version + 1, base.keys, base.buckets, base.schema, held)
        latest = latest_manifest(spark, root)
        if any(latest.held.get(b) != base.held.get(b) for b in touched) or latest.buckets != base.buckets:
            raise Conflict(f"{root}: version {latest.version} has changed what version {base.version} held")


def retried(work: Callable[[Manifest], Manifest | None], spark: SparkSession, root: str) -> Manifest | None:
    """``work`` on the latest version, and again on a newer one as often as another writer was first."""
    while True:
        try:
            return work(latest_manifest(spark, root))
        except Conflict:
            continue
