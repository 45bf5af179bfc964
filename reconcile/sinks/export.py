"""Export: copy a snapshot to a destination, new keys only or replacing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from reconcile.plans.plan import Where, scoped
from reconcile.sources.versions import append_version, latest_version, read_version, write_version

# What becomes of a key.
EXPORTED, SKIPPED, ERROR = "exported", "skipped", "error"


def _usable(df: DataFrame, keys: list[str]) -> Column:
    """No key column is null or empty: neither could name a file or come back as it was."""
    usable = F.lit(True)
    for key in keys:
        usable &= F.coalesce(F.col(key).cast("string") != "", F.lit(False))
    return usable


def plan_export(
    snapshot: DataFrame,
    existing: DataFrame | None,
    keys: list[str],
    value: str,
    overwrite: bool = False,
    targets: Iterable[str] | None = None,
    where: Where | None = None,
) -> DataFrame:
    """``keys, status`` of every key in scope.

    ``skipped`` if the destination has the key and is not to be overwritten, else
    ``error`` if there is no value or a part of the key is null or empty, else
    ``exported``. A key that repeats is an error raised by any action that reads
    ``status``. Values stay where they are: the join moves keys and one flag.
    """
    known = F.col(value).isNotNull() & _usable(snapshot, keys)
    # Keys that can't be told apart are one error each time they occur.
    nth = F.when(~_usable(snapshot, keys), F.monotonically_increasing_id())
    rows = scoped(snapshot, keys, targets, where).select(*keys, known.alias("__known"), nth.alias("__nth"))
    rows = rows.groupBy(*keys, "__nth").agg(F.count("*").alias("__n"), F.max("__known").alias("__known"))
    named = F.concat_ws(".", *[F.col(k).cast("string") for k in keys])
    repeated = F.raise_error(F.concat(F.lit("key occurs more than once: "), named)).cast("string")
    status = F.when(F.col("__n") > 1, repeated).when(F.col("__known"), EXPORTED).otherwise(ERROR)
    if existing is None or overwrite:
        return rows.select(*keys, status.alias("status"))
    there = scoped(existing, keys, targets, where).select(*keys).distinct().withColumn("__there", F.lit(True))
    return rows.join(there, keys, "left").select(
        *keys, F.when(F.col("__n") > 1, repeated).when(F.col("__there"), SKIPPED).otherwise(status).alias("status")
    )


def export_totals(status: DataFrame) -> DataFrame:
    """``status, n``."""
    return status.groupBy("status").agg(F.count("*").alias("n"))


def exported_rows(snapshot: DataFrame, existing: DataFrame | None, keys: list[str], value: str, overwrite: bool = False) -> DataFrame:
    """The rows of the snapshot that an export writes."""
    rows = snapshot.where(F.col(value).isNotNull() & _usable(snapshot, keys))
    if existing is None or overwrite:
        return rows
    return rows.join(existing.select(*keys).distinct(), keys, "left_anti").select(*snapshot.columns)


def write_export(
    snapshot: DataFrame,
    root: str,
    keys: list[str],
    value: str,
    overwrite: bool = False,
    targets: Iterable[str] | None = None,
    where: Where | None = None,
) -> dict[str, int]:
    """Export to ``root``, one directory per container, and return the number of keys by status.

    New keys are added to the latest version, all at once when their job commits.
    Overwriting writes a new version: the snapshot's rows and, of the old
    version, those of other keys.
    Exporting again after a failure skips what is already there. Several exports may
    run at once: of two that end together the second sees that the first has been, and starts again.
    """
    spark = snapshot.sparkSession
    targets = None if targets is None else list(targets)
    snapshot = scoped(snapshot, keys, targets, where)
    container = keys[:1] if len(keys) > 1 else None
    while True:
        existing = read_version(spark, root, schema=snapshot.schema)
        version = None if existing is None else latest_version(spark, root)
        totals = {r.status: r.n for r in export_totals(plan_export(snapshot, existing, keys, value, overwrite)).collect()}
        rows = exported_rows(snapshot, existing, keys, value, overwrite)
        if existing is None or overwrite:
            others = existing and existing.join(rows.select(*keys), keys, "left_anti").select(*snapshot.columns)
            done = write_version(rows if others is None else others.unionByName(rows), root, container)
        else:
            done = not totals.get(EXPORTED) or append_version(rows, root, version, container)
        if done:
            return totals
        # Another export was first: what it has put there is skipped now.
