"""Apply: the table that results from a plan, staged and then switched to."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from reconcile.plans.plan import CREATE, DELETE, UPDATE, last_rows
from reconcile.plans.results import summarize
from reconcile.sources.buckets import BUCKET, Manifest, bucket_of, latest_manifest, read_buckets, replace_buckets
from reconcile.sources.versions import read_version, write_version


class Applied(NamedTuple):
    plan: DataFrame
    path: str | None  # the new version, None if nothing was written


def reconciled(
    current: DataFrame, desired: DataFrame, plan: DataFrame, keys: list[str], order_by: list[str] | None = None
) -> DataFrame:
    """``current`` with the plan carried out: rows deleted, replaced whole, and created.

    A plan made with ``duplicates="last"`` needs its ``order_by`` here too: of a key
    that repeats in ``desired`` only the last row is put in. A null key on either side is an error.

    Only keys of the plan take part in the joins. A plan read from files has a
    known size; Spark broadcasts it when it is small, and neither table moves.
    Rows of ``current`` that the plan does not name stay as they are.
    """

    def of(*operations: str) -> DataFrame:
        return plan.where(F.col("operation").isin(*operations)).select(*keys)

    def known(df: DataFrame) -> DataFrame:
        # Within the value that the join reads, so that no filter on the key can go before it.
        lacking = F.raise_error(F.lit(f"null in key: {', '.join(keys)}"))
        checked = {k: F.when(F.col(k).isNull(), lacking.cast(df.schema[k].dataType)).otherwise(F.col(k)) for k in keys}
        return df.withColumns(checked)

    kept = known(current).join(of(DELETE, UPDATE), keys, "left_anti")
    added = known(desired).join(of(CREATE, UPDATE), keys, "left_semi")
    if order_by:
        added = last_rows(added, keys, order_by)
    return kept.select(*current.columns).unionByName(added.select(*current.columns))


def apply_plan(
    current: DataFrame,
    desired: DataFrame,
    plan: DataFrame,
    keys: list[str],
    root: str,
    dry_run: bool = True,
    approved: bool = False,
    max_deletes: int | None = None,
    partition_by: list[str] | None = None,
    order_by: list[str] | None = None,
) -> Applied:
    """Write the reconciled table as the next version below ``<root>/state``.

    A dry run stops at the plan. Otherwise the plan is first written below
    ``<root>/plans``, so that it is computed once and what is approved is what
    is applied. A plan without changes writes no state; with changes it needs
    ``approved``. More than ``max_deletes`` deletions are refused. The state is
    replaced as a whole, it is not merged in place.
    """
    if dry_run:
        return Applied(plan, None)
    spark = current.sparkSession
    write_version(plan, f"{root}/plans")
    staged = read_version(spark, f"{root}/plans")
    summary = summarize(staged).first()
    _check(summary, approved, max_deletes)
    if summary.no_change:
        return Applied(staged, None)
    return Applied(staged, write_version(reconciled(current, desired, staged, keys, order_by), f"{root}/state", partition_by))


def apply_incremental(
    desired: DataFrame,
    plan: DataFrame,
    root: str,
    approved: bool = False,
    max_deletes: int | None = None,
    order_by: list[str] | None = None,
    base: Manifest | None = None,
) -> Manifest:
    """Carry a plan out on a table in buckets (``sources.create_buckets``), rewriting only the buckets that hold its keys.

    The plan, made against version ``base`` (by default the latest), is written down
    first, as in ``apply_plan``, with the same checks. Readers go on with
    the old version until the new one is whole. If another writer has meanwhile changed one of these
    buckets the plan is out of date and nothing is done (``Conflict``); a writer of other buckets is no matter.
    """
    spark = plan.sparkSession
    base = base or latest_manifest(spark, root)
    if base is None:
        raise FileNotFoundError(f"no table in buckets: {root}")
    write_version(plan.withColumn(BUCKET, bucket_of(base)), f"{root}/plans")
    staged = read_version(spark, f"{root}/plans")
    _check(summarize(staged).first(), approved, max_deletes)
    changes = staged.where(F.col("operation").isin(CREATE, UPDATE, DELETE))
    touched = [row[0] for row in changes.select(BUCKET).distinct().collect()]  # at most one for each bucket
    if not touched:
        return base
    current = read_buckets(spark, root, base, touched)
    return replace_buckets(reconciled(current, desired, changes.drop(BUCKET), base.keys, order_by), root, base, touched)


def _check(summary, approved: bool, max_deletes: int | None) -> None:
    if not summary.no_change and not approved:
        raise PermissionError(f"{summary.total_changes} changes are not approved")
    if max_deletes is not None and summary.to_destroy > max_deletes:
        raise PermissionError(f"{summary.to_destroy} deletions, {max_deletes} allowed")
