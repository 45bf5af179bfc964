"""Plans of table definitions: the snapshot diff with text diff and change details."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from reconcile.functions import text
from reconcile.functions.keys import qualified_name
from reconcile.operators import drift
from reconcile.operators.definitions import spread
from reconcile.plans.plan import UPDATE, Where, plan, scoped
from reconcile.sources.versions import shared_folder

KEYS = ["database_name", "table_name"]


def with_definition_details(
    planned: DataFrame,
    keys: list[str] = KEYS,
    content: str = "content",
    context: int = 3,
    comments: bool = False,
    table_properties: bool = False,
) -> DataFrame:
    """``keys, operation, text_diff, change_details`` of a plan whose changes hold ``content``."""
    found = F.get(F.filter("changes", lambda c: c["column_name"] == content), F.lit(0))
    pairs = planned.select(*keys, "operation", found["old_value"].alias("__old"), found["new_value"].alias("__new"))
    return _detailed(pairs, keys, context, comments, table_properties)


def plan_definitions(
    current: DataFrame,
    desired: DataFrame,
    keys: list[str] = KEYS,
    content: str = "content",
    targets: Iterable[str] | None = None,
    where: Where | None = None,
    include_unchanged: bool = False,
    context: int = 3,
    comments: bool = False,
    table_properties: bool = False,
    staging: str | bool | None = None,
) -> DataFrame:
    """The plan of two definition corpora, details included.

    A definition without content could not be read; its key is left out of both
    sides, see ``unreadable`` and ``sources.with_unreadable``.

    Only digests travel to learn what changed: the small plan is written to
    ``staging``, read back with its true size, and texts are fetched for updated
    keys alone; Spark broadcasts those keys if they are few, and no text moves
    that isn't shown. Their keys take them to tasks of even size before they are
    normalized, diffed and parsed. ``staging`` is a path that does not exist yet, by default one
    below the session's ``spark.checkpoint.dir``. With ``staging=False`` nothing is
    written and every text travels once, to its key; that is less work where most have changed.
    """
    options = dict(compare=[content], required=[content], normalize="trailing", include_unchanged=include_unchanged)
    if staging is False:
        planned = plan(current, desired, keys, targets=targets, where=where, **options)
        return with_definition_details(planned, keys, content, context, comments, table_properties)
    spark = current.sparkSession
    staging = f"{shared_folder(spark)}/plan-{uuid.uuid4().hex}" if staging in (None, True) else staging
    targets = None if targets is None else list(targets)
    plan(current, desired, keys, targets=targets, where=where, details=False, **options).write.parquet(staging)
    planned = spark.read.parquet(staging)
    changed = planned.where(F.col("operation") == UPDATE).select(*keys)

    def texts(df: DataFrame, name: str) -> DataFrame:
        kept = scoped(df, keys, targets, where).join(changed, keys, "left_semi")
        dealt = spread(kept.select(*keys, F.col(content).alias(name)), *keys)
        return dealt.withColumn(name, text.normalize(F.col(name)))

    pairs = texts(current, "__old").join(texts(desired, "__new"), keys)
    absent = F.lit(None).cast("string")
    others = planned.where(F.col("operation") != UPDATE)
    pairs = pairs.withColumn("operation", F.lit(UPDATE)).unionByName(
        others.withColumns({"__old": absent, "__new": absent})
    )
    return _detailed(pairs, keys, context, comments, table_properties)


def _detailed(pairs: DataFrame, keys: list[str], context: int, comments: bool, table_properties: bool) -> DataFrame:
    diffed = pairs.withColumn(
        "text_diff", text.line_diff(qualified_name(*keys), F.col("__old"), F.col("__new"), context)
    )
    detailed = drift.change_details(diffed, "__old", "__new", comments, table_properties)
    return detailed.select(*keys, "operation", "text_diff", "change_details")
