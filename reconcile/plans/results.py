"""What is read off a plan: summary, notices, report and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from reconcile.functions.keys import qualified_name
from reconcile.plans.plan import CREATE, DELETE, NO_CHANGE, UPDATE

# How each operation is shown, in the order of the report.
SHOWN = [
    (CREATE, 0, "+", "create", "is new and will be added"),
    (DELETE, 1, "-", "delete", "is not wanted and will be removed"),
    (UPDATE, 2, "~", "update", "differs and will be changed"),
    (NO_CHANGE, 3, " ", "no change", "is as wanted"),
]
NOTHING_TO_DO = "Both snapshots agree: nothing is to be done."


def _shown(operation: Column, field: int) -> Column:
    chosen = F.when(operation == SHOWN[0][0], SHOWN[0][field])
    for row in SHOWN[1:]:
        chosen = chosen.when(operation == row[0], row[field])
    return chosen


def rank(operation: Column) -> Column:
    return _shown(operation, 1)


def marker(operation: Column) -> Column:
    return _shown(operation, 2)


def display_name(operation: Column) -> Column:
    return _shown(operation, 3)


def is_change(operation: Column) -> Column:
    return operation != NO_CHANGE


def summarize(plan: DataFrame) -> DataFrame:
    """One row: ``to_add, to_change, to_destroy, no_change, has_changes, total_changes``."""
    counts = plan.agg(
        *[
            F.count_if(F.col("operation") == operation).alias(name)
            for operation, name in ((CREATE, "to_add"), (UPDATE, "to_change"), (DELETE, "to_destroy"))
        ]
    )
    total = F.col("to_add") + F.col("to_change") + F.col("to_destroy")
    return counts.select("*", (total == 0).alias("no_change"), (total > 0).alias("has_changes"), total.alias("total_changes"))


def containers_to_create(plan: DataFrame, container: str = "database_name") -> DataFrame:
    """Distinct containers of the rows to create, sorted; existing ones are not left out."""
    return plan.where(F.col("operation") == CREATE).select(container).distinct().orderBy(container)


def changed_names(plan: DataFrame, keys: list[str]) -> DataFrame:
    """``operation, name`` of everything that changes."""
    return plan.where(is_change(F.col("operation"))).select("operation", qualified_name(*keys).alias("name"))


def report(plan: DataFrame, keys: list[str], show_unchanged: bool = False) -> DataFrame:
    """The plan for readers, one row per line group, ordered.

    ``section`` 0 is the summary, 1 the containers to create, 2 the changes by
    operation and key. The plan is read three times; its exchange is the same
    each time and Spark runs it once.
    """
    empty = F.lit(None).cast("string")
    counted = summarize(plan)
    head = F.concat(
        F.lit("Plan: "), F.col("to_add"), F.lit(" to add, "), F.col("to_change"), F.lit(" to change, "),
        F.col("to_destroy"), F.lit(" to remove."), F.when(F.col("no_change"), f"\n\n{NOTHING_TO_DO}").otherwise(""),
    )
    summary = counted.select(
        F.lit(0).alias("section"), F.lit(0).alias("rank"), empty.alias("name"), empty.alias("marker"),
        head.alias("message"), empty.alias("text_diff"),
    )
    container = F.col(keys[0]).cast("string")
    notices = plan.where(F.col("operation") == CREATE).select(container.alias("name")).distinct().select(
        F.lit(1).alias("section"), F.lit(0).alias("rank"), "name", F.lit("+").alias("marker"),
        F.lit("new container, made unless it is there").alias("message"), empty.alias("text_diff"),
    )
    op = F.col("operation")
    shown = plan if show_unchanged else plan.where(is_change(op))
    rows = shown.select(
        F.lit(2).alias("section"), rank(op).alias("rank"), qualified_name(*keys).alias("name"),
        marker(op).alias("marker"), _shown(op, 4).alias("message"),
        (F.col("text_diff") if "text_diff" in plan.columns else empty).alias("text_diff"),
    )
    return summary.unionByName(notices).unionByName(rows).orderBy("section", "rank", "name")


def to_json_rows(plan: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One JSON object per row in column ``json``, fields in order, nulls written out."""
    return plan.select(_json(columns or plan.columns).alias("json"))


def from_json(rows: DataFrame, schema: StructType | str, column: str = "json") -> DataFrame:
    """The inverse of ``to_json_rows``; a malformed row is an error."""
    parsed = F.from_json(column, schema, {"mode": "FAILFAST"})
    return rows.select(parsed.alias("__row")).select("__row.*")


def json_document_lines(plan: DataFrame, keys: list[str]) -> DataFrame:
    """The whole plan as one JSON document, one line per row of column ``line``, in order.

    Written with ``df.select("line").write.text(path)``, the part files in the
    order of their names are the document. The sort is by range, so no task
    sees more than its share; the only single-row step is the summary.
    """
    op = F.col("operation")
    order = F.struct(rank(op).alias("rank"), *keys)
    first = plan.agg(F.min(order).alias("first")).scalar()
    rows = plan.select(
        F.lit(1).alias("part"), rank(op).alias("rank"), *keys,
        F.concat(F.when(order == first, "").otherwise(","), _json(plan.columns)).alias("line"),
    )
    head = summarize(plan).select(
        F.concat(
            F.lit('{"no_change":'), F.col("no_change"), F.lit(',"summary":'),
            F.to_json(F.struct("to_add", "to_change", "to_destroy")), F.lit(',"table_diffs":['),
        ).alias("line")
    )
    nothing = [F.lit(None).cast(plan.schema[k].dataType).alias(k) for k in keys]

    def edge(df: DataFrame, part: int) -> DataFrame:
        return df.select(F.lit(part).alias("part"), F.lit(0).alias("rank"), *nothing, "line")

    tail = head.select(F.lit("]}").alias("line"))
    lines = edge(head, 0).unionByName(rows).unionByName(edge(tail, 2))
    return lines.orderBy("part", "rank", *keys).select("line")


def _json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
