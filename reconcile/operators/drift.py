"""Drift: which cells, columns, properties and lines of the updated rows differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reconcile.operators import definitions
from reconcile.plans.plan import UPDATE

# The kinds of column change, and the named properties.
ADDED, REMOVED, TYPE_CHANGED, COMMENT_CHANGED = "Added", "Removed", "TypeChanged", "CommentChanged"
PROPERTIES = ["location", "format", "partitions"]
_COLUMN_CHANGES = "array<struct<change_type: string, column_name: string, old_type: string, new_type: string>>"
_PROPERTY_CHANGES = "array<struct<property_name: string, old_value: string, new_value: string>>"


def cell_changes(plan: DataFrame, keys: list[str]) -> DataFrame:
    """One row per changed cell: ``keys, column_name, old_value, new_value``."""
    return plan.where(F.col("operation") == UPDATE).select(*keys, F.inline("changes"))


def _change_type(old: Column, new: Column, comments: bool) -> Column:
    """Null where the two columns (structs, null when absent) do not differ."""
    kind = (
        F.when(old.isNull() & new.isNull(), F.lit(None))
        .when(old.isNull(), ADDED)
        .when(new.isNull(), REMOVED)
        .when(~old["data_type"].eqNullSafe(new["data_type"]), TYPE_CHANGED)
    )
    return kind.when(~old["comment"].eqNullSafe(new["comment"]), COMMENT_CHANGED) if comments else kind


def column_changes(old: DataFrame, new: DataFrame, keys: list[str], comments: bool = False) -> DataFrame:
    """``keys, change_type, column_name, old_type, new_type`` of two column tables.

    Both hold ``keys, name, data_type`` (and ``comment``), one row per column as
    ``definitions.columns`` returns them. Both sides meet in one exchange on
    table and column name, so a table with very many columns is spread out. A
    name that repeats on one side (case aside) is an error.
    """
    fields = ["data_type", *(["comment"] if comments else [])]

    def side(df: DataFrame, is_old: bool) -> DataFrame:
        return df.select(*keys, F.lower("name").alias("column_name"), F.struct(*fields).alias("__c"), F.lit(is_old).alias("__old"))

    both = side(old, True).unionByName(side(new, False))
    repeated = F.greatest(F.count_if("__old"), F.count_if(~F.col("__old"))) > 1
    matched = both.groupBy(*keys, "column_name").agg(
        repeated.alias("__repeated"),
        F.max(F.when(F.col("__old"), F.col("__c"))).alias("__was"),
        F.max(F.when(~F.col("__old"), F.col("__c"))).alias("__will"),
    )
    was, will = F.col("__was"), F.col("__will")
    twice = F.raise_error(F.concat(F.lit("column occurs more than once: "), F.col("column_name"))).cast("string")
    kind = F.when(F.col("__repeated"), twice).otherwise(_change_type(was, will, comments))
    return matched.withColumn("change_type", kind).where("change_type is not null").select(
        *keys, "change_type", "column_name", was["data_type"].alias("old_type"), will["data_type"].alias("new_type")
    )


def _merged_changes(old: Column, new: Column, comments: bool) -> Column:
    """The same for two arrays of columns in one row, without a shuffle; ordered by name.

    A map from name to both sides: names are unique within a side, so the map of
    old columns and the map of new ones are zipped by key.
    """

    def by_name(columns: Column) -> Column:
        return F.map_from_entries(F.transform(columns, lambda c: F.struct(c["name"], c)))

    paired = F.map_zip_with(
        by_name(old),
        by_name(new),
        lambda name, was, will: F.struct(
            _change_type(was, will, comments).alias("change_type"),
            name.alias("column_name"),
            was["data_type"].alias("old_type"),
            will["data_type"].alias("new_type"),
        ),
    )
    changes = F.filter(F.map_values(paired), lambda c: c["change_type"].isNotNull())
    return F.array_sort(changes, lambda a, b: F.when(a["column_name"] < b["column_name"], -1).otherwise(1))


def _property_changes(old: Column, new: Column, table_properties: bool) -> Column:
    """Named properties of two ``properties`` structs, then table properties by name if asked."""

    def change(name: Column, was: Column, will: Column) -> Column:
        entry = F.struct(name.alias("property_name"), was.alias("old_value"), will.alias("new_value"))
        return F.when(~was.eqNullSafe(will), entry)

    named = F.array_compact(F.array(*[change(F.lit(p), old[p], new[p]) for p in PROPERTIES]))
    if not table_properties:
        return named
    zipped = F.map_zip_with(old["table_properties"], new["table_properties"], change)
    return F.concat(named, F.array_sort(F.array_compact(F.map_values(zipped))))


def _side(parsed: Column) -> Column:
    return F.struct(
        parsed["columns"].alias("columns"),
        parsed["location"].alias("location"),
        parsed["format"].alias("format"),
        parsed["partitioned_by"].alias("partitions"),
        parsed["table_properties"].alias("table_properties"),
    )


def property_changes(
    pairs: DataFrame, keys: list[str], old: str, new: str, table_properties: bool = False
) -> DataFrame:
    """``keys, property_name, old_value, new_value``: location, format and partitions of two definitions.

    Present on one side only counts as a change. ``table_properties`` adds the
    TBLPROPERTIES entry by entry. Pairs of different texts are dealt over
    tasks of even size before they are parsed.
    """
    differing = definitions.spread(pairs.where(F.col(old) != F.col(new)), *keys, old, new)
    detailed = change_details(differing, old, new, table_properties=table_properties)
    return property_changes_of(detailed, keys)


def column_changes_of(detailed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, change_type, column_name, old_type, new_type``: a row for each column change of ``change_details``."""
    return definitions.rows_of(detailed, keys, F.col("change_details.column_changes"), "change_type")


def property_changes_of(detailed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, property_name, old_value, new_value``: a row for each property change of ``change_details``."""
    return definitions.rows_of(detailed, keys, F.col("change_details.property_changes"), "property_name")


def change_details(
    pairs: DataFrame, old: str, new: str, comments: bool = False, table_properties: bool = False
) -> DataFrame:
    """``pairs`` with ``change_details``: column and property changes of two definitions in a row.

    Null where a text is null; both lists may be empty where the texts differ
    elsewhere. Equal texts are not parsed, and nothing is shuffled.
    """
    known = F.col(old).isNotNull() & F.col(new).isNotNull()
    differ = F.col(old) != F.col(new)
    parsed = pairs.withColumns(
        {
            "__was": definitions.parse(F.when(differ, F.col(old)), table_properties),
            "__will": definitions.parse(F.when(differ, F.col(new)), table_properties),
        }
    )
    sides = parsed.withColumns(
        {"__was": _side(F.col("__was")), "__will": _side(F.col("__will"))}
    )
    was, will = F.col("__was"), F.col("__will")
    details = F.struct(
        F.coalesce(_merged_changes(was["columns"], will["columns"], comments), F.array().cast(_COLUMN_CHANGES)).alias("column_changes"),
        F.coalesce(_property_changes(was, will, table_properties), F.array().cast(_PROPERTY_CHANGES)).alias("property_changes"),
    )
    return sides.withColumn("change_details", F.when(known, details)).drop("__was", "__will")
