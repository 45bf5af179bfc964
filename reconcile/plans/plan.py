"""The keyed snapshot diff: what turns a current snapshot into a desired one."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from reconcile.functions import text
from reconcile.operators.filters import target_predicate

# Operation names.
CREATE, UPDATE, DELETE, NO_CHANGE = "Create", "Update", "Delete", "NoChange"

FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)

Where = Callable[..., Column]
Normalize = Callable[[Column], Column]


def scoped(df: DataFrame, keys: list[str], targets: Iterable[str] | None = None, where: Where | None = None) -> DataFrame:
    """Rows in scope, decided on key columns only.

    Both sides of a diff are cut this way *before* they meet: a filter on the
    merged key of an outer join would not reach the scans, and one side alone
    out of scope would read as a creation or deletion. ``targets`` are patterns
    on the first two key columns, ``where`` gets all key columns.
    """
    if targets:
        if len(keys) < 2:
            raise ValueError("targets need two key columns: container and member")
        names = [F.col(k) if df.schema[k].dataType == T.StringType() else F.col(k).cast("string") for k in keys[:2]]
        df = df.where(target_predicate(targets, *names))
    if where is not None:
        df = df.where(where(*[F.col(k) for k in keys]))
    return df


def plan(
    current: DataFrame,
    desired: DataFrame,
    keys: list[str],
    compare: list[str] | None = None,
    normalize: str | Normalize | None = None,
    targets: Iterable[str] | None = None,
    where: Where | None = None,
    duplicates: str = "error",
    order_by: list[str] | None = None,
    include_unchanged: bool = False,
    details: bool = True,
    strategy: str = "union",
    required: list[str] | None = None,
) -> DataFrame:
    """``keys, operation, changes`` for every key on either side.

    ``changes`` (null unless Update) lists ``column_name, old_value, new_value``
    as strings of the compared columns that differ, by default all columns
    beside the keys. ``normalize="trailing"``, or a function, is applied to
    string columns first. A null key is an error. A key that repeats on one side
    is an error too, or with ``duplicates="last"`` counts by its last row in
    ``order_by``. Both errors are raised by any action that reads ``operation``.

    A row with null in a ``required`` column, one of those compared, could not be
    read: its key takes part on neither side, so that it is not taken for a
    deletion or creation. ``unreadable`` lists such rows.

    ``details=False`` leaves ``changes`` out; what has no fixed width then travels
    as its SHA-256 digest in four whole numbers, so that wide text is not
    shuffled to learn what changed and every row is aggregated by hash.

    ``strategy="union"`` groups both sides in one exchange, after a partial
    aggregation that folds a repeated key where it is read. ``"join"`` groups
    each side and joins them: no exchange at all when both sides are tables
    bucketed by the keys, two otherwise.
    """
    compare = _compared(current, desired, keys, compare)
    targets = None if targets is None else list(targets)
    schema = desired.schema
    if duplicates == "last" and not order_by:
        raise ValueError("duplicates='last' needs order_by")
    if duplicates not in ("error", "last"):
        raise ValueError(f"duplicates={duplicates!r}: 'error' or 'last'")
    tidy = _normalizer(normalize)

    # What a side carries to its group: with values of fixed width only, each as a
    # column of its own, which Spark aggregates by hash; else one struct, which it
    # sorts, led by the order where rows may repeat so that the last row is the greatest.
    rows = duplicates == "last" or (details and not all(isinstance(schema[c].dataType, FIXED_WIDTH) for c in compare))
    cells: list[tuple[str, Column]] = []  # each compared column, or what stands for it
    for c in compare:
        kind, column = schema[c].dataType, F.col(quoted(c))
        if isinstance(kind, T.StringType):
            column = tidy(column)
        column = canonical(column, kind)
        if details or isinstance(kind, FIXED_WIDTH):
            cells.append((c, column))
        else:
            cells += [(c, part) for part in digest(as_binary(column, kind))]
    if rows:
        rank = [F.struct(*order_by).alias("rank")] if duplicates == "last" else []
        row = F.struct(*[cell.alias(f"c{n}") for n, (_, cell) in enumerate(cells)])
        carried, names = [F.struct(*rank, row.alias("row")).alias("__v")], ["__v"]
    else:
        carried = [cell.alias(f"__v{n}") for n, (_, cell) in enumerate(cells)]
        names = [f"__v{n}" for n in range(len(cells))]

    def side(df: DataFrame) -> DataFrame:
        return scoped(df, keys, targets, where).select(*keys, *carried)

    if strategy == "union":
        is_old = F.col("__old")
        both = side(current).withColumn("__old", F.lit(True)).unionByName(side(desired).withColumn("__old", F.lit(False)))
        matched = both.groupBy(*keys).agg(
            F.count_if(is_old).alias("__n_old"),
            F.count_if(~is_old).alias("__n_new"),
            *[F.max(F.when(is_old, F.col(v))).alias(f"{v}_old") for v in names],
            *[F.max(F.when(~is_old, F.col(v))).alias(f"{v}_new") for v in names],
        )
    elif strategy == "join":
        sides = [
            side(df).groupBy(*keys).agg(F.count("*").alias(f"__n_{w}"), *[F.max(v).alias(f"{v}_{w}") for v in names])
            for df, w in ((current, "old"), (desired, "new"))
        ]
        matched = sides[0].join(sides[1], keys, "full_outer").na.fill(0, ["__n_old", "__n_new"])
    else:
        raise ValueError(f"strategy={strategy!r}: 'union' or 'join'")

    def values(which: str) -> list[Column]:
        return [F.col(f"__v_{which}.row.c{n}" if rows else f"__v{n}_{which}") for n in range(len(cells))]

    pairs = list(zip([c for c, _ in cells], values("old"), values("new")))
    differs = functools.reduce(operator.or_, [~was.eqNullSafe(will) for _, was, will in pairs], F.lit(False))
    repeated = (F.col("__n_old") > 1) | (F.col("__n_new") > 1) if duplicates == "error" else F.lit(False)
    operation = _checked(
        keys,
        repeated,
        F.when(F.col("__n_old") == 0, CREATE)
        .when(F.col("__n_new") == 0, DELETE)
        .when(differs, UPDATE)
        .otherwise(NO_CHANGE),
    )
    for c, was, will in pairs:
        if c in (required or []):
            lost = ((F.col("__n_old") > 0) & was.isNull()) | ((F.col("__n_new") > 0) & will.isNull())
            matched = matched.where(~lost)
    result = matched.withColumn("operation", operation)
    if not include_unchanged:
        result = result.where(F.col("operation") != NO_CHANGE)
    if not details:
        return result.select(*keys, "operation")
    changed = [
        F.when(
            ~was.eqNullSafe(will),
            F.struct(
                F.lit(c).alias("column_name"),
                _shown(was, schema[c].dataType).alias("old_value"),
                _shown(will, schema[c].dataType).alias("new_value"),
            ),
        )
        for c, was, will in pairs
    ]
    none = F.array().cast("array<struct<column_name: string, old_value: string, new_value: string>>")
    changes = F.array_compact(F.array(*changed)) if changed else none
    return result.select(*keys, "operation", F.when(F.col("operation") == UPDATE, changes).alias("changes"))


def quoted(name: str) -> str:
    """A column by its name, whatever the name holds."""
    return "`" + name.replace("`", "``") + "`"


def canonical(value: Column, kind: T.DataType) -> Column:
    """The value with every map in it, at any depth, as its entries in order: maps themselves can't be compared."""
    if not _holds_map(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [canonical(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    entries = F.transform(
        F.map_entries(value),
        lambda e: F.struct(canonical(e["key"], kind.keyType).alias("key"), canonical(e["value"], kind.valueType).alias("value")),
    )
    return F.array_sort(entries)


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def as_binary(value: Column, kind: T.DataType) -> Column:
    """Bytes that are equal where values are: of text its own, of nested values those of their JSON."""
    if isinstance(kind, T.BinaryType):
        return value
    if isinstance(kind, T.StringType):
        return value.cast("binary")
    # Null stays null; a null inside is written, so that it differs from what is not there.
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    exact = {"ignoreNullFields": "false", "timestampFormat": micros + "XXX", "timestampNTZFormat": micros}
    whole = F.to_json(F.struct(value.alias("v")), exact).cast("binary")
    return F.when(value.isNotNull(), whole)


def digest(value: Column) -> list[Column]:
    """SHA-256 of a binary column as four longs, null if it is null."""
    name = F.sha2(value, 256)
    # 16 hexadecimal digits as a signed number (base -10).
    return [F.conv(F.substring(name, 16 * n + 1, 16), 16, -10).cast("bigint") for n in range(4)]


def unreadable(
    current: DataFrame, desired: DataFrame, keys: list[str], required: list[str], targets=None, where=None
) -> DataFrame:
    """``keys, side`` of the rows in scope that lack a required value."""
    targets = None if targets is None else list(targets)
    lacking = functools.reduce(operator.or_, [F.col(quoted(c)).isNull() for c in required])

    def side(df: DataFrame, name: str) -> DataFrame:
        return scoped(df.where(lacking), keys, targets, where).select(*keys, F.lit(name).alias("side"))

    return side(current, "current").unionByName(side(desired, "desired"))


def creates(current: DataFrame, desired: DataFrame, keys: list[str], targets=None, where=None) -> DataFrame:
    """Keys on the desired side only, by an anti join on keys alone."""
    return _one_sided(desired, current, keys, CREATE, targets, where)


def deletes(current: DataFrame, desired: DataFrame, keys: list[str], targets=None, where=None) -> DataFrame:
    """Keys on the current side only, by an anti join on keys alone."""
    return _one_sided(current, desired, keys, DELETE, targets, where)


def _one_sided(df: DataFrame, other: DataFrame, keys: list[str], operation: str, targets, where) -> DataFrame:
    # Both sides are folded to one row per key where they are read, and the
    # join uses the partitioning of the two aggregations.
    counted = scoped(df, keys, targets, where).groupBy(*keys).agg(F.count("*").alias("__n"))
    present = scoped(other, keys, targets, where).select(*keys).distinct()
    kept = counted.join(present, keys, "left_anti")
    return kept.select(*keys, _checked(keys, F.col("__n") > 1, F.lit(operation)).alias("operation"))


def updates(current: DataFrame, desired: DataFrame, keys: list[str], **options) -> DataFrame:
    """Keys on both sides whose values differ, with their changes."""
    return plan(current, desired, keys, **options).where(F.col("operation") == UPDATE)


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n`` of the keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def last_rows(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """One row per key, the last in ``order_by``, ties settled by the other columns."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(F.struct(*order_by).alias("rank"), F.struct(*rest).alias("row"))
    return df.groupBy(*keys).agg(F.max(row)["row"].alias("row")).select(*keys, "row.*")


def _checked(keys: list[str], repeated: Column, operation: Column) -> Column:
    missing = functools.reduce(operator.or_, [F.col(k).isNull() for k in keys])
    named = F.concat_ws(".", *[F.col(k).cast("string") for k in keys])
    return (
        F.when(missing, F.raise_error(F.concat(F.lit("null in key: "), named)).cast("string"))
        .when(repeated, F.raise_error(F.concat(F.lit("key occurs more than once: "), named)).cast("string"))
        .otherwise(operation)
    )


def _compared(current: DataFrame, desired: DataFrame, keys: list[str], compare: list[str] | None) -> list[str]:
    if compare is not None:
        return list(compare)
    names = [c for c in desired.columns if c not in keys]
    if set(names) != set(current.columns) - set(keys):
        raise ValueError("the two sides differ in columns; name the ones to compare")
    return names


def _normalizer(normalize: str | Normalize | None) -> Normalize:
    if normalize is None:
        return lambda column: column
    if normalize == "trailing":
        return text.normalize
    if callable(normalize):
        return normalize
    raise ValueError(f"normalize={normalize!r}: 'trailing', a function or None")


def _shown(value: Column, kind: T.DataType) -> Column:
    return F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")
