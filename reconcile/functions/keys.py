"""Keys: identifiers, qualified names and the path <-> key mapping."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What an identifier may hold, and the layout <database>/<table>.sql.
IDENTIFIER = r"\A[\p{IsAlphabetic}\p{N}_-]+\z"
DEFINITION_PATH = r"(?s)([^/]+)/([^/]+)\.sql\z"


def is_identifier(name: Column) -> Column:
    """Non-empty and made of letters, digits, ``_`` and ``-`` of any script."""
    return F.coalesce(name.rlike(IDENTIFIER), F.lit(False))


def path_names(path: Column) -> Column:
    """``struct<database_name, table_name>`` as spelled in the path, unchecked."""
    database = F.regexp_extract(path, DEFINITION_PATH, 1)
    table = F.regexp_extract(path, DEFINITION_PATH, 2)
    return F.struct(database.alias("database_name"), table.alias("table_name"))


def key_from_path(path: Column) -> Column:
    """Parent directory and file stem as ``struct<database_name, table_name>``.

    Null when the path has no parent directory, is not a ``.sql`` file or one
    of the two names is not an identifier.
    """
    names = path_names(path)
    return F.when(is_identifier(names["database_name"]) & is_identifier(names["table_name"]), names)


def definition_path(base: str, database: Column, table: Column) -> Column:
    """``<base>/<database>/<table>.sql``; null if a name is not an identifier."""
    path = F.concat(F.lit(base.rstrip("/") + "/"), database, F.lit("/"), table, F.lit(".sql"))
    return F.when(is_identifier(database) & is_identifier(table), path)


def split_key(key: Column) -> Column:
    """``"database.table"`` as a struct; null unless there are exactly two parts."""
    parts = F.split(key, r"\.", -1)
    names = F.struct(parts[0].alias("database_name"), parts[1].alias("table_name"))
    # The guard sits around the array access: under ANSI mode parts[1] of a
    # one-element array is an error, not a null.
    return F.when(F.size(parts) == 2, names)


def qualified_name(*names: Column | str) -> Column:
    """The names joined by a dot, for display only (keys stay separate columns)."""
    return F.concat_ws(".", *[F.col(n) if isinstance(n, str) else n for n in names])
