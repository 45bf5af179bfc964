"""Plans of table definitions: one DDL text per part, in two versions.

The SQL beside a query never reads a text back: it states the columns and
properties from the values that the text was built of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalogue import query, table, work_folder
from reconcile import definitions, drift, plan_definitions, results

KEYS = ["database_name", "table_name"]
DB = "lower(replace(p_brand, '#', '_'))"
OLD_NAME = "'t' || CAST(p_partkey AS string)"
# Small STANDARD parts are renamed: their old definition goes, a new one comes.
RENAMED = "p_type = 'STANDARD' AND p_size <= 10"
NEW_NAME = f"CASE WHEN {RENAMED} THEN 'n' ELSE 't' END || CAST(p_partkey AS string)"


def big(kind: str) -> str:
    """The parts whose definition changes, by type in another way."""
    return f"p_type = '{kind}' AND p_size > 10"


OLD_LOCATION = f"'s3://bucket/' || {DB} || '/' || CAST(p_partkey AS string) || '/'"
NEW_LOCATION = f"CASE WHEN {big('STANDARD')} THEN 's3://archive/' || p_name ELSE {OLD_LOCATION} END"
OLD_COMMENT = "'size, (' || p_name || ')'"
NEW_COMMENT = f"CASE WHEN {big('SMALL')} THEN p_brand ELSE {OLD_COMMENT} END"
SIZE = "'size_' || CAST(p_size AS string)"
PARTITIONS = "dt string COMMENT ''day (1-31)'', region decimal(10,2)"

# {fields} in braces stand for the expressions of the dictionaries below.
TEXT = """CREATE EXTERNAL TABLE `{db}`.`t` (
  `ID` {id_type},{blanks}
  {size} Decimal(10,2) COMMENT '{comment}',
  tags map<string,array<struct<k:string,v:int>>>,{optional}
  name string)
{partitioned}STORED AS {format}{blanks}
LOCATION '{location}'
TBLPROPERTIES ('a,b'='{brand}', 'kind' = '{kind}'){end}"""
OLD = dict(
    db=DB, id_type="'int'", blanks="''", size=SIZE, comment=OLD_COMMENT, format="'PARQUET'", location=OLD_LOCATION,
    optional=f"CASE WHEN {big('PROMO')} THEN chr(10) || '  location string,' ELSE '' END",
    partitioned=f"'PARTITIONED BY ( {PARTITIONS} )' || chr(10)", brand="p_brand", kind="p_type", end="''",
)
NEW = OLD | dict(
    id_type=f"CASE WHEN {big('ECONOMY')} THEN 'bigint' ELSE 'int' END", blanks="'  ' || chr(9)", comment=NEW_COMMENT,
    format=f"CASE WHEN {big('MEDIUM')} THEN 'orc' ELSE 'PARQUET' END", location=NEW_LOCATION,
    optional=f"CASE WHEN {big('LARGE')} THEN chr(10) || '  extra array<string>,' ELSE '' END",
    partitioned=f"CASE WHEN {big('ECONOMY')} THEN '' ELSE 'PARTITIONED BY ( {PARTITIONS} )' || chr(10) END",
    kind=f"CASE WHEN {big('LARGE')} THEN 'huge' ELSE p_type END", end="chr(10) || chr(10)",
)


def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")

    def texts(fields: dict[str, str], name: str) -> DataFrame:
        content, rest = [], TEXT
        while "{" in rest:
            literal, rest = rest.split("{", 1)
            field, rest = rest.split("}", 1)
            content += [F.lit(literal), F.expr(fields[field])]
        return part.select(
            F.expr(f"{DB} AS database_name"), F.expr(f"{name} AS table_name"), F.concat(*content, F.lit(rest)).alias("content")
        )

    return texts(OLD, OLD_NAME), texts(NEW, NEW_NAME)


def _plan(spark, sf_dir, **options) -> DataFrame:
    return plan_definitions(*_snapshots(spark, sf_dir), **options)


def _named(select: str, where: str = "true", name: str = OLD_NAME) -> str:
    return f"SELECT {DB} AS database_name, {name} AS table_name, {select} FROM part WHERE {where}"


def _union(*selects: str) -> str:
    return " UNION ALL ".join(selects)


CHANGED = "p_size > 10"  # every type changes then, each in its way
OPERATIONS = _union(
    _named("'Create' AS operation", RENAMED, NEW_NAME),
    _named("'Delete' AS operation", RENAMED),
    _named("'Update' AS operation", CHANGED),
)


def _column(ordinal: str, name: str, data_type: str, comment: str = "NULL", where: str = "true") -> str:
    return _named(
        f"CAST({ordinal} AS int) AS ordinal, {name} AS name, {data_type} AS data_type, CAST({comment} AS string) AS comment", where
    )


@query(_union(
    _column("1", "'id'", "'int'"),
    _column("2", SIZE, "'decimal(10,2)'", OLD_COMMENT),
    _column("3", "'tags'", "'map<string,array<struct<k:string,v:int>>>'"),
    _column("4", "'location'", "'string'", where=big("PROMO")),
    _column(f"CASE WHEN {big('PROMO')} THEN 5 ELSE 4 END", "'name'", "'string'"),
))
def ddl_columns(spark, sf_dir):
    return definitions.columns(_snapshots(spark, sf_dir)[0], KEYS)


@query(_named(f"""{NEW_LOCATION} AS location, CASE WHEN {big('MEDIUM')} THEN 'ORC' ELSE 'PARQUET' END AS format,
  CASE WHEN NOT ({big('ECONOMY')}) THEN '{PARTITIONS}' END AS partitions, p_brand AS brand,
  CASE WHEN {big('LARGE')} THEN 'huge' ELSE p_type END AS kind""", name=NEW_NAME))
def ddl_properties(spark, sf_dir):
    properties = definitions.properties(_snapshots(spark, sf_dir)[1], KEYS)
    entry = F.col("table_properties")
    return properties.select(*KEYS, "location", "format", "partitions", entry["a,b"].alias("brand"), entry["kind"].alias("kind"))


@query(_named(f"""CAST(CASE WHEN {big('PROMO')} THEN 5 ELSE 4 END AS int) AS n_columns, 'dt,region' AS partitions,
  'day (1-31)' AS partition_comment, {OLD_LOCATION} AS location, 'none' AS input_format, p_type AS kind"""))
def ddl_table_definitions(spark, sf_dir):
    rows = definitions.table_definitions(_snapshots(spark, sf_dir)[0], KEYS)
    return rows.select(
        *KEYS, F.size("columns").alias("n_columns"),
        F.array_join(F.transform("partitions", lambda p: p["name"]), ",").alias("partitions"),
        F.col("partitions")[0]["comment"].alias("partition_comment"), "storage_descriptor.location",
        F.coalesce("storage_descriptor.input_format", F.lit("none")).alias("input_format"), F.col("table_properties")["kind"].alias("kind"),
    )


@query(OPERATIONS)
def ddl_plan(spark, sf_dir):
    return _plan(spark, sf_dir).select(*KEYS, "operation")


@query(OPERATIONS)
def ddl_plan_staged(spark, sf_dir):
    """By digests, with the texts of updated definitions fetched afterwards."""
    planned = _plan(spark, sf_dir, staging=work_folder(spark))
    # An update that came without its diff would show here.
    complete = (F.col("operation") != "Update") | F.col("text_diff").startswith("--- remote: ")
    return planned.where(complete).select(*KEYS, "operation")


def _line(old: str, new: str | None = None, when: str = "false") -> str:
    """A line of both texts, or what becomes of it where the condition holds: replaced, or dropped if there is no new one."""
    changed = f"['-' || {old}" + ("" if new is None else f", '+' || {new}") + "]"
    return f"CASE WHEN {when} THEN {changed} ELSE [' ' || {old}] END"


# The lines of the older definition, each with what the newer one makes of it.
QUOTE = "chr(39)"
MARKED = " || ".join([
    _line(f"'CREATE EXTERNAL TABLE `' || {DB} || '`.`t` ('"),
    _line("'  `ID` int,'", "'  `ID` bigint,'", big("ECONOMY")),
    _line(*[f"'  ' || {SIZE} || ' Decimal(10,2) COMMENT ' || {QUOTE} || {c} || {QUOTE} || ','" for c in (OLD_COMMENT, "p_brand")], big("SMALL")),
    _line("'  tags map<string,array<struct<k:string,v:int>>>,'"),
    f"CASE WHEN {big('PROMO')} THEN ['-  location string,'] WHEN {big('LARGE')} THEN ['+  extra array<string>,'] ELSE [] END",
    _line("'  name string)'"),
    _line(f"'PARTITIONED BY ( {PARTITIONS} )'", None, big("ECONOMY")),
    _line("'STORED AS PARQUET'", "'STORED AS orc'", big("MEDIUM")),
    _line(*[f"'LOCATION ' || {QUOTE} || {place} || {QUOTE}" for place in (OLD_LOCATION, "'s3://archive/' || p_name")], big("STANDARD")),
    _line(*[f"replace('TBLPROPERTIES (\"a,b\"=\"' || p_brand || '\", \"kind\" = \"' || {kind} || '\")', '\"', {QUOTE})" for kind in ("p_type", "'huge'")], big("LARGE")),
])


@query(f"""SELECT database_name, table_name, '--- remote: ' || name || chr(10) || '+++ local:  ' || name || chr(10) || array_to_string(shown, chr(10)) || chr(10) AS text_diff
FROM (SELECT *, database_name || '.' || table_name AS name,
  list_filter(marked, lambda m, i: len(list_filter(marked[greatest(i - 3, 1):i + 3], lambda x: x[1] <> ' ')) > 0) AS shown
  FROM ({_named(f"{MARKED} AS marked", CHANGED)}))""")
def ddl_line_diff(spark, sf_dir):
    """The whole text of each diff: headers, marks, order and three lines of context."""
    return _plan(spark, sf_dir).where("operation = 'Update'").select(*KEYS, "text_diff")


COLUMN_CHANGES = [
    _named("'TypeChanged' AS change_type, 'id' AS column_name, 'int' AS old_type, 'bigint' AS new_type", big("ECONOMY")),
    _named("'Removed' AS change_type, 'location' AS column_name, 'string' AS old_type, NULL AS new_type", big("PROMO")),
    _named("'Added' AS change_type, 'extra' AS column_name, NULL AS old_type, 'array<string>' AS new_type", big("LARGE")),
]
COMMENT_CHANGES = _named(
    f"'CommentChanged' AS change_type, {SIZE} AS column_name, 'decimal(10,2)' AS old_type, 'decimal(10,2)' AS new_type", big("SMALL")
)


@query(_union(*COLUMN_CHANGES))
def ddl_column_changes(spark, sf_dir):
    return drift.column_changes_of(_plan(spark, sf_dir), KEYS)


@query(_union(*COLUMN_CHANGES, COMMENT_CHANGES))
def ddl_column_changes_with_comments(spark, sf_dir):
    return drift.column_changes_of(_plan(spark, sf_dir, comments=True), KEYS)




def _whole_table(name: str, kind: str) -> list[str]:
    columns = {"'id'": "'int'", SIZE: "'decimal(10,2)'", "'tags'": "'map<string,array<struct<k:string,v:int>>>'", "'name'": "'string'"}
    old, new = ("NULL", "{0}") if kind == "Added" else ("{0}", "NULL")
    return [
        _named(f"'{kind}' AS change_type, {c} AS column_name, {old.format(t)} AS old_type, {new.format(t)} AS new_type", RENAMED, name)
        for c, t in columns.items()
    ]


@query(_union(*COLUMN_CHANGES, COMMENT_CHANGES, *_whole_table(NEW_NAME, "Added"), *_whole_table(OLD_NAME, "Removed")))
def ddl_column_tables_diff(spark, sf_dir):
    """All tables' columns as two tables of columns, created and dropped tables included."""
    old, new = (definitions.columns(df, KEYS) for df in _snapshots(spark, sf_dir))
    return drift.column_changes(old, new, KEYS, comments=True)


PROPERTY_CHANGES = [
    _named(f"'location' AS property_name, {OLD_LOCATION} AS old_value, 's3://archive/' || p_name AS new_value", big("STANDARD")),
    _named("'format' AS property_name, 'PARQUET' AS old_value, 'ORC' AS new_value", big("MEDIUM")),
    _named(f"'partitions' AS property_name, '{PARTITIONS}' AS old_value, NULL AS new_value", big("ECONOMY")),
]


@query(_union(*PROPERTY_CHANGES))
def ddl_property_changes(spark, sf_dir):
    return drift.property_changes_of(_plan(spark, sf_dir), KEYS)


@query(_union(*PROPERTY_CHANGES, _named("'kind' AS property_name, 'LARGE' AS old_value, 'huge' AS new_value", big("LARGE"))))
def ddl_table_property_changes(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    pairs = old.withColumnRenamed("content", "old").join(new.withColumnRenamed("content", "new"), KEYS)
    return drift.property_changes(pairs, KEYS, "old", "new", table_properties=True)


@query(_union(
    _named("'Create' AS operation, CAST(-1 AS int) AS n_columns, CAST(-1 AS int) AS n_properties", RENAMED, NEW_NAME),
    _named("'Delete' AS operation, CAST(-1 AS int) AS n_columns, CAST(-1 AS int) AS n_properties", RENAMED),
    _named("""'Update' AS operation, CAST(CASE WHEN p_type IN ('ECONOMY', 'PROMO', 'LARGE') THEN 1 ELSE 0 END AS int) AS n_columns,
      CAST(CASE WHEN p_type IN ('STANDARD', 'MEDIUM', 'ECONOMY') THEN 1 ELSE 0 END AS int) AS n_properties""", CHANGED),
))
def ddl_plan_details(spark, sf_dir):
    """The whole document, written as JSON and read back."""
    planned = _plan(spark, sf_dir)
    back = results.from_json(results.to_json_rows(planned), planned.schema)
    details = F.col("change_details")

    def count(changes: str):  # -1 where there are no details
        return F.when(details.isNull(), -1).otherwise(F.size(details[changes]))

    return back.select(
        *KEYS, "operation", count("column_changes").alias("n_columns"), count("property_changes").alias("n_properties")
    )
