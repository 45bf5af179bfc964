"""Plans of data tables: two snapshots of orders, customer and lineitem.

Both snapshots hold every row of their table. In the desired one some rows have
another key, so that the old key is deleted and the new one created, and some
have other values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from catalogue import query, table, work_folder
from reconcile import apply, drift, export, plan, results
from reconcile.sources import create_buckets, read_buckets, read_by_day, read_version, write_bucketed, write_by_day
from reconcile.sources.layouts import DAY

NEW_KEY = "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN -1 - o_orderkey ELSE o_orderkey END"
NEW_STATUS = "CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END"

CUR = "cur AS (SELECT o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS pr FROM orders)"
DES = f"des AS (SELECT {NEW_KEY} AS k, {NEW_STATUS} AS st, o_orderpriority AS pr FROM orders)"
MATCHED = """planned AS (
  SELECT coalesce(cur.k, des.k) AS k, coalesce(cur.pr, des.pr) AS pr, cur.st AS old_st, des.st AS new_st,
    CASE WHEN cur.k IS NULL THEN 'Create' WHEN des.k IS NULL THEN 'Delete'
         WHEN cur.st IS DISTINCT FROM des.st OR cur.pr IS DISTINCT FROM des.pr THEN 'Update'
         ELSE 'NoChange' END AS operation
  FROM cur FULL OUTER JOIN des ON cur.k = des.k)"""
PLANNED = f"WITH {CUR}, {DES}, {MATCHED}"


def _orders(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    current = orders.selectExpr("o_orderkey AS k", "o_orderstatus AS st", "o_orderpriority AS pr")
    desired = orders.selectExpr(f"{NEW_KEY} AS k", f"{NEW_STATUS} AS st", "o_orderpriority AS pr")
    return current, desired


def _changed_columns(planned: DataFrame, *keys: str) -> DataFrame:
    names = F.array_join(F.transform("changes", lambda c: c["column_name"]), ",")
    return planned.select(*keys, "operation", names.alias("changed"))


CHANGED = "CASE WHEN operation = 'Update' THEN 'st' END AS changed"


@query(f"{PLANNED} SELECT k, operation, {CHANGED} FROM planned")
def plan_orders(spark, sf_dir):
    return _changed_columns(plan.plan(*_orders(spark, sf_dir), ["k"], include_unchanged=True), "k")


@query(f"{PLANNED} SELECT k, operation, {CHANGED} FROM planned WHERE operation <> 'NoChange'")
def plan_orders_changes(spark, sf_dir):
    return _changed_columns(plan.plan(*_orders(spark, sf_dir), ["k"]), "k")


@query(f"{PLANNED} SELECT k, operation, {CHANGED} FROM planned WHERE operation <> 'NoChange'")
def plan_orders_by_join(spark, sf_dir):
    return _changed_columns(plan.plan(*_orders(spark, sf_dir), ["k"], strategy="join"), "k")


@query(f"{PLANNED} SELECT k, operation FROM planned WHERE operation <> 'NoChange'")
def plan_orders_by_digest(spark, sf_dir):
    return plan.plan(*_orders(spark, sf_dir), ["k"], details=False)


@query(f"{PLANNED} SELECT k, operation, {CHANGED} FROM planned")
def plan_orders_bucketed(spark, sf_dir):
    """Both sides as tables bucketed by the key: no exchange at all."""
    tables = [
        write_bucketed(df, f"snapshot_{uuid.uuid4().hex}", f"{work_folder(spark)}/{side}", ["k"], 8)
        for side, df in zip(("current", "desired"), _orders(spark, sf_dir))
    ]
    return _changed_columns(plan.plan(*tables, ["k"], include_unchanged=True, strategy="join"), "k")


# Files from before a column was added: what they hold of it is null.
OLDER = "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"


@query(f"""WITH {CUR.replace("o_orderpriority AS pr", f"CASE WHEN {OLDER} THEN NULL ELSE o_orderpriority END AS pr")}, {DES}, {MATCHED}
SELECT k, operation FROM planned WHERE operation <> 'NoChange' AND k > 0""")
def plan_orc(spark, sf_dir):
    """ORC files of two schemas, the scope pushed down to them."""
    (current, desired), root = _orders(spark, sf_dir), work_folder(spark)
    older = "st = 'F' AND pr = '1-URGENT'"
    current.where(older).drop("pr").write.orc(f"{root}/older")
    current.where(f"NOT ({older})").write.orc(f"{root}/newer")
    desired.write.orc(f"{root}/desired")
    read = [spark.read.schema(desired.schema).orc([f"{root}/{p}" for p in parts]) for parts in (("older", "newer"), ("desired",))]
    return plan.plan(*read, ["k"], where=lambda k: k > 0, details=False)


@query(f"""{PLANNED}, s AS (SELECT count(*) FILTER (operation = 'Create') AS to_add,
  count(*) FILTER (operation = 'Update') AS to_change, count(*) FILTER (operation = 'Delete') AS to_destroy FROM planned)
SELECT *, to_add + to_change + to_destroy = 0 AS no_change, to_add + to_change + to_destroy > 0 AS has_changes,
  to_add + to_change + to_destroy AS total_changes FROM s""")
def plan_summary(spark, sf_dir):
    return results.summarize(plan.plan(*_orders(spark, sf_dir), ["k"], details=False))


@query("""SELECT count(*) AS to_add, CAST(0 AS bigint) AS to_change, CAST(0 AS bigint) AS to_destroy, false AS no_change,
  true AS has_changes, count(*) AS total_changes FROM customer""")
def plan_summary_all_new(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return results.summarize(plan.plan(customer.where("false"), customer, ["c_custkey"], details=False))


@query(f"WITH {CUR}, {DES} SELECT k, 'Create' AS operation FROM des WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.k = des.k)")
def plan_creates(spark, sf_dir):
    return plan.creates(*_orders(spark, sf_dir), ["k"])


@query(f"WITH {CUR}, {DES} SELECT k, 'Delete' AS operation FROM cur WHERE NOT EXISTS (SELECT 1 FROM des WHERE cur.k = des.k)")
def plan_deletes(spark, sf_dir):
    return plan.deletes(*_orders(spark, sf_dir), ["k"])


@query(f"""WITH {CUR}, {DES} SELECT cur.k AS k, 'Update' AS operation, 'st' AS changed FROM cur JOIN des ON cur.k = des.k
WHERE cur.st IS DISTINCT FROM des.st""")
def plan_updates(spark, sf_dir):
    return _changed_columns(plan.updates(*_orders(spark, sf_dir), ["k"]), "k")


SCOPED = f"WITH {CUR.replace('FROM orders', 'FROM orders WHERE {0}')}, {DES.replace('FROM orders', 'FROM orders WHERE {0}')}, {MATCHED}"
URGENT = SCOPED.replace("{0}", "starts_with(o_orderpriority, '1-') OR o_orderpriority = '5-LOW'")


@query(f"{URGENT} SELECT pr, CAST(k AS string) AS k, operation FROM planned WHERE operation <> 'NoChange'")
def plan_scoped(spark, sf_dir):
    current, desired = (df.withColumn("k", F.col("k").cast("string")) for df in _orders(spark, sf_dir))
    planned = plan.plan(current, desired, ["pr", "k"], targets=["1-*.*", "5-LOW.*", "malformed"])
    return planned.select("pr", "k", "operation")


@query(f"""{SCOPED.replace('{0}', "o_orderpriority <> '3-MEDIUM'")} SELECT pr, k, operation FROM planned WHERE operation <> 'NoChange'""")
def plan_where(spark, sf_dir):
    planned = plan.plan(*_orders(spark, sf_dir), ["pr", "k"], where=lambda pr, k: pr != "3-MEDIUM")
    return planned.select("pr", "k", "operation")


# Customers: several columns change, one of them to and from null.
OLD_CUSTOMER = [
    "c_custkey AS k", "c_name AS name", "CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS nation",
    "CAST(c_acctbal AS decimal(12,2)) AS balance", "c_mktsegment AS segment",
]
NEW_CUSTOMER = [
    "c_custkey AS k", "CASE WHEN c_acctbal > 9000 THEN upper(c_name) ELSE c_name END AS name",
    "CASE WHEN c_nationkey = 7 THEN NULL ELSE c_nationkey END AS nation",
    "CAST(CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS decimal(12,2)) AS balance",
    "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'MACHINES' ELSE c_mktsegment END AS segment",
]
CELLS = " UNION ALL ".join(
    f"SELECT a.k AS k, '{c}' AS column_name, CAST(a.{c} AS string) AS old_value, CAST(b.{c} AS string) AS new_value"
    f" FROM a JOIN b ON a.k = b.k WHERE a.{c} IS DISTINCT FROM b.{c}"
    for c in ("name", "nation", "balance", "segment")
)


@query(f"WITH a AS (SELECT {', '.join(OLD_CUSTOMER)} FROM customer), b AS (SELECT {', '.join(NEW_CUSTOMER)} FROM customer) {CELLS}")
def plan_cell_changes(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    planned = plan.plan(customer.selectExpr(*OLD_CUSTOMER), customer.selectExpr(*NEW_CUSTOMER), ["k"])
    return drift.cell_changes(planned, ["k"])


# Events: a column of nested values, with maps whose entries come in another order, and with a dot in its name.
LOUD = "event_type = 'click' AND value < 20"
NESTED_NAME = "what.happened"


def _events(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")

    def nested(*entries: str) -> DataFrame:
        value = f"array(named_struct('m', map({', '.join(entries)}), 'v', value), named_struct('m', cast(null AS map<string, string>), 'v', value))"
        return events.select("event_id", F.expr(value).alias(NESTED_NAME))

    return nested("'type'", "event_type", "'props'", "props"), nested("'props'", "props", "'type'", f"CASE WHEN {LOUD} THEN upper(event_type) ELSE event_type END")


@query(f"SELECT event_id, 'Update' AS operation, '{NESTED_NAME}' AS changed FROM events WHERE {LOUD}")
def plan_nested(spark, sf_dir):
    return _changed_columns(plan.plan(*_events(spark, sf_dir), ["event_id"]), "event_id")


@query(f"SELECT event_id, CASE WHEN {LOUD} THEN 'Update' ELSE 'NoChange' END AS operation FROM events")
def plan_nested_by_digest(spark, sf_dir):
    return plan.plan(*_events(spark, sf_dir), ["event_id"], details=False, include_unchanged=True)


# Lineitem: keys repeat.
KEYS = ["l_orderkey", "l_linenumber"]
ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return plan.repeated_keys(table(spark, sf_dir, "lineitem"), KEYS)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, qty, l_returnflag FROM (
  SELECT *, CAST(l_quantity AS bigint) AS qty, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_returnflag DESC) AS r FROM lineitem) WHERE r = 1""")
def last_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr(*KEYS, *ORDER, "CAST(l_quantity AS bigint) AS qty", "l_returnflag")
    return plan.last_rows(rows, KEYS, ORDER).drop("l_shipdate")


LAST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, qty DESC, flag DESC) AS r FROM (
  SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, {0} AS qty, l_returnflag AS flag FROM lineitem)) WHERE r = 1)"""
NEW_QTY = "CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity + 1 ELSE l_quantity END AS bigint)"


@query(f"""SELECT a.l_orderkey AS l_orderkey, a.l_linenumber AS l_linenumber, 'Update' AS operation,
  CAST(a.qty AS string) AS old_value, CAST(b.qty AS string) AS new_value
FROM {LAST.format("CAST(l_quantity AS bigint)")} a JOIN {LAST.format(NEW_QTY)} b
  ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.qty <> b.qty""")
def plan_last_wins(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    rest = [*KEYS, *ORDER, "l_returnflag AS flag"]
    current = lineitem.selectExpr(*rest, "CAST(l_quantity AS bigint) AS qty")
    desired = lineitem.selectExpr(*rest, f"{NEW_QTY} AS qty")
    planned = plan.plan(current, desired, KEYS, ["qty", "flag"], duplicates="last", order_by=ORDER)
    change = planned["changes"][0]
    return planned.select(*KEYS, "operation", change["old_value"].alias("old_value"), change["new_value"].alias("new_value"))


# Reading a plan.
NAMED = f"""WITH {CUR}, {DES}, planned AS (
  SELECT coalesce(cur.pr, des.pr) AS database_name, CAST(coalesce(cur.k, des.k) AS string) AS table_name,
    CASE WHEN cur.k IS NULL THEN 'Create' WHEN des.k IS NULL THEN 'Delete'
         WHEN cur.st IS DISTINCT FROM des.st THEN 'Update' ELSE 'NoChange' END AS operation
  FROM cur FULL OUTER JOIN des ON cur.k = des.k AND cur.pr = des.pr), changed AS (SELECT * FROM planned WHERE operation <> 'NoChange')"""
NAMES = ["database_name", "table_name"]


def _named_plan(spark, sf_dir, **options) -> DataFrame:
    named = (df.selectExpr("pr AS database_name", "CAST(k AS string) AS table_name", "st") for df in _orders(spark, sf_dir))
    return plan.plan(*named, NAMES, **options)


@query(f"{NAMED} SELECT DISTINCT database_name FROM changed WHERE operation = 'Create' ORDER BY database_name")
def containers_to_create(spark, sf_dir):
    return results.containers_to_create(_named_plan(spark, sf_dir, details=False))


@query(f"{NAMED} SELECT database_name || '.' || table_name AS name FROM changed WHERE operation = 'Create'")
def plan_names_to_create(spark, sf_dir):
    planned = _named_plan(spark, sf_dir, details=False).where("operation = 'Create'")
    return results.changed_names(planned, NAMES).select("name")


@query(f"{NAMED} SELECT operation, database_name || '.' || table_name AS name FROM changed")
def plan_changed_names(spark, sf_dir):
    return results.changed_names(_named_plan(spark, sf_dir, details=False, include_unchanged=True), NAMES)


@query(f"""{NAMED} SELECT operation, CASE operation WHEN 'Create' THEN 'create' WHEN 'Update' THEN 'update'
  WHEN 'Delete' THEN 'delete' ELSE 'no change' END AS shown, operation <> 'NoChange' AS is_change, count(*) AS n
FROM planned GROUP BY ALL""")
def plan_operations(spark, sf_dir):
    planned = _named_plan(spark, sf_dir, details=False, include_unchanged=True)
    operation = F.col("operation")
    return planned.groupBy(
        operation, results.display_name(operation).alias("shown"), results.is_change(operation).alias("is_change")
    ).agg(F.count("*").alias("n"))


@query(f"""{NAMED}, s AS (SELECT 'Plan: ' || count(*) FILTER (operation = 'Create') || ' to add, ' ||
    count(*) FILTER (operation = 'Update') || ' to change, ' || count(*) FILTER (operation = 'Delete') || ' to remove.' AS message FROM changed)
SELECT 0 AS section, 0 AS rank, '' AS name, '' AS marker, message, '' AS text_diff FROM s
UNION ALL SELECT DISTINCT 1, 0, database_name, '+', 'new container, made unless it is there', '' FROM changed WHERE operation = 'Create'
UNION ALL SELECT 2, CASE operation WHEN 'Create' THEN 0 WHEN 'Delete' THEN 1 ELSE 2 END, database_name || '.' || table_name,
  CASE operation WHEN 'Create' THEN '+' WHEN 'Delete' THEN '-' ELSE '~' END,
  CASE operation WHEN 'Create' THEN 'is new and will be added' WHEN 'Delete' THEN 'is not wanted and will be removed' ELSE 'differs and will be changed' END, '' FROM changed
ORDER BY 1, 2, 3""")
def plan_report(spark, sf_dir):
    return results.report(_named_plan(spark, sf_dir, details=False), NAMES).na.fill("")


JSON_ROW = """to_json(struct_pack(database_name := database_name, table_name := table_name, operation := operation, changes :=
  CASE WHEN operation = 'Update' THEN [struct_pack(column_name := 'st', old_value := 'P', new_value := 'X')] END))"""


@query(f"{NAMED} SELECT CAST({JSON_ROW} AS string) AS json FROM planned")
def plan_json_rows(spark, sf_dir):
    return results.to_json_rows(_named_plan(spark, sf_dir, include_unchanged=True))


@query(f"""{NAMED} SELECT database_name, table_name, operation, CASE WHEN operation = 'Update' THEN 'X' END AS new_value FROM planned""")
def plan_from_json(spark, sf_dir):
    planned = _named_plan(spark, sf_dir, include_unchanged=True)
    back = results.from_json(results.to_json_rows(planned), planned.schema)
    return back.select(*NAMES, "operation", F.get("changes", F.lit(0))["new_value"].alias("new_value"))


@query(f"""{NAMED}, ranked AS (SELECT *, CAST({JSON_ROW} AS string) AS json, row_number() OVER (ORDER BY
    CASE operation WHEN 'Create' THEN 0 WHEN 'Delete' THEN 1 ELSE 2 END, database_name, table_name) AS r FROM changed)
SELECT '{{"no_change":false,"summary":{{"to_add":' || count(*) FILTER (operation = 'Create') || ',"to_change":' ||
  count(*) FILTER (operation = 'Update') || ',"to_destroy":' || count(*) FILTER (operation = 'Delete') || '}},"table_diffs":[' AS line FROM changed
UNION ALL SELECT CASE WHEN r = 1 THEN '' ELSE ',' END || json FROM ranked UNION ALL SELECT ']}}'""")
def plan_json_document(spark, sf_dir):
    return results.json_document_lines(_named_plan(spark, sf_dir), NAMES)


# Export and apply.
EXISTING = "o_orderdate < TIMESTAMP '1996-01-01 00:00:00'"
VALUE = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END"
STATUS = f"""SELECT o_orderkey, CASE WHEN {EXISTING} THEN 'skipped' WHEN o_orderstatus = 'P' THEN 'error' ELSE 'exported' END AS status FROM orders"""


def _export(spark, sf_dir, overwrite=False) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    snapshot = orders.selectExpr("o_orderkey", f"{VALUE} AS content")
    return export.plan_export(snapshot, orders.where(EXISTING), ["o_orderkey"], "content", overwrite)


@query(STATUS)
def export_status(spark, sf_dir):
    return _export(spark, sf_dir)


@query(f"SELECT status, count(*) AS n FROM ({STATUS}) GROUP BY status")
def export_totals(spark, sf_dir):
    return export.export_totals(_export(spark, sf_dir))


@query("SELECT CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'exported' END AS status, count(*) AS n FROM orders GROUP BY 1")
def export_totals_overwriting(spark, sf_dir):
    return export.export_totals(_export(spark, sf_dir, overwrite=True))


@query(f"SELECT o_orderkey, {VALUE} AS content FROM orders WHERE o_orderstatus <> 'P' AND NOT {EXISTING}")
def export_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    snapshot = orders.selectExpr("o_orderkey", f"{VALUE} AS content")
    return export.exported_rows(snapshot, orders.where(EXISTING), ["o_orderkey"], "content")


@query(f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'skipped' END AS status, {VALUE} AS content FROM orders")
def export_written(spark, sf_dir):
    """Exported in two parts and read back: a further run would skip what is there and report the rest."""
    orders, root = table(spark, sf_dir, "orders"), work_folder(spark)
    snapshot = orders.selectExpr("o_orderkey", f"{VALUE} AS content")
    for part in (snapshot.join(orders.where(EXISTING).select("o_orderkey"), "o_orderkey", "left_semi"), snapshot):
        export.write_export(part, root, ["o_orderkey"], "content")
    written = read_version(spark, root, schema=snapshot.schema)
    return export.plan_export(snapshot, written, ["o_orderkey"], "content").join(written, "o_orderkey", "left")


LINE, LAST = ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"]


@query(f"""SELECT {", ".join(LINE + LAST[1:])} FROM lineitem
QUALIFY row_number() OVER (PARTITION BY {", ".join(LINE)} ORDER BY {", ".join(c + " DESC" for c in LAST)}) = 1""")
def apply_last_wins(spark, sf_dir):
    """Keys repeat on the desired side, and the last row of each is put in."""
    desired = table(spark, sf_dir, "lineitem").select(*LINE, *LAST)
    current = plan.last_rows(desired.where("l_linenumber < 4").withColumn("l_quantity", F.col("l_quantity") + 1), LINE, LAST)
    planned = plan.plan(current.select(*LINE, *LAST), desired, LINE, duplicates="last", order_by=LAST)
    return apply.reconciled(current, desired, planned, LINE, order_by=LAST).select(*LINE, *LAST[1:])


@query(f"WITH {DES} SELECT * FROM des")
def apply_written(spark, sf_dir):
    """Applied to files, which a second plan then finds as they should be."""
    current, desired = _orders(spark, sf_dir)
    root = work_folder(spark)
    apply.apply_plan(current, desired, plan.plan(current, desired, ["k"]), ["k"], root, dry_run=False, approved=True)
    state = read_version(spark, f"{root}/state")
    again = apply.apply_plan(state, desired, plan.plan(state, desired, ["k"]), ["k"], root, dry_run=False)
    return state if again.path is None else state.where("false")


@query(f"WITH {DES} SELECT * FROM des")
def apply_incremental(spark, sf_dir):
    """Applied to a table in buckets, bucket by bucket; a second plan then finds nothing to do."""
    current, desired = _orders(spark, sf_dir)
    root = work_folder(spark)
    create_buckets(current, root, ["k"], buckets=16)
    apply.apply_incremental(desired, plan.plan(read_buckets(spark, root), desired, ["k"]), root, approved=True)
    state = read_buckets(spark, root)
    again = apply.apply_incremental(desired, plan.plan(state, desired, ["k"]), root)
    return state if again.version == 1 else state.where("false")


@query(f"WITH {DES} SELECT * FROM des")
def apply_orders(spark, sf_dir):
    current, desired = _orders(spark, sf_dir)
    return apply.reconciled(current, desired, plan.plan(current, desired, ["k"], details=False), ["k"])


@query(f"""WITH {CUR}, {DES} SELECT * FROM des WHERE starts_with(pr, '5-') UNION ALL SELECT * FROM cur WHERE NOT starts_with(pr, '5-')""")
def apply_orders_scoped(spark, sf_dir):
    current, desired = _orders(spark, sf_dir)
    keys = ["pr", "k"]
    return apply.reconciled(current, desired, plan.plan(current, desired, keys, targets=["5-*.*"], details=False), keys)


# What the managed tables are asked.
@query("""SELECT c_custkey, c_name, count(o_orderkey) AS total_orders, round(coalesce(sum(o_totalprice), 0), 2) AS total_spent
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name""")
def customer_summary(spark, sf_dir):
    # Orders are summed before the join: a customer with very many orders is
    # folded where they are read, and the join meets one row per customer.
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("spent")
    )
    joined = table(spark, sf_dir, "customer").join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(
        "c_custkey", "c_name", F.coalesce("n", F.lit(0)).alias("total_orders"),
        F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("total_spent"),
    )


HEALTH = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in HEALTH))
def health_counts(spark, sf_dir):
    counts = [table(spark, sf_dir, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in HEALTH]
    total = counts[0]
    for count in counts[1:]:
        total = total.unionByName(count)
    return total


@query("""SELECT event_id, user_id, event_type, '2024' AS year, '01' AS month, '15' AS day FROM events
WHERE year(ts) = 2024 AND month(ts) = 1 AND day(ts) = 15""")
def partition_read(spark, sf_dir):
    # On a table with partition directories year/month/day the three equalities
    # prune directories; here one day is a range of ts, which prunes row groups.
    events = table(spark, sf_dir, "events").where("ts >= TIMESTAMP '2024-01-15 00:00:00' AND ts < TIMESTAMP '2024-01-16 00:00:00'")
    day = F.col("ts")
    return events.select(
        "event_id", "user_id", "event_type", F.date_format(day, "yyyy").alias("year"),
        F.date_format(day, "MM").alias("month"), F.date_format(day, "dd").alias("day"),
    )


LOUD_DAYS = "event_type = 'purchase' AND value > 99"


@query(f"""WITH e AS (SELECT event_id, user_id, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, strftime(ts, '%d') AS day, event_type, value FROM events)
SELECT event_id, user_id, year, month, day FROM e
WHERE (year, month, day) IN (SELECT (year, month, day) FROM e WHERE {LOUD_DAYS}) AND year = '2024'""")
def partition_read_joined(spark, sf_dir):
    """All events of the days that a small table names: only the directories of those days are read."""
    events, path = table(spark, sf_dir, "events").drop("props"), f"{work_folder(spark)}/events"
    write_by_day(events, F.col("ts"), path)
    by_day = read_by_day(spark, path, events.schema)
    days = events.where(LOUD_DAYS).select(*[F.date_format("ts", form).alias(name) for name, form in zip(DAY, ("yyyy", "MM", "dd"))]).distinct()
    return by_day.where("year = '2024'").join(days, DAY).select("event_id", "user_id", *DAY)
