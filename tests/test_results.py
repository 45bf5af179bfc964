import json

import pytest
from pyspark.sql import functions as F

from reconcile import plan, results

KEYS = ["database_name", "table_name"]
SCHEMA = """database_name string, table_name string, operation string, text_diff string, change_details struct<
  column_changes: array<struct<change_type: string, column_name: string, old_type: string, new_type: string>>,
  property_changes: array<struct<property_name: string, old_value: string, new_value: string>>>"""
DETAILS = ([("TypeChanged", "id", "int", "bigint")], [("format", "PARQUET", "ORC")])
ROWS = [
    ("salesdb", "z", "Update", "--- remote\n+++ local\n-a\n+\"é\"\n", DETAILS), ("salesdb", "b", "Create", None, None),
    ("adb", "c", "Create", None, None), ("salesdb", "gone", "Delete", None, None), ("salesdb", "same", "NoChange", None, None),
]


@pytest.fixture(scope="module")
def planned(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_summary(planned):
    assert tuple(results.summarize(planned).first()) == (2, 1, 1, False, True, 4)
    assert tuple(results.summarize(planned.where("operation = 'NoChange'")).first()) == (0, 0, 0, True, False, 0)
    assert tuple(results.summarize(planned.where("false")).first()) == (0, 0, 0, True, False, 0)


def test_containers_and_names(planned):
    assert [r[0] for r in results.containers_to_create(planned).collect()] == ["adb", "salesdb"]
    names = {tuple(r) for r in results.changed_names(planned, KEYS).collect()}
    assert names == {("Update", "salesdb.z"), ("Create", "salesdb.b"), ("Create", "adb.c"), ("Delete", "salesdb.gone")}


def test_report(planned):
    found = [tuple(r)[2:5] for r in results.report(planned, KEYS, show_unchanged=True).collect()]
    assert found == [
        (None, None, "Plan: 2 to add, 1 to change, 1 to remove."),
        ("adb", "+", "new container, made unless it is there"), ("salesdb", "+", "new container, made unless it is there"),
        ("adb.c", "+", "is new and will be added"), ("salesdb.b", "+", "is new and will be added"), ("salesdb.gone", "-", "is not wanted and will be removed"),
        ("salesdb.z", "~", "differs and will be changed"), ("salesdb.same", " ", "is as wanted"),
    ]
    assert results.report(planned, KEYS).count() == 7
    nothing = results.report(planned.where("false"), KEYS).collect()
    assert len(nothing) == 1 and nothing[0].message.endswith(results.NOTHING_TO_DO)


EXPECTED = {
    "no_change": False,
    "summary": {"to_add": 2, "to_change": 1, "to_destroy": 1},
    "table_diffs": [
        {"database_name": "adb", "table_name": "c", "operation": "Create", "text_diff": None, "change_details": None},
        {"database_name": "salesdb", "table_name": "b", "operation": "Create", "text_diff": None, "change_details": None},
        {"database_name": "salesdb", "table_name": "gone", "operation": "Delete", "text_diff": None, "change_details": None},
        {
            "database_name": "salesdb", "table_name": "z", "operation": "Update", "text_diff": ROWS[0][3],
            "change_details": {
                "column_changes": [{"change_type": "TypeChanged", "column_name": "id", "old_type": "int", "new_type": "bigint"}],
                "property_changes": [{"property_name": "format", "old_value": "PARQUET", "new_value": "ORC"}],
            },
        },
    ],
}


def test_json_document(planned, tmp_path):
    changes = planned.where("operation <> 'NoChange'")
    path = tmp_path / "document"
    results.json_document_lines(changes, KEYS).write.text(str(path))
    written = "".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("part-*")))
    assert json.loads(written) == EXPECTED and list(json.loads(written)) == list(EXPECTED)
    empty = json.loads("".join(r.line for r in results.json_document_lines(changes.where("false"), KEYS).collect()))
    assert empty == {"no_change": True, "summary": {"to_add": 0, "to_change": 0, "to_destroy": 0}, "table_diffs": []}


def test_json_rows_round_trip(planned):
    rows = results.to_json_rows(planned)
    assert '"text_diff":null,"change_details":null' in rows.where("json LIKE '%gone%'").first().json
    back = results.from_json(rows, planned.schema)
    assert back.exceptAll(planned).count() == 0 and planned.exceptAll(back).count() == 0
    with pytest.raises(Exception):
        results.from_json(rows.select(F.lit("{broken").alias("json")), planned.schema).collect()


def test_display_names(planned):
    operation = F.col("operation")
    shown = {r[0]: (r[1], r[2]) for r in planned.select(operation, results.display_name(operation), results.is_change(operation)).distinct().collect()}
    assert shown == {"Create": ("create", True), "Update": ("update", True), "Delete": ("delete", True), "NoChange": ("no change", False)}


def test_exchange_is_shared(spark):
    """The report reads the plan three times and computes it once."""
    current = spark.range(1000).selectExpr("id AS k", "'x' AS v")
    desired = spark.range(500, 1500).selectExpr("id AS k", "'y' AS v")
    report = results.report(plan.plan(current, desired, ["k"], details=False), ["k"])
    report.collect()
    assert "ReusedExchange" in report._jdf.queryExecution().executedPlan().toString()
