import datetime
import re

import pytest
from pyspark.sql import functions as F

from reconcile import apply, drift, plan, results

SCHEMA = "d string, t string, v string, n int"


@pytest.fixture(scope="module")
def sides(spark):
    current = spark.createDataFrame(
        [("a", "gone", "x", 1), ("a", "same", "x", None), ("a", "new value", "x", 1), ("b", "null", None, 1), ("b", "case", "X", 1)], SCHEMA
    )
    desired = spark.createDataFrame(
        [("a", "added", "x", 1), ("a", "same", "x", None), ("a", "new value", "y", 2), ("b", "null", "x", 1), ("b", "case", "x", 1)], SCHEMA
    )
    return current, desired


KEYS = ["d", "t"]


def operations(planned):
    return {(r.d, r.t): r.operation for r in planned.collect()}


ALL = {
    ("a", "gone"): "Delete", ("a", "same"): "NoChange", ("a", "new value"): "Update", ("a", "added"): "Create",
    ("b", "null"): "Update", ("b", "case"): "Update",
}


@pytest.mark.parametrize("options", [{}, {"strategy": "join"}, {"details": False}, {"duplicates": "last", "order_by": ["n"]}])
def test_operations(sides, options):
    assert operations(plan.plan(*sides, KEYS, include_unchanged=True, **options)) == ALL
    changed = {k: v for k, v in ALL.items() if v != "NoChange"}
    assert operations(plan.plan(*sides, KEYS, **options)) == changed


def test_one_operation_alone(sides):
    for function, name in ((plan.creates, "Create"), (plan.deletes, "Delete"), (plan.updates, "Update")):
        assert operations(function(*sides, KEYS)) == {k: v for k, v in ALL.items() if v == name}


def test_changes(sides):
    cells = {tuple(r)[1:] for r in drift.cell_changes(plan.plan(*sides, KEYS), KEYS).collect()}
    assert cells == {
        ("new value", "v", "x", "y"), ("new value", "n", "1", "2"), ("null", "v", None, "x"), ("case", "v", "X", "x"),
    }
    only = plan.plan(*sides, KEYS, compare=["n"])
    assert {r.t for r in only.where("operation = 'Update'").collect()} == {"new value"}


def test_swapping_sides_swaps_creates_and_deletes(sides):
    swapped = operations(plan.plan(*sides[::-1], KEYS))
    names = {"Create": "Delete", "Delete": "Create", "Update": "Update"}
    assert swapped == {k: names[v] for k, v in ALL.items() if v != "NoChange"}


def test_a_snapshot_against_itself(sides):
    assert plan.plan(sides[0], sides[0], KEYS).count() == 0
    assert results.summarize(plan.plan(sides[0], sides[0], KEYS)).first().no_change


def test_scope_cuts_both_sides(sides):
    assert set(operations(plan.plan(*sides, KEYS, targets=["a.*"]))) == {("a", "gone"), ("a", "new value"), ("a", "added")}
    assert set(operations(plan.plan(*sides, KEYS, where=lambda d, t: t.startswith("n")))) == {("a", "new value"), ("b", "null")}
    assert operations(plan.plan(*sides, KEYS, targets=["malformed"])) == {}
    assert operations(plan.plan(*sides, KEYS, targets=[])) == {k: v for k, v in ALL.items() if v != "NoChange"}
    with pytest.raises(ValueError):
        plan.plan(*sides, ["t"], compare=["v"], targets=["a.*"])


def test_keys_with_dots_stay_apart(spark):
    current = spark.createDataFrame([("a.b", "c", "x", 1)], SCHEMA)
    desired = spark.createDataFrame([("a", "b.c", "x", 1)], SCHEMA)
    assert operations(plan.plan(current, desired, KEYS)) == {("a.b", "c"): "Delete", ("a", "b.c"): "Create"}


@pytest.mark.parametrize("strategy", ["union", "join"])
def test_repeated_and_null_keys_are_errors(spark, sides, strategy):
    twice = sides[1].unionByName(sides[1].where("t = 'same'"))
    with pytest.raises(Exception, match="key occurs more than once: a.same"):
        plan.plan(sides[0], twice, KEYS, strategy=strategy).collect()
    with pytest.raises(Exception, match="more than once"):
        plan.creates(sides[0], sides[1].unionByName(sides[1]), KEYS).collect()
    null = sides[1].unionByName(spark.createDataFrame([(None, "t", "x", 1)], SCHEMA))
    with pytest.raises(Exception, match="null in key"):
        plan.plan(sides[0], null, KEYS, strategy=strategy).collect()


def test_last_row_wins(spark):
    current = spark.createDataFrame([("a", "t", "old", 1), ("a", "t", "new", 2)], SCHEMA)
    desired = spark.createDataFrame([("a", "t", "new", 5), ("a", "t", "older", 3), ("b", "u", "x", 1)], SCHEMA)
    planned = plan.plan(current, desired, KEYS, ["v"], duplicates="last", order_by=["n"], include_unchanged=True)
    assert operations(planned) == {("a", "t"): "NoChange", ("b", "u"): "Create"}
    assert {tuple(r) for r in plan.last_rows(current, KEYS, ["n"]).collect()} == {("a", "t", "new", 2)}
    assert {tuple(r) for r in plan.repeated_keys(current, KEYS).collect()} == {("a", "t", 2)}


def test_types_of_compared_columns(spark):
    schema = "k int, m map<string,int>, a array<int>, s struct<x:int>, b binary, f double, e decimal(10,2)"
    base = (1, {"x": 1, "y": 2}, [1], (1,), b"\xff", float("nan"), None)
    current = spark.createDataFrame([base], schema)
    same = spark.createDataFrame([(1, {"y": 2, "x": 1}, [1], (1,), b"\xff", float("nan"), None)], schema)
    other = spark.createDataFrame([(1, {"x": 1}, [1, 2], (None,), b"\xfe", 1.5, None)], schema)
    assert plan.plan(current, same, ["k"]).count() == 0
    changes = plan.plan(current, other, ["k"]).first().changes
    assert [c.column_name for c in changes] == ["m", "a", "s", "b", "f"]
    assert (changes[3].old_value, changes[3].new_value) == ("FF", "FE")


@pytest.mark.parametrize("options", [{}, {"strategy": "join"}, {"details": False}, {"duplicates": "last", "order_by": ["n"]}])
def test_unreadable_rows_take_part_on_neither_side(spark, options):
    current = spark.createDataFrame([("a", "lost", None, 1), ("a", "lost there", "x", 1), ("a", "gone", "x", 1), ("a", "both", None, 1)], SCHEMA)
    desired = spark.createDataFrame([("a", "lost", "x", 1), ("a", "lost there", None, 1), ("a", "new", None, 1), ("a", "both", None, 1)], SCHEMA)
    assert operations(plan.plan(current, desired, KEYS, required=["v"], include_unchanged=True, **options)) == {("a", "gone"): "Delete"}
    errors = {(r.t, r.side) for r in plan.unreadable(current, desired, KEYS, ["v"], targets=["a.*"]).collect()}
    assert errors == {("lost", "current"), ("both", "current"), ("lost there", "desired"), ("new", "desired"), ("both", "desired")}


def test_long_values_by_digest(spark):
    long = "x" * 100
    current = spark.createDataFrame([("a", "t", long, 1), ("a", "u", long, 1), ("a", "v", "x" * 32, 1), ("a", "w", None, 1)], SCHEMA)
    desired = spark.createDataFrame([("a", "t", long, 1), ("a", "u", long + "y", 1), ("a", "v", "x" * 31, 1), ("a", "w", "", 1)], SCHEMA)
    planned = plan.plan(current, desired, KEYS, details=False, include_unchanged=True)
    assert operations(planned) == {("a", "t"): "NoChange", ("a", "u"): "Update", ("a", "v"): "Update", ("a", "w"): "Update"}


def test_a_key_with_a_third_of_all_rows(spark):
    """The hot key is folded before the exchange, which then carries one row per task."""
    hot = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("at"), (F.col("id") % 7).alias("v")
    )
    desired = hot.withColumn("v", F.when(F.col("k") == "hot", F.col("v") + 1).otherwise(F.col("v")))
    planned = plan.plan(hot, desired, ["k"], ["v"], duplicates="last", order_by=["at"])
    assert [tuple(r)[:2] for r in planned.collect()] == [("hot", "Update")]
    with pytest.raises(Exception, match="more than once: hot"):
        plan.plan(hot, desired, ["k"], ["v"]).collect()


def test_bucketed_tables_meet_without_an_exchange(spark, tmp_path):
    for name in ("bucketed_old", "bucketed_new"):
        spark.range(100).selectExpr("id AS k", "'x' AS v").write.bucketBy(4, "k").option("path", str(tmp_path / name)).saveAsTable(name)
    planned = plan.plan(spark.table("bucketed_old"), spark.table("bucketed_new"), ["k"], strategy="join")
    assert "Exchange" not in planned._jdf.queryExecution().executedPlan().toString()
    assert planned.count() == 0
    for name in ("bucketed_old", "bucketed_new"):
        spark.sql(f"DROP TABLE {name}")


def test_applying_a_plan(sides):
    current, desired = sides
    new = apply.reconciled(current, desired, plan.plan(current, desired, KEYS), KEYS)
    assert new.exceptAll(desired).count() == 0 and desired.exceptAll(new).count() == 0
    assert plan.plan(new, desired, KEYS).count() == 0
    scoped = apply.reconciled(current, desired, plan.plan(current, desired, KEYS, targets=["a.*"]), KEYS)
    expected = desired.where("d = 'a'").unionByName(current.where("d = 'b'"))
    assert scoped.exceptAll(expected).count() == 0 and expected.exceptAll(scoped).count() == 0


def test_digests_are_aggregated_by_hash_and_no_text_moves(spark, tmp_path):
    for name in ("cur", "des"):
        spark.range(200).selectExpr("id AS k", f"repeat(id || '{name}', 50) AS t", "array(map('a', id)) AS m").write.parquet(str(tmp_path / name))
    cur, des = (spark.read.parquet(str(tmp_path / name)) for name in ("cur", "des"))
    shown = plan.plan(cur, des, ["k"], details=False)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in shown and "HashAggregate" in shown
    exchanged = [line for line in shown.splitlines() if "partial_max" in line]
    assert exchanged and not any(re.search(r"\bt#", line.split("output=")[-1]) for line in exchanged)


def test_nested_values(spark):
    schema = "k int, `a.b` array<struct<m: map<string, map<string, int>>, t: timestamp>>, s struct<`x.y`: map<int, string>>"
    cur = spark.createDataFrame([
        (1, [{"m": {"a": {"x": 1, "y": 2}, "b": {}}, "t": None}], ({1: "a", 2: None},)),
        (2, [{"m": None, "t": None}], None),
        (3, [{"m": {"a": {"x": None}}, "t": datetime.datetime(2024, 1, 1, 0, 0, 0, 1)}], ({},)),
        (4, [], (None,)),
        (5, None, ({1: "a"},)),
    ], schema)
    des = spark.createDataFrame([
        (1, [{"m": {"b": {}, "a": {"y": 2, "x": 1}}, "t": None}], ({2: None, 1: "a"},)),
        (2, [{"m": {}, "t": None}], None),
        (3, [{"m": {"a": {"x": None}}, "t": datetime.datetime(2024, 1, 1, 0, 0, 0, 2)}], ({},)),
        (4, [], None),
        (5, None, ({1: "b"},)),
    ], schema)
    expected = {1: None, 2: ["a.b"], 3: ["a.b"], 4: ["s"], 5: ["s"]}
    for strategy in ("union", "join"):
        planned = plan.plan(cur, des, ["k"], include_unchanged=True, strategy=strategy)
        assert {r.k: r.changes and [c.column_name for c in r.changes] for r in planned.collect()} == expected
        digests = plan.plan(cur, des, ["k"], details=False, include_unchanged=True, strategy=strategy)
        assert {r.k: r.operation for r in digests.collect()} == {k: "Update" if v else "NoChange" for k, v in expected.items()}
