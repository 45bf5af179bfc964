import pytest
from pyspark.sql import functions as F

from reconcile import apply, export, plan, sources
from reconcile.sources import buckets, versions

KEYS = ["database_name", "table_name"]
SCHEMA = "database_name string, table_name string, content string"


@pytest.fixture(scope="module")
def sides(spark):
    current = spark.createDataFrame([("s", "gone", "x"), ("s", "same", "x"), ("s", "changed", "x"), ("m", "t", "x")], SCHEMA)
    desired = spark.createDataFrame([("s", "new", "x"), ("s", "same", "x"), ("s", "changed", "y"), ("m", "t", "z")], SCHEMA)
    return current, desired


def rows(df):
    return {tuple(r) for r in df.select(*SCHEMA.replace(" string", "").split(", ")).collect()}


def test_apply_stages_and_switches(spark, sides, tmp_path):
    current, desired = sides
    root = str(tmp_path)
    planned = plan.plan(current, desired, KEYS)
    assert apply.apply_plan(current, desired, planned, KEYS, root).path is None
    assert sources.latest_version(spark, f"{root}/plans") is None
    with pytest.raises(PermissionError, match="4 changes are not approved"):
        apply.apply_plan(current, desired, planned, KEYS, root, dry_run=False)
    with pytest.raises(PermissionError, match="1 deletions, 0 allowed"):
        apply.apply_plan(current, desired, planned, KEYS, root, dry_run=False, approved=True, max_deletes=0)
    assert sources.latest_version(spark, f"{root}/state") is None
    applied = apply.apply_plan(current, desired, planned, KEYS, root, dry_run=False, approved=True, max_deletes=1, partition_by=KEYS[:1])
    state = sources.read_version(spark, f"{root}/state")
    assert applied.path.endswith("state/version=0") and applied.plan.count() == 4
    assert rows(state) == rows(desired)
    # The state now is current: there is nothing left to do, and no approval is needed.
    again = plan.plan(state, desired, KEYS)
    assert apply.apply_plan(state, desired, again, KEYS, root, dry_run=False).path is None
    # Reading and replacing the same table: the next version is another directory.
    back = plan.plan(state, current, KEYS)
    assert apply.apply_plan(state, current, back, KEYS, root, dry_run=False, approved=True).path.endswith("state/version=1")
    assert rows(sources.read_version(spark, f"{root}/state")) == rows(current)


def test_a_small_plan_does_not_move_the_tables(spark, sides, tmp_path):
    current, desired = sides
    plan.plan(current, desired, KEYS).write.parquet(str(tmp_path / "plan"))
    new = apply.reconciled(current, desired, spark.read.parquet(str(tmp_path / "plan")), KEYS)
    shown = new._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in shown and "hashpartitioning" not in shown


def test_plan_export(spark):
    snapshot = spark.createDataFrame([("s", "new", "x"), ("s", "there", "x"), ("s", "lost", None), ("m", "t", "x"), ("s", "old", None)], SCHEMA)
    existing = spark.createDataFrame([("s", "there", "o"), ("s", "there", "o"), ("s", "old", "o"), ("s", "other", "o")], SCHEMA)
    status = lambda **o: {r.table_name: r.status for r in export.plan_export(snapshot, existing, KEYS, "content", **o).collect()}
    assert status() == {"new": "exported", "there": "skipped", "lost": "error", "t": "exported", "old": "skipped"}
    assert status(overwrite=True) == {"new": "exported", "there": "exported", "lost": "error", "t": "exported", "old": "error"}
    assert status(targets=["*.t"]) == {"t": "exported"}
    totals = export.export_totals(export.plan_export(snapshot, existing, KEYS, "content"))
    assert {r.status: r.n for r in totals.collect()} == {"exported": 2, "skipped": 2, "error": 1}


def test_write_export(spark, tmp_path):
    root = str(tmp_path)
    first = spark.createDataFrame([("s", "a", "1"), ("s", "lost", None)], SCHEMA)
    second = spark.createDataFrame([("s", "a", "2"), ("s", "b", "2"), ("m", "c", "2")], SCHEMA)
    assert export.write_export(first, root, KEYS, "content") == {"exported": 1, "error": 1}
    assert export.write_export(second, root, KEYS, "content", targets=["s.*"]) == {"exported": 1, "skipped": 1}
    assert rows(sources.read_version(spark, root)) == {("s", "a", "1"), ("s", "b", "2")}
    assert export.write_export(second, root, KEYS, "content", targets=["s.*"]) == {"skipped": 2}
    third = spark.createDataFrame([("s", "a", "3"), ("m", "c", "3")], SCHEMA)
    assert export.write_export(third, root, KEYS, "content", overwrite=True) == {"exported": 2}
    assert rows(sources.read_version(spark, root)) == {("s", "a", "3"), ("s", "b", "2"), ("m", "c", "3")}
    assert (tmp_path / "version=1" / "database_name=m").is_dir()


def test_containers_that_look_like_numbers(spark, tmp_path):
    root = str(tmp_path)
    snapshot = spark.createDataFrame([("007", "a", "1"), ("2024-01-01", "b", "1")], SCHEMA)
    assert export.write_export(snapshot, root, KEYS, "content") == {"exported": 2}
    assert export.write_export(snapshot, root, KEYS, "content") == {"skipped": 2}
    assert rows(sources.read_version(spark, root, schema=snapshot.schema)) == rows(snapshot)


def test_partitions_are_pruned(spark, tmp_path):
    path = str(tmp_path / "events")
    days = spark.range(1000).select("id", F.lit("2024").alias("year"), F.lit("01").alias("month"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0").alias("day"))
    days.write.partitionBy("year", "month", "day").parquet(path)
    spark.conf.set("spark.sql.sources.partitionColumnTypeInference.enabled", "false")
    try:
        read = spark.read.parquet(path).where("year = '2024' AND month = '01' AND day = '15'")
        shown = read._jdf.queryExecution().executedPlan().toString()
        assert "day#" in shown[shown.index("PartitionFilters") : shown.index("PushedFilters")]
        assert read.count() == days.where("day = '15'").count()
    finally:
        spark.conf.unset("spark.sql.sources.partitionColumnTypeInference.enabled")


def test_formats(spark, sides, tmp_path):
    for kind in ("parquet", "orc"):
        for name, side in zip(("current", "desired"), sides):
            side.write.format(kind).save(str(tmp_path / kind / name))
        read = [spark.read.format(kind).load(str(tmp_path / kind / name)) for name in ("current", "desired")]
        assert plan.plan(*read, KEYS).count() == 4


def test_apply_takes_the_last_row_of_a_key(spark):
    schema = "k string, v string, n int"
    current = spark.createDataFrame([("a", "x", 1), ("b", "x", 1)], schema)
    desired = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "x", 1)], schema)
    planned = plan.plan(current, desired, ["k"], duplicates="last", order_by=["n"])
    new = apply.reconciled(current, desired, planned, ["k"], order_by=["n"])
    assert {tuple(r) for r in new.collect()} == {("a", "new", 2), ("b", "x", 1)}
    assert plan.plan(new, desired, ["k"], duplicates="last", order_by=["n"]).count() == 0


def test_apply_refuses_null_keys(spark):
    current = spark.createDataFrame([("a", "x")], "k string, v string")
    desired = spark.createDataFrame([("a", "x"), (None, "y"), ("c", "z")], "k string, v string")
    planned = plan.plan(current, desired.where("k is not null"), ["k"])
    with pytest.raises(Exception, match="null in key"):
        apply.reconciled(current, desired, planned, ["k"]).collect()


def test_export_refuses_keys_that_name_nothing(spark, tmp_path):
    snapshot = spark.createDataFrame([("s", "a", "1"), ("", "b", "1"), (None, "c", "1"), (None, "c", "1")], SCHEMA)
    for expected in ({"exported": 1, "error": 3}, {"skipped": 1, "error": 3}):
        assert export.write_export(snapshot, str(tmp_path), KEYS, "content") == expected
    assert rows(sources.read_version(spark, str(tmp_path))) == {("s", "a", "1")}
    with pytest.raises(Exception, match="more than once"):
        export.write_export(snapshot.unionByName(snapshot), str(tmp_path), KEYS, "content")


def test_what_is_added_counts_when_committed(spark, tmp_path):
    root = str(tmp_path)
    export.write_export(spark.createDataFrame([("s", "a", "1")], SCHEMA), root, KEYS, "content")
    export.write_export(spark.createDataFrame([("s", "b", "1")], SCHEMA), root, KEYS, "content")
    added = tmp_path / "added-to=0" / "part=0"
    assert rows(sources.read_version(spark, root)) == {("s", "a", "1"), ("s", "b", "1")}
    (added / "_SUCCESS").unlink()
    assert rows(sources.read_version(spark, root)) == {("s", "a", "1")}


def test_a_few_changes_rewrite_a_few_buckets(spark, tmp_path):
    root = str(tmp_path)
    current = spark.range(150_000).selectExpr("id AS k", "CAST(id % 7 AS string) AS v")
    changed = spark.range(7, 150_000, 15_000).selectExpr("CAST(id AS int) AS k", "IF(id < 20000, NULL, 'new') AS v")
    before = sources.create_buckets(current, root, ["k"], buckets=64)
    files = {p for p in (tmp_path / "files").rglob("*.parquet")}
    # Two keys go, eight change, one comes; the plan's keys are of a narrower type than the table's.
    operations = F.expr("CASE WHEN v IS NULL THEN 'Delete' ELSE 'Update' END AS operation")
    desired = changed.where("v IS NOT NULL").union(spark.createDataFrame([(-1, "first")], "k int, v string"))
    planned = changed.select("k", operations).union(spark.createDataFrame([(-1, "Create")], "k int, operation string"))
    with pytest.raises(PermissionError, match="11 changes are not approved"):
        apply.apply_incremental(desired, planned, root)
    with pytest.raises(PermissionError, match="2 deletions, 1 allowed"):
        apply.apply_incremental(desired, planned, root, approved=True, max_deletes=1)
    after = apply.apply_incremental(desired, planned, root, approved=True)
    moved = [b for b in range(64) if before.held.get(b) != after.held.get(b)]
    assert 1 < len(moved) <= 11 and after.version == 1
    # No file of the old version has gone, and only the touched buckets have new ones.
    new = {p for p in (tmp_path / "files").rglob("*.parquet")} - files
    assert files <= {p for p in (tmp_path / "files").rglob("*.parquet")} and {p.parent.name for p in new} <= {f"bucket={b}" for b in moved}
    state = {r.k: r.v for r in sources.read_buckets(spark, root).collect()}
    gone = {7, 15_007}
    assert state == {n: "new" if n % 15_000 == 7 else str(n % 7) for n in range(150_000) if n not in gone} | {-1: "first"}
    assert sources.read_buckets(spark, root, before).count() == 150_000


def test_a_failed_job_leaves_the_manifest(spark, tmp_path):
    root = str(tmp_path)
    current = spark.range(100).selectExpr("id AS k", "'a' AS v")
    sources.create_buckets(current, root, ["k"], buckets=4)
    planned = current.where("k < 50").select("k", F.lit("Update").alias("operation"))
    broken = current.withColumn("v", F.when(F.col("k") == 49, F.raise_error(F.lit("lost"))).otherwise(F.lit("b")))
    with pytest.raises(Exception, match="lost"):
        apply.apply_incremental(broken, planned, root, approved=True)
    assert sources.latest_manifest(spark, root).version == 0
    assert {r.v for r in sources.read_buckets(spark, root).collect()} == {"a"}


def test_two_writers_of_buckets(spark, tmp_path):
    root = str(tmp_path)
    current = spark.range(1000).selectExpr("id AS k", "'a' AS v")
    base = sources.create_buckets(current, root, ["k"], buckets=32)
    keys = {r.b: r.k for r in current.groupBy(buckets.bucket_of(base).alias("b")).agg(F.min("k").alias("k")).collect()}
    first, second = sorted(keys.values())[:2]

    def change(key, value):
        desired = spark.createDataFrame([(key, value)], "k long, v string")
        return apply.apply_incremental(desired, desired.select("k", F.lit("Update").alias("operation")), root, approved=True, base=base)

    assert change(first, "one").version == 1
    assert change(second, "two").version == 2  # on top of the first, which left its bucket alone
    with pytest.raises(sources.Conflict):
        change(first, "three")
    state = {r.k: r.v for r in sources.read_buckets(spark, root).collect()}
    assert state[first] == "one" and state[second] == "two" and len(state) == 1000
    with pytest.raises(sources.Conflict):
        sources.create_buckets(current, root, ["k"])


def test_overlapping_exports_give_every_key_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    frame = lambda *names: spark.createDataFrame([("s", n, "x") for n in names], SCHEMA)
    export.write_export(frame("a"), root, KEYS, "content")
    rename, others = versions.rename_if_absent, [frame("b", "c"), frame("c", "d")]

    def late(*arguments):
        # While one export is about to end, another one starts and ends.
        if others:
            export.write_export(others.pop(), root, KEYS, "content")
        return rename(*arguments)

    monkeypatch.setattr(versions, "rename_if_absent", late)
    totals = export.write_export(frame("a", "b", "c", "d", "e"), root, KEYS, "content")
    assert totals == {"skipped": 4, "exported": 1}
    found = sorted(r.table_name for r in sources.read_version(spark, root).collect())
    assert found == ["a", "b", "c", "d", "e"]
    assert not list(tmp_path.glob(".unnamed-*"))
