"""The diff and its application against plain Python, on many small random snapshots at once."""

import random

import pytest
from pyspark.sql import functions as F

from reconcile import apply, plan

CASES = 60
SCHEMA = "case int, d string, t string, v string, n int"
KEYS = ["case", "d", "t"]


def snapshots(seed):
    rng = random.Random(seed)
    sides = []
    for _ in range(2):
        rows = {}
        for case in range(CASES):
            for _ in range(rng.randrange(8)):
                key = (case, rng.choice("ab"), rng.choice(["x", "y", "x.y", "", "é"]))
                rows[key] = (rng.choice(["1", "1 ", "2", "", None]), rng.choice([0, 1, None]))
        sides.append(rows)
    return sides


def tidy(row):
    return (row[0] if row[0] is None else row[0].rstrip(), row[1])


def expected(old, new):
    found = {}
    for key in old.keys() | new.keys():
        if key not in old:
            found[key] = ("Create", None)
        elif key not in new:
            found[key] = ("Delete", None)
        else:
            cells = [(c, a, b) for c, a, b in zip("vn", tidy(old[key]), tidy(new[key])) if a != b]
            shown = [(c, None if a is None else str(a), None if b is None else str(b)) for c, a, b in cells]
            found[key] = ("Update", shown) if cells else ("NoChange", None)
    return found


def frame(spark, rows):
    return spark.createDataFrame([(*key, *row) for key, row in rows.items()], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("strategy", ["union", "join"])
def test_plan_and_apply(spark, seed, strategy):
    old, new = snapshots(seed)
    current, desired = frame(spark, old), frame(spark, new)
    planned = plan.plan(current, desired, KEYS, normalize="trailing", include_unchanged=True, strategy=strategy)
    found = {tuple(r)[:3]: (r.operation, None if r.changes is None else [tuple(c) for c in r.changes]) for r in planned.collect()}
    wanted = expected(old, new)
    assert found == wanted
    # Unchanged rows stay as they are in the current snapshot, white space included.
    result = {tuple(r)[:3]: tuple(r)[3:] for r in apply.reconciled(current, desired, planned, KEYS).collect()}
    assert result == {k: old[k] if wanted[k][0] == "NoChange" else row for k, row in new.items()}


@pytest.mark.parametrize("seed", [4, 5])
def test_one_sided_and_digest(spark, seed):
    old, new = snapshots(seed)
    current, desired = frame(spark, old), frame(spark, new)
    wanted = {k: v[0] for k, v in expected({k: (None, r[1]) for k, r in old.items()}, {k: (None, r[1]) for k, r in new.items()}).items()}
    by_digest = plan.plan(current, desired, KEYS, ["n"], details=False, include_unchanged=True)
    assert {tuple(r)[:3]: r.operation for r in by_digest.collect()} == wanted
    for function, name in ((plan.creates, "Create"), (plan.deletes, "Delete")):
        assert {tuple(r)[:3] for r in function(current, desired, KEYS).collect()} == {k for k, v in wanted.items() if v == name}
    rows = [(*k, *r, n) for n, k in enumerate(old) for r in (old[k], ("other", 1))]
    twice = spark.createDataFrame(rows, SCHEMA + ", at int").withColumn("at", F.when(F.col("v") == "other", -1).otherwise(F.col("at")))
    last = {tuple(r)[:3]: tuple(r)[3:5] for r in plan.last_rows(twice, KEYS, ["at"]).collect()}
    assert last == old
