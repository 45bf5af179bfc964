import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reconcile import filters
from reconcile.functions.automaton import PatternAutomaton

NAMES = [
    ("salesdb", "customers"), ("salesdb", "orders"), ("salesdb_prod", "orders"), ("marketingdb", "leads"),
    ("marketingdb", "customers"), ("my-database", "my-table"), ("my_database", "my_table"), ("myXdatabase", "my.table"),
    ("DB1", "TABLE1"), ("db1", "table1"), ("db\n1", "t"), ("a", "aXbXc"), ("a", "abc"), ("a", "acb"), ("aa", "\\E*"), ("", ""),
]


def kept(spark, targets):
    df = spark.createDataFrame(NAMES, "d string, t string")
    return {tuple(r) for r in df.where(filters.target_predicate(targets, F.col("d"), F.col("t"))).collect()}


def test_resolve_targets():
    assert filters.resolve_targets(["salesdb.customers"], ["marketingdb"]) == ["salesdb.customers"]
    assert filters.resolve_targets([], ["salesdb", "marketingdb"]) == ["salesdb.*", "marketingdb.*"]
    assert filters.resolve_targets([]) == []
    assert filters.resolve_targets([], []) == []


@pytest.mark.parametrize(
    "targets, expected",
    [
        ([], set(NAMES)),
        (["*.*"], set(NAMES)),
        (["salesdb.customers"], {("salesdb", "customers")}),
        (["salesdb.*"], {("salesdb", "customers"), ("salesdb", "orders")}),
        (["*.customers"], {("salesdb", "customers"), ("marketingdb", "customers")}),
        (["sales*.orders"], {("salesdb", "orders"), ("salesdb_prod", "orders")}),
        (["salesdb.customers", "marketingdb.*"], {("salesdb", "customers"), ("marketingdb", "leads"), ("marketingdb", "customers")}),
        (["salesdb.orders", "salesdb.orders", "salesdb.o*"], {("salesdb", "orders")}),
        (["invalid"], set()),
        ([""], set()),
        (["too.many.parts", "salesdb.orders"], {("salesdb", "orders")}),
        (["DB1.TABLE1"], {("DB1", "TABLE1")}),
        (["my-database.my-table"], {("my-database", "my-table")}),
        (["my_database.*"], {("my_database", "my_table")}),
        (["db*1.t"], set()),
        (["db*.*"], {("db1", "table1")}),
        (["a.a*b*c"], {("a", "aXbXc"), ("a", "abc")}),
        (["a*a.*"], {("aa", "\\E*")}),
        (["aa.\\E*"], {("aa", "\\E*")}),
        (["."], {("", "")}),
    ],
)
def test_target_predicate(spark, targets, expected):
    assert kept(spark, targets) == expected


def test_semi_join_agrees_with_the_predicate(spark):
    targets = [
        "salesdb.customers", "marketingdb.*", "*.orders", "my*.my*", "*1.*", "a.*b*", "d*.t*", "**.", "invalid",
        "too.many.parts", "aa.\\E*", "*.*X*",
    ]
    df = spark.createDataFrame(NAMES, "d string, t string")
    for chosen in [targets, targets[:2], targets[3:5], ["**.*"], ["*.**"], ["*.*"], ["invalid"], []]:
        patterns = spark.createDataFrame([(p,) for p in chosen], "pattern string")
        found = filters.target_semi_join(df, patterns, "d", "t")
        expected = kept(spark, chosen) if chosen else set()
        assert {tuple(r) for r in found.collect()} == expected, chosen


def test_automaton_agrees_with_each_pattern_alone():
    rng = random.Random(3)
    words = ["".join(rng.choice("ab\n\x03é") for _ in range(rng.randrange(6))) for _ in range(60)] + [None]
    halves = ["".join(rng.choice("ab*é\n") for _ in range(rng.randrange(5))) for _ in range(60)]
    for size in (1, 2, 40):
        patterns = [(rng.choice(halves), rng.choice(halves)) for _ in range(size)]
        machine = PatternAutomaton(patterns)

        def half(pattern, name):
            if pattern == "*":
                return True
            return name is not None and re.fullmatch("[^\n]*".join(map(re.escape, pattern.split("*"))), name) is not None

        for _ in range(600):
            d, t = rng.choice(words), rng.choice(words)
            assert machine.matches(d, t) == any(half(pd, d) and half(pt, t) for pd, pt in patterns), (patterns, d, t)


def test_more_patterns_than_a_task_holds(spark):
    targets = [f"{d}.{t}" for d in ("sales*", "m*d*", "salesdb", "*", "**") for t in ("*o*", "c*s", "customers", "TABLE*", "*x")] + ["bad", None]
    df = spark.createDataFrame([*NAMES, (None, "customers"), ("salesdb", None)], "d string, t string")
    patterns = spark.createDataFrame([(p,) for p in targets * 2], "pattern string")
    whole, parts = (Counter(map(tuple, filters.target_semi_join(df, patterns, "d", "t", block_chars=n).collect())) for n in (1 << 20, 12))
    assert whole == parts and (None, "customers") in whole


def test_names_do_not_move(spark):
    """A third of the rows have one name and all patterns share their pieces: there is no exchange, so no task gets more than it read."""
    df = spark.range(0, 3000, 1, 6).selectExpr("'hot_' || if(id % 3 = 0, 1, id) AS d", "'t' || if(id % 3 = 0, 1, id) AS t")
    patterns = spark.createDataFrame([(f"hot*{n}.t*{n}",) for n in range(0, 2000, 3)] + [("hot_1*.t*",)], "pattern string")
    kept = filters.target_semi_join(df, patterns, "d", "t")
    shown = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in shown and shown.count("Range") == 1
    names = ["1" if n % 3 == 0 else str(n) for n in range(3000)]
    assert kept.count() == sum(n.startswith("1") or any(n.endswith(str(m)) for m in range(0, 2000, 3)) for n in names)
    tasks = kept.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in tasks) < 2 * sum(r["count"] for r in tasks) / len(tasks)


@pytest.mark.parametrize(
    "targets, pushed",
    [
        (["salesdb.*"], "EqualTo(d,salesdb)"),
        (["salesdb.*", "mark*.*"], "Or(EqualTo(d,salesdb),StringStartsWith(d,mark))"),
        (["a.b*c", "x.y"], "Or(And(EqualTo(d,x),EqualTo(t,y)),And(And(EqualTo(d,a),StringStartsWith(t,b)),StringEndsWith(t,c)))"),
        (["salesdb.*", "my*d*e.*"], "Or(EqualTo(d,salesdb),And(And(StringStartsWith(d,my),StringEndsWith(d,e)),StringContains(d,d)))"),
    ],
)
def test_predicates_reach_the_scan(spark, tmp_path, targets, pushed):
    path = str(tmp_path / "names")
    spark.createDataFrame(NAMES, "d string, t string").write.parquet(path)
    df = spark.read.parquet(path).where(filters.target_predicate(targets, F.col("d"), F.col("t")))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        shown = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert pushed in shown[shown.index("PushedFilters") :]


def test_many_wildcards_agree_with_each_alone(spark):
    targets = [f"{d}.{t}" for d in ("sales*", "*db", "m*d*", "*", "**", "a*a", "db*1") for t in ("*o*", "c*s", "*", "TABLE*", "a*b*c", "**", "my*e")]
    targets = [t for t in targets if t != "*.*"]
    assert len(targets) > filters.MANY
    assert kept(spark, targets) == set().union(*(kept(spark, [t]) for t in targets))
    assert kept(spark, targets[2:3] + targets[30:]) == set().union(*(kept(spark, [t]) for t in targets[2:3] + targets[30:]))
    fewer = [t for t in targets if not t.startswith("*") and not t.endswith("*")]
    assert kept(spark, fewer * 2) == set().union(*(kept(spark, [t]) for t in fewer)) != set(NAMES)


def test_null_names_have_one_truth_value(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "y"), ("b", "z"), (None, None)], "d string, t string")
    for some in (["a.*"], ["*.y"], ["a.x"], ["*.*"], ["a*.*", "*.y*"]):
        rest = [f"q{n}*.r{n}*" for n in range(40)]  # match nothing
        one, many = (filters.target_predicate(t, F.col("d"), F.col("t")) for t in (some, some + rest))
        counts = [df.where(p).count() for p in (one, many)] + [df.where(~p).count() for p in (one, many)]
        patterns = spark.createDataFrame([(p,) for p in some + rest], "pattern string")
        assert counts[0] == counts[1] == filters.target_semi_join(df, patterns, "d", "t").count()
        assert counts[2] == counts[3] == 5 - counts[0]
