from pyspark.sql import functions as F

from reconcile import definitions, keys


def results(spark, function, values):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v string")
    return [r.x for r in df.orderBy("n").select(function(F.col("v")).alias("x")).collect()]


def test_is_identifier(spark):
    names = {"salesdb": True, "sales_db-1": True, "データ": True, "naïve": True, "a b": False, "a.b": False, "": False, "a\n": False, None: False, "a/b": False}
    assert results(spark, keys.is_identifier, names) == list(names.values())


def test_key_from_path(spark):
    paths = {
        "/base/salesdb/customers.sql": ("salesdb", "customers"),
        "file:/x/my-db/my_t.sql": ("my-db", "my_t"),
        "customers.sql": None,
        "/base/salesdb/customers.txt": None,
        "/base/sales db/customers.sql": None,
        "/base/salesdb/a.b.sql": None,
        "/base/salesdb/.sql": None,
    }
    assert [x and tuple(x) for x in results(spark, keys.key_from_path, paths)] == list(paths.values())


def test_split_key(spark):
    given = {"salesdb.customers": ("salesdb", "customers"), "invalid": None, "too.many.parts": None, "a.": ("a", ""), "": None}
    assert [x and tuple(x) for x in results(spark, keys.split_key, given)] == list(given.values())


def test_split_location(spark):
    urls = {
        "s3://bucket/key": ("bucket", "key"), "s3://bucket/path/to/object": ("bucket", "path/to/object"), "http://bucket/key": None,
        "s3://bucket": None, "s3://bucket/": None, "s3:///key": None, "xs3://bucket/key": None,
    }
    assert [x and tuple(x) for x in results(spark, definitions.split_location, urls)] == list(urls.values())


def test_definition_path(spark):
    row = spark.range(1).select(
        keys.definition_path("/base", F.lit("salesdb"), F.lit("customers")).alias("a"),
        keys.definition_path("/base", F.lit("sales db"), F.lit("customers")).alias("b"),
        keys.qualified_name(F.lit("salesdb"), F.lit("customers")).alias("c"),
    ).first()
    assert tuple(row) == ("/base/salesdb/customers.sql", None, "salesdb.customers")
