import os

import pytest
from pyspark.sql import functions as F

from reconcile import sources
from reconcile.sources.definition_files import DefinitionReader


@pytest.fixture()
def corpus(tmp_path):
    files = {
        "salesdb/customers.sql": b"CREATE TABLE customers (id int)\n",
        "salesdb/orders.sql": "-- é\nCREATE".encode(),
        "marketingdb/customers.sql": b"CREATE",
        "my-database/my-table.sql": b"x",
        "my-database/" + "t" * 200 + ".sql": b"x",
        "salesdb/empty.sql": b"",
        "salesdb/empty+x y%2B.sql": b"",
        "salesdb/deep/empty.sql": b"",
        "salesdb/broken.sql": b"\xff\xfe\xfd",
        "salesdb/bad name.sql": b"x",
        "sales db/t.sql": b"x",
        "salesdb/a.b.sql": b"x",
        "root.sql": b"x",
        "salesdb/deep/t.sql": b"x",
        "salesdb/notes.txt": b"x",
        "salesdb/UPPER.SQL": b"x",
        "salesdb/_hidden.sql": b"x",
        "salesdb/.dotted.sql": b"x",
        "_db/t.sql": b"x",
    }
    for name, content in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    (tmp_path / "linked").symlink_to(tmp_path / "marketingdb")
    (tmp_path / "emptydb").mkdir()
    return tmp_path


def test_read_corpus(spark, corpus):
    definitions, errors = sources.read_corpus(spark, str(corpus))
    found = {(r.database_name, r.table_name): r.content for r in definitions.collect()}
    assert found == {
        ("salesdb", "customers"): "CREATE TABLE customers (id int)\n", ("salesdb", "orders"): "-- é\nCREATE",
        ("marketingdb", "customers"): "CREATE", ("linked", "customers"): "CREATE", ("my-database", "my-table"): "x",
        ("my-database", "t" * 200): "x", ("salesdb", "empty"): "", ("_db", "t"): "x", ("salesdb", "_hidden"): "x",
    }
    reasons = {r.source.rsplit("/", 2)[-2] + "/" + r.source.rsplit("/", 1)[-1]: r.reason for r in errors.collect()}
    assert reasons == {
        "salesdb/broken.sql": "invalid UTF-8", "salesdb/bad name.sql": "invalid identifier", "sales db/t.sql": "invalid identifier",
        "salesdb/a.b.sql": "invalid identifier", "salesdb/empty+x y%2B.sql": "invalid identifier",
        "salesdb/.dotted.sql": "invalid identifier",
    }


def test_unreadable_files_keep_their_key(spark, corpus):
    found = sources.with_unreadable(*sources.read_corpus(spark, str(corpus))).where("content is null").collect()
    assert [(r.database_name, r.table_name) for r in found] == [("salesdb", "broken")]


@pytest.mark.parametrize(
    "targets, expected",
    [
        (["salesdb.cust*"], {"salesdb.customers"}),
        (["*.customers", "my*.*-t*"], {"salesdb.customers", "marketingdb.customers", "linked.customers", "my-database.my-table"}),
        (["_*.*"], {"_db.t"}),
        (["malformed", "a.b.c"], set()),
        (["sales.*"], set()),
    ],
)
def test_only_what_is_in_scope_is_opened(spark, corpus, targets, expected):
    definitions, _ = sources.read_corpus(spark, str(corpus), targets)
    assert {f"{r.database_name}.{r.table_name}" for r in definitions.collect()} == expected
    # The directories out of scope are not even tasks.
    reader = DefinitionReader({"path": str(corpus), "targets": "\n".join(targets), "tasks": "3"})
    assert {p.database for p in reader.partitions() if p.database} >= {e.split(".")[0] for e in expected}
    assert all(p.database in {"salesdb", "marketingdb", "linked", "my-database", "_db", "sales db", "emptydb", ""} for p in reader.partitions())
    if targets == ["_*.*"]:
        assert {p.database for p in reader.partitions()} == {"_db"}


def test_a_large_directory_is_shared_by_tasks(tmp_path):
    (tmp_path / "db").mkdir()
    for n in range(500):
        (tmp_path / "db" / f"t{n}.sql").write_text(str(n))
    reader = DefinitionReader({"path": str(tmp_path), "tasks": "10"})
    shares = [[r for batch in reader.read(p) for r in batch.column(1).to_pylist()] for p in reader.partitions()]
    assert len(shares) == 10 and max(map(len, shares)) < 100
    assert sorted(int(c) for share in shares for c in share) == list(range(500))


def test_unreadable_and_odd_names(spark, tmp_path):
    (tmp_path / "db").mkdir()
    (tmp_path / "db" / "gone.sql").symlink_to(tmp_path / "nowhere")
    (tmp_path / "db" / "dir.sql").mkdir()
    (tmp_path / "db" / "a b%20c+d.sql").write_text("x")
    (tmp_path / "db" / "ok.sql").write_text("x")
    with open(os.fsencode(str(tmp_path / "db")) + b"/bad\xff.sql", "w") as file:
        file.write("x")
    definitions, errors = sources.read_corpus(spark, str(tmp_path))
    assert [r.table_name for r in definitions.collect()] == ["ok"]
    assert {(r.source.rsplit("/", 1)[1], r.reason) for r in errors.collect()} == {
        ("", "name is not UTF-8"), ("a b%20c+d.sql", "invalid identifier"),
    }


def test_write_corpus(spark, tmp_path):
    base = str(tmp_path / "out" / "corpus")
    rows = [("a", "x", "1\n"), ("_a", "_x", None), ("a", "é-1", "é")]
    sources.write_corpus(spark.createDataFrame(rows, "database_name string, table_name string, content string"), base)
    sources.write_corpus(spark.createDataFrame([("a", "x", "2")], "database_name string, table_name string, content string"), base)
    found = {(r.database_name, r.table_name): r.content for r in sources.read_corpus(spark, base)[0].collect()}
    assert found == {("a", "x"): "2", ("_a", "_x"): "", ("a", "é-1"): "é"}
    with pytest.raises(Exception, match="no identifier: a ../b"):
        sources.write_corpus(spark.createDataFrame([("a", "../b", "2")], "database_name string, table_name string, content string"), base)
    assert not [p for p in (tmp_path / "out").rglob("*.unfinished")]


def test_base_must_be_a_directory(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.read_corpus(spark, str(tmp_path / "missing"))
    (tmp_path / "file.sql").write_text("x")
    with pytest.raises(NotADirectoryError):
        sources.read_corpus(spark, str(tmp_path / "file.sql"))


def test_empty_base(spark, tmp_path):
    definitions, errors = sources.read_corpus(spark, str(tmp_path))
    assert definitions.count() == 0 and errors.count() == 0


def test_many_tables(spark, tmp_path):
    for d in range(10):
        (tmp_path / f"db{d}").mkdir()
        for t in range(20):
            (tmp_path / f"db{d}" / f"table{t}.sql").write_text(f"CREATE TABLE t{t} (id int)")
    definitions, _ = sources.read_corpus(spark, str(tmp_path))
    assert definitions.count() == 200
    assert {r[0]: r[1] for r in definitions.groupBy("database_name").count().collect()} == {f"db{d}": 20 for d in range(10)}


def test_a_table_of_files_keeps_empty_and_underscored_ones(spark):
    files = spark.createDataFrame([("/c/db/_x.sql", b""), ("/c/db/t.sql", b"a"), ("/elsewhere/db/t.sql", b"a"), ("/c/db/.sql", b"a")], "path string, content binary")
    definitions, errors = sources.parse_corpus(files, "/c")
    assert {(r.table_name, r.content) for r in definitions.collect()} == {("_x", ""), ("t", "a")}
    assert errors.count() == 0


FRAGMENTS = [("a", 2, ")"), ("a", 0, "CREATE TABLE test ("), ("a", 1, "  id int"), ("b", 0, "x  "), ("b", 1, None), ("b", 2, "y"), ("c", 0, None)]


@pytest.mark.parametrize("block", [None, 1, 2, 4096])
def test_assemble(spark, block):
    df = spark.createDataFrame(FRAGMENTS, "k string, pos int, line string")
    found = {r.k: r.content for r in sources.assemble(df, ["k"], "pos", "line", block=block).collect()}
    assert found == {"a": "CREATE TABLE test (\n  id int\n)", "b": "x  \n\ny", "c": ""}
    assert sources.assemble(df.where("false"), ["k"], "pos", "line").count() == 0


def test_assemble_a_key_with_a_third_of_all_rows(spark):
    df = spark.range(90_000).select(
        F.when(F.col("id") < 30_000, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("pos"), F.col("id").cast("string").alias("line")
    ).orderBy(F.rand(3))
    found = sources.assemble(df, ["k"], "pos", "line").where("k = 'hot'").first().content
    assert found == "\n".join(map(str, range(30_000)))


def test_assemble_by_text_order(spark):
    df = spark.createDataFrame([("a", "2", "y"), ("a", "1", "x")], "k string, pos string, line string")
    assert sources.assemble(df, ["k"], "pos", "line").first().content == "x\ny"


def test_versions(spark, tmp_path):
    root = str(tmp_path / "root")
    assert sources.latest_version(spark, root) is None and sources.read_version(spark, root) is None
    sources.write_version(spark.range(3), root)
    (tmp_path / "root" / "version=1").mkdir()  # a write that died
    assert sources.latest_version(spark, root) == 0
    assert sources.write_version(spark.range(5), root).endswith("version=2")
    assert sources.read_version(spark, root).count() == 5
    assert sources.read_version(spark, root, 0).count() == 3
