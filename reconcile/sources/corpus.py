"""Definition corpora: files ``<base>/<database>/<table>.sql``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from reconcile.functions.keys import is_identifier, key_from_path, path_names
from reconcile.sources.definition_files import DefinitionFiles


def read_corpus(spark: SparkSession, base: str, targets: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(definitions, errors)`` of the ``.sql`` files exactly two levels below ``base``.

    A base that is missing or no directory is an error. Files at other depths
    and with other extensions are left out; empty files are kept, and so are names
    that begin with ``_``. Files that cannot be opened come as errors. With
    ``targets`` (``database.table`` patterns) only directories and files in scope are listed and opened.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(f"directory does not exist: {base}")
    if not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(f"path is not a directory: {base}")
    # The tasks open files by themselves, so they need the place behind a mount table.
    root = fs.resolvePath(path).toString().rstrip("/")
    spark.dataSource.register(DefinitionFiles)
    reader = spark.read.format("definition_files").option("tasks", 2 * spark.sparkContext.defaultParallelism)
    targets = list(targets or [])
    if targets:
        reader = reader.option("targets", "\n".join(t for t in targets if "\n" not in t))
    files = reader.load(root)
    definitions, errors = parse_corpus(files.where("reason is null"), root)
    closed = files.where("reason is not null").select(F.col("path").alias("source"), "reason")
    return definitions, errors.unionByName(closed)


def write_corpus(definitions: DataFrame, base: str) -> None:
    """Write ``database_name, table_name, content`` as files ``<base>/<database>/<table>.sql``.

    A file that is there is replaced, other files stay. Files appear whole, one
    by one; a task that runs again writes the same ones. A name that can be no
    file's, or is no identifier, ends the job; null content is an empty file.
    """
    spark = definitions.sparkSession
    spark.dataSource.register(DefinitionFiles)
    wrong = F.raise_error(F.concat_ws(" ", F.lit("no identifier:"), "database_name", "table_name"))
    valid = is_identifier(F.col("database_name")) & is_identifier(F.col("table_name"))
    checked = definitions.withColumn("table_name", F.when(valid, F.col("table_name")).otherwise(wrong.cast("string")))
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    root = fs.resolvePath(path).toString()
    checked.select("database_name", "table_name", "content").write.format("definition_files").mode("append").save(root)


def parse_corpus(files: DataFrame, base: str = "") -> tuple[DataFrame, DataFrame]:
    """``(definitions, errors)`` of a table of files, ``path`` and binary ``content``.

    Definitions are ``database_name, table_name, source, content``; errors are
    ``source, reason`` of files at the right place with a name that is no
    identifier or a content that is not UTF-8. Both are views of one scan.
    """
    depth = F.size(F.split(F.substr("path", F.lit(len(base) + 1)), "/", -1))
    named = (
        files.where(F.col("path").startswith(f"{base}/") & F.col("path").endswith(".sql") & (depth == 3))
        .select(F.col("path").alias("source"), path_names(F.col("path")).alias("names"), "content")
        .where("names.table_name <> ''")
    )
    valid_names = is_identifier(F.col("names.database_name")) & is_identifier(F.col("names.table_name"))
    # is_valid_utf8 wants a string; the cast keeps the bytes as they are.
    reason = F.when(~valid_names, "invalid identifier").when(
        ~F.is_valid_utf8(F.col("content").cast("string")), "invalid UTF-8"
    )
    definitions = named.where(reason.isNull()).select("names.*", "source", F.col("content").cast("string").alias("content"))
    errors = named.where(reason.isNotNull()).select("source", reason.alias("reason"))
    return definitions, errors


def with_unreadable(definitions: DataFrame, errors: DataFrame) -> DataFrame:
    """``definitions`` and, without content, those of ``errors`` whose path still names a key.

    A plan then leaves these keys alone, where it would take a file that could
    not be read for a table to delete.
    """
    lost = errors.select(key_from_path(F.col("source")).alias("key"), "source").where("key is not null")
    return definitions.unionByName(lost.select("key.*", "source", F.lit(None).cast("string").alias("content")))
