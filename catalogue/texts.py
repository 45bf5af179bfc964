"""Text, fragments and corpora, over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import query, table, work_folder
from reconcile import plan, sources, text
from reconcile.functions import keys

BLANKS = "replace(text, chr(10), '  ' || chr(9) || chr(13) || chr(10)) || ' ' || chr(9) || chr(10) || chr(10)"
NORMAL = r"regexp_replace(regexp_replace({0}, '[^\S\n]+(\n|$)', '\1', 'g'), '\s+$', '')"
# The other version of a document: sentences on lines of their own, some words
# of a line replaced, whole lines alike or not.
OTHER = "replace(replace(text, '. ', '.' || chr(10)), ' the ', ' a ')"


@query(f"SELECT doc_id, md5({NORMAL.format(BLANKS)}) AS hash, len({NORMAL.format(BLANKS)}) AS n FROM documents")
def normalize_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.expr(BLANKS)).alias("t"))
    return documents.select("doc_id", F.md5("t").alias("hash"), F.length("t").cast("bigint").alias("n"))


@query(f"""SELECT doc_id, CAST(sum(greatest(n, 0)) AS bigint) AS lines_added, CAST(sum(greatest(-n, 0)) AS bigint) AS lines_removed FROM (
  SELECT doc_id, line, sum(n) AS n FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, -1 AS n FROM documents
    UNION ALL SELECT doc_id, unnest(string_split({OTHER}, chr(10))) AS line, 1 AS n FROM documents)
  GROUP BY doc_id, line) GROUP BY doc_id""")
def line_change_counts(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("old"), F.expr(OTHER).alias("new"))
    return text.line_change_counts(pairs, ["doc_id"], "old", "new")


def _diffed(spark, sf_dir, context):
    """Documents and their other version as two snapshots; the diff of those that changed."""
    documents = table(spark, sf_dir, "documents")
    planned = plan.plan(
        documents.select("doc_id", "text"), documents.select("doc_id", F.expr(OTHER).alias("text")), ["doc_id"], normalize="trailing"
    )
    change = planned["changes"][0]
    key = F.concat(F.lit("doc."), F.col("doc_id").cast("string"))
    return planned.select("doc_id", text.line_diff(key, change["old_value"], change["new_value"], context).alias("diff"))


@query(f"""SELECT doc_id, md5(old) AS old_hash, md5(new) AS new_hash FROM (
  SELECT doc_id, {NORMAL.format('text')} AS old, {NORMAL.format(OTHER)} AS new FROM documents) WHERE old <> new""")
def line_diff_replayed(spark, sf_dir):
    """A diff that shows every line gives both texts back."""
    lines = F.slice(F.split(F.expr("substring(diff, 1, length(diff) - 1)"), "\n", -1), 3, 2**30)

    def side(sign):
        kept = F.filter(lines, lambda l: F.substring(l, 1, 1).isin(" ", sign))
        return F.md5(F.array_join(F.transform(kept, lambda l: F.substr(l, F.lit(2))), "\n"))

    return _diffed(spark, sf_dir, 2**30).select("doc_id", side("-").alias("old_hash"), side("+").alias("new_hash"))


@query()
def line_diff_documents(spark, sf_dir):
    return _diffed(spark, sf_dir, 3)


CONVERSATIONS = """SELECT conv_id, string_agg(coalesce(line, ''), chr(10) ORDER BY turn) AS content
FROM (SELECT conv_id, turn, CASE WHEN role = 'system' THEN NULL ELSE text END AS line FROM conversations) GROUP BY conv_id"""


def _fragments(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "CASE WHEN role = 'system' THEN NULL ELSE text END AS line"
    )


@query(CONVERSATIONS)
def assemble_conversations(spark, sf_dir):
    return sources.assemble(_fragments(spark, sf_dir), ["conv_id"], "turn", "line")


@query(CONVERSATIONS)
def assemble_in_blocks(spark, sf_dir):
    return sources.assemble(_fragments(spark, sf_dir), ["conv_id"], "turn", "line", block=3)


# A corpus as a table of files: some too deep or of another kind, some with
# names that are no identifiers, some with bytes that are not UTF-8.
PLACE = """CASE WHEN n_chars < 150 THEN source || '/deep/' || lang WHEN n_chars < 200 THEN source || ' x' ELSE source END"""
KIND = "CASE WHEN n_chars BETWEEN 300 AND 400 THEN '.txt' ELSE '.sql' END"
FILES = f"'file:/corpus/' || {PLACE} || '/' || lang || '_' || CAST(doc_id AS string) || {KIND}"
BROKEN = "n_chars BETWEEN 600 AND 900"
RIGHT_PLACE = "n_chars >= 150 AND n_chars NOT BETWEEN 300 AND 400"


def _corpus(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(
        F.expr(f"{FILES} AS path"),
        F.expr(f"CASE WHEN {BROKEN} THEN concat(cast(text AS binary), X'FFFEFD') ELSE cast(text AS binary) END AS content"),
    )
    return sources.parse_corpus(files, "file:/corpus")


@query(f"""SELECT source AS database_name, lang || '_' || CAST(doc_id AS string) AS table_name, {FILES} AS source, md5(text) AS hash
FROM documents WHERE {RIGHT_PLACE} AND n_chars >= 200 AND NOT {BROKEN}""")
def corpus_definitions(spark, sf_dir):
    definitions, _ = _corpus(spark, sf_dir)
    return definitions.select("database_name", "table_name", "source", F.md5("content").alias("hash"))


# A corpus of real files: one for each document, some empty, some not UTF-8, databases and tables with names that
# Spark's readers hide.
HIDDEN = "CASE WHEN n_chars % 3 = 0 THEN '_' ELSE '' END"
FILE_DATABASE, FILE_TABLE = f"{HIDDEN} || source", f"{HIDDEN} || lang || '-' || CAST(doc_id AS string)"
FILE_KEYS = f"{FILE_DATABASE} AS database_name, {FILE_TABLE} AS table_name"
EMPTY = "n_chars % 5 = 0"


@query(f"""SELECT {FILE_KEYS}, CASE WHEN {BROKEN} THEN 'invalid UTF-8' ELSE 'read' END AS outcome,
  CASE WHEN NOT ({BROKEN}) THEN md5(CASE WHEN {EMPTY} THEN '' ELSE text END) END AS hash
FROM documents WHERE n_chars % 3 = 0 OR lang IN ('de', 'fr')""")
def corpus_read(spark, sf_dir):
    """Written as files by the tasks and read back in scope: every hidden database, and two languages of the others."""
    base = f"{work_folder(spark)}/corpus"
    files = table(spark, sf_dir, "documents").select(
        F.expr(f"{FILE_DATABASE} AS database_name"), F.expr(f"{FILE_TABLE} AS table_name"),
        F.expr(f"CASE WHEN {BROKEN} THEN concat(cast(text AS binary), X'FFFEFD') WHEN {EMPTY} THEN X'' ELSE cast(text AS binary) END AS content"),
    )
    sources.write_corpus(files, base)
    definitions, errors = sources.read_corpus(spark, base, ["_*.*", "*.de-*", "*.fr-*"])
    names = keys.path_names(F.col("source"))
    lost = errors.select(names["database_name"].alias("database_name"), names["table_name"].alias("table_name"), F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("hash"))
    read = definitions.select("database_name", "table_name", F.lit("read").alias("outcome"), F.md5(F.col("content").cast("binary")).alias("hash"))
    return read.unionByName(lost)


@query(f"""SELECT {FILES} AS source, CASE WHEN n_chars < 200 THEN 'invalid identifier' ELSE 'invalid UTF-8' END AS reason
FROM documents WHERE {RIGHT_PLACE} AND (n_chars < 200 OR {BROKEN})""")
def corpus_errors(spark, sf_dir):
    return _corpus(spark, sf_dir)[1]


@query(f"""SELECT source AS database_name, lang || '_' || CAST(doc_id AS string) AS table_name, 'Delete' AS operation
FROM documents WHERE NOT ({RIGHT_PLACE} AND n_chars >= 200)""")
def corpus_plan_leaves_unreadable_files(spark, sf_dir):
    """Files that could not be read are not taken for tables to delete; missing ones are."""
    known = table(spark, sf_dir, "documents").select(
        F.col("source").alias("database_name"), F.expr("lang || '_' || CAST(doc_id AS string) AS table_name"), F.col("text").alias("content")
    )
    corpus = sources.with_unreadable(*_corpus(spark, sf_dir)).drop("source")
    return plan.plan(known, corpus, ["database_name", "table_name"], required=["content"], details=False)
